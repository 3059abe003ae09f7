"""From files to elements: the reader is chosen by extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.backends import Describer, describe_all_column, describe_column
from lorekeep.functions.elements import ELEMENTS, attach_sections, text_elements, typed
from lorekeep.functions.lines import group_words
from lorekeep.functions.text import IMAGE_MIME, basename, image_mime, strip, suffix
from lorekeep.sources import office
from lorekeep.sources.files import decode_text
from lorekeep.sources.html import html_elements

# Formats on the bulk list that no reader understands.
UNREADABLE = (".doc", ".msg")
_TOLD = "array<struct<page_number:int,text:string>>"


def page_elements(pages: Column, told: Column | None = None) -> Column:
    """Elements of a document's pages: tables first, then the text lines.

    ``told`` holds descriptions of pictures (``page_number, text``); each ends
    its page.
    """

    def of_page(page: Column) -> Column:
        number = page["page_number"]
        tables = F.transform(page["tables"], lambda t: typed(t, "Table", number))
        grouped = F.transform(
            group_words(page["words"], page["boxes"]),
            lambda g: typed(
                g["text"], F.when(g["is_title"], "Title").otherwise("NarrativeText"), number
            ),
        )
        plain = F.transform(page["plain"], lambda t: typed(t, "NarrativeText", number))
        parts = [tables, grouped, plain]
        if told is not None:
            here = F.filter(told, lambda t: t["page_number"] == number)
            parts.append(F.transform(here, lambda t: typed(t["text"], "NarrativeText", number)))
        return F.concat(*parts)

    return attach_sections(F.flatten(F.transform(pages, of_page)))


def extract_elements(
    files: DataFrame, describer: Describer | None = None, dpi: int = 200
) -> DataFrame:
    """``files`` plus ``elements`` and ``extract_error``, in one pass over the content.

    A reader that runs in Python gets NULL for files of other formats, so no
    content is sent to a worker that does not need it and nothing is read twice.
    Without a describer, images yield no elements; with one, pictures inside
    documents and pages without text are described as well.
    """
    path, content = F.col("path"), F.col("content")
    extension = F.lower(suffix(path))
    images = [f".{e}" for e in IMAGE_MIME]
    name = basename(path)

    def only(*extensions: str) -> Column:
        return F.when(extension.isin(*extensions), content)

    def plain(found: Column) -> Column:
        return F.transform(found, lambda e: typed(e["text"], e["element_type"], e["page_number"]))

    def named(found: Column) -> Column:
        return F.transform(found, lambda e: e.withField("section", F.coalesce(e["section"], name)))

    rows = files.withColumns(
        {
            "_csv": office.csv_elements(only(".csv")),
            "_xlsx": office.xlsx_elements(only(".xlsx")),
            "_docx": office.docx_elements(only(".docx")),
            "_pdf": office.pdf_pages(only(".pdf")),
        }
    )
    pictures = F.array().cast(ELEMENTS)
    helpers, extra = ["_csv", "_xlsx", "_docx", "_pdf"], []
    in_docx, in_pdf = F.array().cast(_TOLD), None
    if describer is not None:
        describe_all = describe_all_column(describer)
        rows = rows.withColumns(
            {
                "_docx_images": office.docx_images(only(".docx")),
                "_pdf_images": office.pdf_images(only(".pdf"), F.lit(dpi)),
            }
        ).withColumns(
            {
                "_in_docx": describe_all(F.col("_docx_images.found")),
                "_in_pdf": describe_all(F.col("_pdf_images.found")),
            }
        )
        in_docx = F.coalesce(F.col("_in_docx"), in_docx)
        in_pdf = F.coalesce(F.col("_in_pdf"), F.array().cast(_TOLD))
        rows = rows.withColumn("_told", describe_column(describer)(only(*images), image_mime(path)))
        extra = ["_told", "_docx_images", "_pdf_images", "_in_docx", "_in_pdf"]
        told = typed(F.col("_told"), "NarrativeText").withField("section", name)
        pictures = F.when(strip(F.col("_told")) != "", F.array(told).cast(ELEMENTS))

    seen = F.transform(in_docx, lambda t: typed(t["text"], "NarrativeText"))
    docx = attach_sections(F.concat(plain(F.col("_docx.found")), seen))
    page_text = F.make_valid_utf8(only(".html", ".htm").cast("string"))
    found = (
        F.when(extension.isin(".html", ".htm"), html_elements(page_text).cast(ELEMENTS))
        .when(extension == ".csv", named(F.col("_csv.found")).cast(ELEMENTS))
        .when(extension == ".xlsx", F.col("_xlsx.found").cast(ELEMENTS))
        .when(extension == ".docx", docx.cast(ELEMENTS))
        .when(extension == ".pdf", page_elements(F.col("_pdf.found"), in_pdf).cast(ELEMENTS))
        .when(extension.isin(*images), pictures)
        .when(~extension.isin(*UNREADABLE), text_elements(decode_text(content)).cast(ELEMENTS))
    )
    error = F.coalesce(
        *[F.col(f"{h}.error") for h in helpers],
        F.when(extension.isin(*UNREADABLE), F.lit("unsupported format")),
    )
    # Second attempt: where a reader of a textual format fails or finds nothing, the lines are read.
    textual = extension == ".csv"
    lines = text_elements(decode_text(F.when(textual, content))).cast(ELEMENTS)
    nothing = textual & (F.coalesce(F.size(found), F.lit(0)) <= 0)
    second = F.when(nothing, lines)
    error = F.when(~(nothing & (F.coalesce(F.size(second), F.lit(0)) > 0)), error)
    return (
        rows.withColumn("elements", F.coalesce(second, found, F.array().cast(ELEMENTS)))
        .withColumn("extract_error", error)
        .drop(*helpers, *extra)
    )
