"""Per-file readers for formats that Spark has no source for.

Each reader is a small function from bytes to typed rows that runs in Arrow
batches on the executors. A reader never raises: it returns an error text, so
one broken file cannot fail a job.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.functions.text import IMAGE_MIME

_ELEMENT = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("element_type", T.StringType()),
        T.StructField("page_number", T.IntegerType()),
        T.StructField("section", T.StringType()),
    ]
)
_WORD = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("x0", T.DoubleType()),
        T.StructField("top", T.DoubleType()),
        T.StructField("size", T.DoubleType()),
        T.StructField("fontname", T.StringType()),
    ]
)
_IMAGE = T.StructType(
    [
        T.StructField("page_number", T.IntegerType()),
        T.StructField("mime", T.StringType()),
        T.StructField("data", T.BinaryType()),
    ]
)
_BOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x0", "top", "x1", "bottom")])
_PAGE = T.StructType(
    [
        T.StructField("page_number", T.IntegerType()),
        T.StructField("tables", T.ArrayType(T.StringType())),
        T.StructField("boxes", T.ArrayType(_BOX)),
        T.StructField("words", T.ArrayType(_WORD)),
        T.StructField("plain", T.ArrayType(T.StringType())),
    ]
)


def _result(kind: T.DataType) -> T.StructType:
    return T.StructType(
        [T.StructField("found", T.ArrayType(kind)), T.StructField("error", T.StringType())]
    )


def _guarded(read: Callable[[bytes], list[dict]], contents: pd.Series) -> pd.DataFrame:
    rows = []
    for content in contents:
        try:
            rows.append((None if content is None else read(content), None))
        except Exception as problem:  # noqa: BLE001 - reported per file
            rows.append((None, f"{type(problem).__name__}: {problem}"[:80]))
    return pd.DataFrame(rows, columns=["found", "error"])


def _row(text: str, kind: str, section: str | None = None) -> dict:
    return {"text": text, "element_type": kind, "page_number": None, "section": section}


# ------------------------------------------------------------------ tables


def _csv(content: bytes) -> list[dict]:
    try:
        text = content.decode()
    except UnicodeDecodeError:
        text = content.decode("cp1252", "replace")
    table = pd.read_csv(io.StringIO(text))
    return [_row(table.to_string(index=False), "Table")]


def _xlsx(content: bytes) -> list[dict]:
    sheets = pd.read_excel(io.BytesIO(content), sheet_name=None)
    return [
        _row(sheet.to_string(index=False), "Table", str(name))
        for name, sheet in sheets.items()
        if not sheet.empty
    ]


@F.pandas_udf(_result(_ELEMENT))
def csv_elements(content: pd.Series) -> pd.DataFrame:
    return _guarded(_csv, content)


@F.pandas_udf(_result(_ELEMENT))
def xlsx_elements(content: pd.Series) -> pd.DataFrame:
    return _guarded(_xlsx, content)


# -------------------------------------------------------------------- DOCX

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _run_text(node) -> str:
    """Text of a paragraph: text runs, tabs and line breaks (not nested tables)."""
    pieces = {f"{_W}t": lambda n: n.text or "", f"{_W}tab": lambda n: "\t"}
    pieces.update(dict.fromkeys((f"{_W}br", f"{_W}cr"), lambda n: "\n"))
    return "".join(pieces[n.tag](n) for n in node.iter() if n.tag in pieces).strip()


def _style_names(package: zipfile.ZipFile) -> dict[str, str]:
    if "word/styles.xml" not in package.namelist():
        return {}
    root = ElementTree.fromstring(package.read("word/styles.xml"))
    return {
        s.get(f"{_W}styleId"): s.find(f"{_W}name").get(f"{_W}val", "")
        for s in root.iter(f"{_W}style")
        if s.find(f"{_W}name") is not None
    }


def _docx(content: bytes) -> list[dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        styles = _style_names(package)
        body = ElementTree.fromstring(package.read("word/document.xml")).find(f"{_W}body")
    out = []
    for node in body:
        if node.tag == f"{_W}p":
            used = node.find(f"{_W}pPr/{_W}pStyle")
            key = "" if used is None else used.get(f"{_W}val", "")
            style = styles.get(key, key).lower()
            kind = "NarrativeText"
            if "heading" in style or "title" in style:
                kind = "Title"
            elif "list" in style:
                kind = "ListItem"
            out.append(_row(_run_text(node), kind))
        elif node.tag == f"{_W}tbl":
            grid = [
                "\t".join(
                    "\n".join(_run_text(p) for p in cell.findall(f"{_W}p")).strip()
                    for cell in line.findall(f"{_W}tc")
                )
                for line in node.findall(f"{_W}tr")
            ]
            out.append(_row("\n".join(grid).strip(), "Table"))
    return [e for e in out if e["text"]]


def _docx_images(content: bytes) -> list[dict]:
    """Pictures placed inline in the text, in reading order."""
    relation = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}embed"
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        if "word/_rels/document.xml.rels" not in package.namelist():
            return []
        links = ElementTree.fromstring(package.read("word/_rels/document.xml.rels"))
        target = {link.get("Id"): link.get("Target", "") for link in links}
        body = ElementTree.fromstring(package.read("word/document.xml"))
        placed = [
            target.get(node.get(relation), "")
            for shape in body.iter()
            if shape.tag.endswith("}inline")
            for node in shape.iter()
            if node.tag.endswith("}blip")
        ]
        names = [f"word/{t.removeprefix('/word/')}" for t in placed if t]
        return [
            {"page_number": None, "mime": _mime(n), "data": package.read(n)}
            for n in names
            if n in package.namelist()
        ]


def _mime(name: str) -> str:
    return IMAGE_MIME.get(name.rsplit(".", 1)[-1].lower(), "image/png")


@F.pandas_udf(_result(_ELEMENT))
def docx_elements(content: pd.Series) -> pd.DataFrame:
    return _guarded(_docx, content)


@F.pandas_udf(_result(_IMAGE))
def docx_images(content: pd.Series) -> pd.DataFrame:
    return _guarded(_docx_images, content)


# --------------------------------------------------------------------- PDF


def _pdf_words(content: bytes) -> list[dict]:
    import pdfplumber  # optional dependency

    pages = []
    with pdfplumber.open(io.BytesIO(content)) as pdf:
        for number, page in enumerate(pdf.pages, start=1):
            tables = page.find_tables()
            words = page.extract_words(
                keep_blank_chars=False, use_text_flow=True, extra_attrs=["size", "fontname"]
            )
            texts = [
                "\n".join("\t".join(c or "" for c in row) for row in t.extract() or []).strip()
                for t in tables
            ]
            pages.append(
                {
                    "page_number": number,
                    "tables": [t for t in texts if t],
                    "boxes": [dict(zip(("x0", "top", "x1", "bottom"), map(float, t.bbox))) for t in tables],
                    "words": [
                        {
                            "text": w["text"],
                            "x0": float(w["x0"]),
                            "top": float(w["top"]),
                            "size": float(w.get("size") or 0),
                            "fontname": w.get("fontname"),
                        }
                        for w in words
                    ],
                    "plain": [],
                }
            )
    return pages


def _pdf_plain(content: bytes) -> list[dict]:
    import fitz  # optional dependency

    with fitz.open(stream=content, filetype="pdf") as document:
        return [
            {
                "page_number": number,
                "tables": [],
                "boxes": [],
                "words": [],
                "plain": [s.strip() for s in page.get_text().splitlines() if s.strip()],
            }
            for number, page in enumerate(document, start=1)
        ]


def _pdf(content: bytes) -> list[dict]:
    try:
        return _pdf_words(content)
    except Exception as first:  # noqa: BLE001 - the second reader gets its turn
        try:
            return _pdf_plain(content)
        except ImportError:
            raise first from None


@F.pandas_udf(_result(_PAGE))
def pdf_pages(content: pd.Series) -> pd.DataFrame:
    return _guarded(_pdf, content)


def rasterize_page(content: bytes, page_number: int, dpi: int) -> bytes:
    """PNG bytes of one page (1-based); needs the optional PDF renderer."""
    import fitz

    with fitz.open(stream=content, filetype="pdf") as document:
        return document[page_number - 1].get_pixmap(dpi=dpi, alpha=False).tobytes("png")


def _pdf_images(content: bytes, dpi: int) -> list[dict]:
    """What a describer should see: whole pages without text, else embedded pictures."""
    import fitz

    out = []
    with fitz.open(stream=content, filetype="pdf") as document:
        for number, page in enumerate(document, start=1):
            if not page.get_text().strip():
                picture = page.get_pixmap(dpi=dpi, alpha=False).tobytes("png")
                out.append({"page_number": number, "mime": "image/png", "data": picture})
                continue
            for entry in page.get_images(full=True):
                found = document.extract_image(entry[0])
                if found.get("image"):
                    mime = _mime("x." + found.get("ext", "png"))
                    out.append({"page_number": number, "mime": mime, "data": found["image"]})
    return out


@F.pandas_udf(_result(_IMAGE))
def pdf_images(content: pd.Series, dpi: pd.Series) -> pd.DataFrame:
    """Pictures of a PDF; an error, and no pictures, without the renderer."""
    resolution = int(dpi.iloc[0]) if len(dpi) else 0
    return _guarded(lambda data: _pdf_images(data, resolution), content)
