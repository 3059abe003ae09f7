"""Typed document elements as arrays: line classification and section tracking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorekeep.functions.text import bind, lines, strip

ELEMENTS = "array<struct<text:string,element_type:string,page_number:int,section:string>>"
TITLE_TYPES = ("Title", "Section")
SECTION_CHARS = 200


def typed(text: Column, element_type: Column | str, page: Column | None = None) -> Column:
    kind = F.lit(element_type) if isinstance(element_type, str) else element_type
    return F.struct(
        text.alias("text"),
        kind.alias("element_type"),
        (F.lit(None) if page is None else page).cast("int").alias("page_number"),
    )


def attach_sections(elements: Column, title_names_itself: bool = False) -> Column:
    """Add to every element the last title that stands strictly before it.

    The list is cut behind each title and every piece gets the text of the
    title it follows. Each element is copied once, so the cost is linear and
    no shuffle is needed. With ``title_names_itself`` a title without a
    predecessor takes its own text as its section.
    """

    def by_title(items: Column) -> Column:
        titles = F.filter(
            F.transform(
                items,
                lambda e, i: F.when(
                    e["element_type"].isin(*TITLE_TYPES) & (strip(e["text"]) != ""), i
                ),
            ),
            lambda i: i.isNotNull(),
        )
        return bind(titles, lambda at: cut_behind(items, at))

    def cut_behind(items: Column, at: Column) -> Column:
        def piece(previous: Column, k: Column) -> Column:
            stop = F.coalesce(F.get(at, k), F.size(items) - 1)
            section = F.when(
                previous >= 0,
                F.substring(strip(F.get(items, previous)["text"]), 1, SECTION_CHARS),
            )
            rows = F.slice(items, previous + 2, stop - previous)
            return bind(section, lambda s: F.transform(rows, lambda e: with_section(e, s)))

        return F.flatten(F.transform(F.concat(F.array(F.lit(-1)), at), piece))

    def with_section(element: Column, section: Column) -> Column:
        own = F.when(
            element["element_type"] == "Title", F.substring(element["text"], 1, SECTION_CHARS)
        )
        return F.struct(
            element["text"].alias("text"),
            element["element_type"].alias("element_type"),
            element["page_number"].alias("page_number"),
            (F.coalesce(section, own) if title_names_itself else section).alias("section"),
        )

    return bind(elements, by_title)


def text_elements(content: Column) -> Column:
    """Plain text or Markdown: one element per non-blank line."""

    def classify(line: Column) -> Column:
        title = strip(F.ltrim(line, F.lit("#")))
        bullet = F.substring(line, 1, 2).isin("- ", "* ", "+ ")
        return (
            F.when(F.startswith(line, F.lit("#")), typed(title, "Title"))
            .when(bullet, typed(strip(F.substring(line, 3, 2147483647)), "ListItem"))
            .otherwise(typed(line, "NarrativeText"))
        )

    found = F.filter(F.transform(lines(content), classify), lambda e: e["text"] != "")
    return attach_sections(found, title_names_itself=True)


def elements_to_text(elements: Column) -> Column:
    texts = F.filter(
        F.transform(elements, lambda e: e["text"]), lambda t: t.isNotNull() & (t != "")
    )
    return strip(F.array_join(texts, "\n"))
