"""Structural elements of HTML pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.functions.elements import attach_sections

# Subtrees that are dropped, and what becomes an element.
DROPPED = {"script", "style", "nav", "footer", "header"}
ELEMENT_OF = {
    **{f"h{n}": "Title" for n in range(1, 7)},
    "p": "NarrativeText",
    "li": "ListItem",
    "table": "Table",
}
# Subtrees whose text is no text of the page.
UNSEEN = {"head", "title", "noscript", "template", "textarea", "select", "button"}
# Elements inside a line; any other tag ends a run of text that stands in no element of its own.
INLINE = set(
    "a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var".split()
)
VOID = set("area base br col embed hr img input link meta source track wbr".split())
# Start tags that end an open paragraph (HTML standard, "p" end tag omission).
ENDS_PARAGRAPH = set(
    "address article aside blockquote details div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
# Start tags that end an open element of the same family, up to the given container.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}

# Pages that a worker holds as objects at a time; the rest of a batch stays in Arrow.
SLICE_PAGES = 200

_FOUND = T.ArrayType(
    T.StructType(
        [
            T.StructField("text", T.StringType()),
            T.StructField("element_type", T.StringType()),
            T.StructField("page_number", T.IntegerType()),
        ]
    )
)


class _Collector(HTMLParser):
    """Collects matched nodes in the order in which they open.

    Text goes to every open match, so a paragraph inside a list item is
    reported twice, as both. Each text node is stripped and the pieces are
    joined without a separator. Text that stands in none of the elements, for
    instance directly in a ``div``, is a paragraph of its own; its pieces are
    joined by a space.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, dict | None]] = []
        self.found: list[dict] = []
        self.muted = 0
        self.pending = ""
        self.unseen = 0
        self.loose: dict | None = None

    def _settle_text(self) -> None:
        text, self.pending = self.pending.strip(), ""
        if text and not self.muted and not self.unseen and all(match is None for _, match in self.open):
            if self.loose is None:
                self.loose = {"kind": "NarrativeText", "parts": [], "rows": []}
                self.found.append(self.loose)
            self.loose["parts"].append((" " if self.loose["parts"] else "") + text)
        elif text and not self.muted:
            for tag, match in self.open:
                if match is None:
                    continue
                if match["kind"] != "Table":
                    match["parts"].append(text)
                elif match["rows"] and match["rows"][-1]:
                    match["rows"][-1][-1].append(text)

    def _close_through(self, position: int) -> None:
        for tag, _ in self.open[position:]:
            self.muted -= tag in DROPPED
            self.unseen -= tag in UNSEEN
        del self.open[position:]

    def _close_open(self, tags: set[str], stop: set[str]) -> None:
        for position in range(len(self.open) - 1, -1, -1):
            tag = self.open[position][0]
            if tag in tags:
                self._close_through(position)
                return self._close_open(tags, stop)
            if tag in stop:
                return None
        return None

    def handle_starttag(self, tag, attrs):
        self._settle_text()
        if tag not in INLINE:
            self.loose = None
        if tag in VOID:
            return
        if tag in ENDS_PARAGRAPH:
            self._close_open({"p"}, {"td", "th", "table"} if tag != "table" else {"td", "th"})
        if tag in SIBLINGS:
            self._close_open(*SIBLINGS[tag])
        if tag in ("tr", "td", "th"):
            for _, match in self.open:
                if match is not None and match["kind"] == "Table":
                    if tag == "tr":
                        match["rows"].append([])
                    elif match["rows"]:
                        match["rows"][-1].append([])
        match = None
        if tag in ELEMENT_OF and not self.muted:
            match = {"kind": ELEMENT_OF[tag], "parts": [], "rows": []}
            self.found.append(match)
        self.muted += tag in DROPPED
        self.unseen += tag in UNSEEN
        self.open.append((tag, match))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self._settle_text()
        if tag not in INLINE:
            self.loose = None
        for position in range(len(self.open) - 1, -1, -1):
            if self.open[position][0] == tag:
                self._close_through(position)
                return

    def handle_data(self, data):
        self.pending += data

    def handle_comment(self, data):
        self._settle_text()

    def elements(self, html: str) -> list[dict]:
        self.feed(html)
        self.close()
        self._settle_text()
        out = []
        for match in self.found:
            if match["kind"] == "Table":
                rows = ["\t".join("".join(cell) for cell in row) for row in match["rows"] if row]
                text = "\n".join(rows).strip()
            else:
                text = "".join(match["parts"])
            if text:
                out.append({"text": text, "element_type": match["kind"], "page_number": None})
        return out


_ARROW = pa.list_(pa.struct([("text", pa.string()), ("element_type", pa.string()), ("page_number", pa.int32())]))


def _matches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for at in range(0, len(batch), SLICE_PAGES):
            pages = batch.slice(at, SLICE_PAGES).to_pylist()
            yield pa.array([None if page is None else _Collector().elements(page) for page in pages], _ARROW)


@F.arrow_udf(_FOUND)
def html_matches(html: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return _matches(html)


def html_elements(html: Column) -> Column:
    return attach_sections(html_matches(html))
