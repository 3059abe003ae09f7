"""Elements of texts and files as rows: table functions for lateral joins.

``text_elements`` makes one array per document, which is the faster way for documents that fit a row. The functions here give one row
per element as soon as its line is read, so neither a document's elements nor, with ``file_element_rows``, its content are ever
held whole. Both need one forward pass, as an element's section is the last title before it, and neither shuffles anything.

Defined results: NULL and blank texts give no rows, as do files without a line; a title names itself where no title precedes it.
A file that cannot be opened gives one row with a ``position`` of -1, the type ``error`` and the reason as its text.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from lorekeep.functions.elements import SECTION_CHARS
from lorekeep.functions.text import LINE_BREAK
from lorekeep.sources.listing import opened

ROW = "position long, element_type string, text string, section string"
FIELDS = ["position", "element_type", "text", "section"]
#: Characters of a text, or bytes of a file, that are looked at in one step.
STEP = 1 << 20

_BREAK = re.compile(LINE_BREAK)


def stripped_lines(pieces: Iterable[str]) -> Iterator[str]:
    """Stripped, non-blank lines of a text given in pieces; only the line at the end of a piece is held.

    A break of two characters may be cut by a piece's end: the empty line that results is blank and left out.
    """
    held: list[str] = []
    for piece in pieces:
        first, *more = _BREAK.split(piece)
        held.append(first)
        for line in more:
            whole = "".join(held).strip()
            if whole:
                yield whole
            held = [line]
    whole = "".join(held).strip()
    if whole:
        yield whole


def element_of(line: str) -> tuple[str, str]:
    """Type and text of a line."""
    if line.startswith("#"):
        return "Title", line.lstrip("#").strip()
    if line[:2] in ("- ", "* ", "+ "):
        return "ListItem", line[2:].strip()
    return "NarrativeText", line


def rows_of(pieces: Iterable[str]) -> Iterator[tuple[int, str, str, str | None]]:
    section, position = None, 0
    for line in stripped_lines(pieces):
        kind, text = element_of(line)
        if not text:
            continue
        named = text[:SECTION_CHARS] if kind == "Title" else None
        yield position, kind, text, named if section is None else section
        section = named or section
        position += 1


def encoding_of(blocks: Iterable[bytes]) -> tuple[str, str]:
    """Encoding and treatment of errors: UTF-8, else Windows-1252, else UTF-8 with replacement characters."""
    left = {"utf-8": codecs.getincrementaldecoder("utf-8")(), "cp1252": codecs.getincrementaldecoder("cp1252")()}
    for block in blocks:
        for name in list(left):
            try:
                left[name].decode(block)
            except UnicodeDecodeError:
                del left[name]
        if not left:
            break
    if "utf-8" in left:
        try:
            left["utf-8"].decode(b"", final=True)
            return "utf-8", "strict"
        except UnicodeDecodeError:
            pass
    return ("cp1252", "strict") if "cp1252" in left else ("utf-8", "replace")


def _blocks(path: str) -> Iterator[bytes]:
    system, inner, _ = opened(path)
    with system.open_input_stream(inner) as stream:
        while block := stream.read(STEP):
            yield block


def file_rows(path: str) -> Iterator[tuple[int, str, str, str | None]]:
    """Rows of a text file, read twice: once for its encoding, once for its lines."""
    encoding, errors = encoding_of(_blocks(path))
    decoder = codecs.getincrementaldecoder(encoding)(errors)

    def pieces():
        for block in _blocks(path):
            yield decoder.decode(block)
        yield decoder.decode(b"", final=True)

    return rows_of(pieces())


class _TextRows:
    def eval(self, content):
        if content is not None:
            yield from rows_of(content[at : at + STEP] for at in range(0, len(content), STEP))


class _FileRows:
    def eval(self, path):
        if path is not None:
            try:
                yield from file_rows(path)
            except OSError as problem:
                yield -1, "error", str(problem), None


# Rows leave one by one: with Arrow, all rows of a call would be gathered first.
element_rows = udtf(_TextRows, returnType=ROW, useArrow=False)
file_element_rows = udtf(_FileRows, returnType=ROW, useArrow=False)


def register(spark: SparkSession) -> None:
    """Make both functions known to SQL: ``FROM t, LATERAL element_rows(t.text)``."""
    spark.udtf.register("element_rows", element_rows)
    spark.udtf.register("file_element_rows", file_element_rows)


def with_element_rows(df: DataFrame, text: str) -> DataFrame:
    """``df`` without ``text`` and with a row per element of it; columns of ``df`` with the names of ``FIELDS`` are not allowed."""
    return _lateral(df, text, element_rows)


def with_file_rows(listed: DataFrame, path: str = "path") -> DataFrame:
    """``listed`` with a row per element of the text file that ``path`` names; contents are read by the tasks that hold the paths."""
    return _lateral(listed, path, file_element_rows, keep=True)


def _lateral(df: DataFrame, name: str, function, keep: bool = False) -> DataFrame:
    clash = [c for c in df.columns if c.lower() in FIELDS and (keep or c != name)]
    if clash:
        raise ValueError(f"columns {clash} have the names of element fields")
    kept = [c for c in df.columns if keep or c != name]
    left = df.alias("_whole")
    joined = left.lateralJoin(function(F.col(f"_whole.`{name}`").outer()).alias("_element"))
    return joined.select(*(F.col(f"_whole.`{c}`") for c in kept), *(F.col(f"_element.{c}") for c in FIELDS))
