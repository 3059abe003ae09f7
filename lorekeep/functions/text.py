"""String and formatting expressions, all evaluated inside the JVM."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that decide results: they must equal the behaviour being matched.
MAX_TEXT_CHARS = 8000
LLM_INPUT_CHARS = 6000
HEAD_TAIL_LIMIT_WORDS = 5000
HEAD_TAIL_KEEP_WORDS = 2500
HEAD_MARKER = "Tête du document:"
TAIL_MARKER = "Queue du document:"
FAILED_SUMMARY = "No summary available (LLM failed)"
FAILED_KEYWORDS = ("error", "fallback")
CHANNEL_MARK = "<|channel|>"
THOUGHT_WORD = "thought"

# What str.strip() removes and str.splitlines() breaks on, derived by rule.
WHITESPACE = "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace())
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (a `let` for expressions)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def lines(text: Column) -> Column:
    """Stripped, non-blank lines of a text, in order."""
    return F.filter(
        F.transform(F.split(text, LINE_BREAK), strip), lambda line: line != ""
    )


def truncate(text: Column, limit: int = MAX_TEXT_CHARS) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, limit)


def chunk_id(document_id: Column, chunk_index: Column) -> Column:
    return F.sha2(
        F.concat_ws(":", document_id.cast("string"), chunk_index.cast("string")), 256
    )


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def suffix(path: Column) -> Column:
    """Last extension with its dot, in the case it was written; '' if there is none."""
    return F.regexp_extract(basename(path), r"[^.](\.[^.]+)$", 1)


def snippet(text: Column, width: int) -> Column:
    cut = F.translate(F.substring(F.coalesce(text, F.lit("")), 1, width), "\n", " ")
    return F.concat(strip(cut), F.lit("..."))


def table_cell(text: Column, width: int) -> Column:
    """A value made safe for one cell of a Markdown table row."""
    return F.substring(F.translate(text, "|\n", "/ "), 1, width)


def _nonblank(value: Column) -> Column:
    return F.when(value != "", value)


def citation(section: Column, page: Column, keep_page_zero: bool = True) -> Column:
    """``section, p.N``; absent parts are left out."""
    shown = page if keep_page_zero else F.when(page != 0, page)
    return F.concat_ws(
        ", ", _nonblank(section), F.concat(F.lit("p."), shown.cast("string"))
    )


def source_label(file_name: Column, page: Column, section: Column) -> Column:
    """``name - p.N - section``; NULL when the file name is missing."""
    shown = F.when(page != 0, page)
    label = F.concat_ws(
        " - ",
        file_name,
        F.concat(F.lit("p."), shown.cast("string")),
        _nonblank(section),
    )
    return F.when(_nonblank(file_name).isNotNull(), label)


def xml_document(index: Column, source: Column, content: Column) -> Column:
    """One context block; values are inserted as they are, without escaping."""
    return F.format_string(
        '<document index="%d">\n  <source>%s</source>\n  <content>%s</content>\n</document>',
        index,
        source,
        content,
    )


def rag_prompt(question: Column, context: Column) -> Column:
    return F.concat(
        F.lit("Sources:\n"),
        context,
        F.lit("\n\nQuestion, to be answered from these sources: "),
        question,
        F.lit("\n"),
    )


def head_and_tail(text: Column) -> Column:
    """Long texts become their first and last words around a marker."""
    keep = HEAD_TAIL_KEEP_WORDS

    def shorten(words: Column) -> Column:
        joined = F.concat(
            F.lit(HEAD_MARKER + "\n"),
            F.array_join(F.slice(words, 1, keep), " "),
            F.lit("\n...\n" + TAIL_MARKER + "\n"),
            F.array_join(F.slice(words, -keep, keep), " "),
        )
        return F.when(F.size(words) > HEAD_TAIL_LIMIT_WORDS, joined).otherwise(text)

    words = F.filter(
        F.split(text, f"[{WHITESPACE}]+"), lambda w: w != ""
    )
    return bind(words, shorten)


def llm_input(text: Column, limit: int = LLM_INPUT_CHARS) -> Column:
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("\n..."))
    ).otherwise(text)


def parse_analysis(answer: Column) -> Column:
    """Model answer (JSON text) to ``struct<summary, keywords>``.

    Anything that is not a complete object - invalid JSON, blank summary, no
    usable keyword - becomes the fixed fallback value.
    """
    failed = F.struct(
        F.lit(FAILED_SUMMARY).alias("summary"),
        F.array(*[F.lit(k) for k in FAILED_KEYWORDS]).alias("keywords"),
    )
    parsed = F.from_json(answer, "struct<summary:string,keywords:array<string>>")

    def validate(value: Column) -> Column:
        words = F.filter(
            F.transform(value["keywords"], strip), lambda w: w.isNotNull() & (w != "")
        )
        clean = F.struct(strip(value["summary"]).alias("summary"), words.alias("keywords"))
        complete = (clean["summary"] != "") & (F.size(clean["keywords"]) > 0)
        return F.when(F.coalesce(complete, F.lit(False)), clean).otherwise(failed)

    return F.coalesce(bind(parsed, validate), failed)


def strip_thinking(answer: Column) -> Column:
    """The part of an answer that is not reasoning.

    Between channel markers, a part that begins with the word for thoughts is
    dropped; of the rest the last counts. In it, whatever stands between a
    think tag and its end tag is dropped.
    """
    parts = F.split(F.coalesce(answer, F.lit("")), re.escape(CHANNEL_MARK))
    first, later = F.slice(parts, 1, 1), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    said = F.filter(later, lambda p: ~F.startswith(F.lower(F.ltrim(strip(p))), F.lit(THOUGHT_WORD)))
    last = F.element_at(F.concat(first, said), -1)

    def outside(pieces: Column) -> Column:
        kept = F.transform(
            F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))),
            lambda p: bind(F.split(p, "(?i)</think>", 2), lambda x: F.when(F.size(x) > 1, x[1]).otherwise(F.concat(F.lit("<think>"), p))),
        )
        return F.concat(pieces[0], F.array_join(kept, ""))

    return strip(bind(F.split(last, "(?i)<think>"), outside))


def keywords_from_json(raw: Column) -> Column:
    """Legacy JSON text to a list: NULL stays NULL, unreadable text becomes []."""
    return F.when(
        raw.isNotNull(), F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))
    )


# Image extension to MIME type.
IMAGE_MIME = {
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "gif": "image/gif",
    "bmp": "image/bmp",
    "tif": "image/tiff",
    "tiff": "image/tiff",
}


def image_mime(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in IMAGE_MIME.items() for x in pair])
    extension = F.ltrim(F.lower(suffix(path)), F.lit("."))
    return F.coalesce(F.try_element_at(table, extension), F.lit("image/png"))


def sse_frame(payload: Column) -> Column:
    return F.concat(F.lit("data: "), payload, F.lit("\n\n"))
