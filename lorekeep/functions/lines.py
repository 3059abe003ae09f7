"""Grouping of positioned words into text lines, inside one page row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorekeep.functions.text import bind, strip

WORDS = "array<struct<text:string,x0:double,top:double,size:double,fontname:string>>"
BOXES = "array<struct<x0:double,top:double,x1:double,bottom:double>>"

# Fixed values of the heuristic.
LINE_TOLERANCE = 3.0
TITLE_SIZE = 13.0
TITLE_FONTS = ("bold", "black")


def inside_any(word: Column, boxes: Column) -> Column:
    return F.exists(
        boxes,
        lambda b: word["x0"].between(b["x0"], b["x1"]) & word["top"].between(b["top"], b["bottom"]),
    )


def _half_even_tenth(value: Column) -> Column:
    return F.bround(value, 1)


def group_words(words: Column, boxes: Column, title_size: float = TITLE_SIZE) -> Column:
    """``array<struct<text, is_title>>`` in reading order.

    Words are sorted by (rounded top, x0); a line ends where the vertical
    distance to the word before exceeds the tolerance. Lines are slices between
    such breaks, so a page is handled in one row and never shuffled.
    """
    free = F.filter(words, lambda w: ~inside_any(w, boxes))
    ordered = F.transform(
        F.sort_array(
            F.transform(
                free,
                lambda w, i: F.struct(
                    _half_even_tenth(w["top"]).alias("band"),
                    w["x0"].alias("x0"),
                    i.alias("position"),
                    w.alias("word"),
                ),
            )
        ),
        lambda s: s["word"],
    )

    def cut(sorted_words: Column) -> Column:
        count = F.size(sorted_words)
        breaks = F.filter(
            F.sequence(F.lit(0), count - 1),
            lambda i: (i == 0)
            | (
                F.abs(F.get(sorted_words, i)["top"] - F.get(sorted_words, i - 1)["top"])
                > LINE_TOLERANCE
            ),
        )
        grouped = bind(
            breaks,
            lambda starts: F.transform(
                starts,
                lambda at, k: line_of(
                    F.slice(sorted_words, at + 1, F.coalesce(F.get(starts, k + 1), count) - at)
                ),
            ),
        )
        nothing = F.array().cast("array<struct<text:string,is_title:boolean>>")
        return F.when(count > 0, F.filter(grouped, lambda g: g["text"] != "")).otherwise(nothing)

    def line_of(line: Column) -> Column:
        by_x = F.sort_array(
            F.transform(
                line,
                lambda w, i: F.struct(w["x0"].alias("x0"), i.alias("i"), w["text"].alias("text")),
            )
        )
        text = strip(F.array_join(F.transform(by_x, lambda w: w["text"]), " "))
        sizes = F.filter(F.transform(line, lambda w: w["size"]), lambda s: s != 0)
        mean = F.aggregate(sizes, F.lit(0.0), lambda a, s: a + s) / F.greatest(
            F.size(sizes), F.lit(1)
        )
        fonts = F.exists(
            line,
            lambda w: F.lower(F.coalesce(w["fontname"], F.lit(""))).rlike("|".join(TITLE_FONTS)),
        )
        return F.struct(text.alias("text"), ((mean >= title_size) | fonts).alias("is_title"))

    return bind(ordered, cut)
