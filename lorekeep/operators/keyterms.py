"""Telling terms by tf-idf, with document frequencies in a count-min sketch.

How many documents hold a term is counted in ``depth`` rows of ``width`` cells, whatever the number of terms and documents: every
task adds its documents up to at most ``depth * width`` counts, so no more than these narrow rows leave a task. A term's
estimate is the least of its cells. It is never below the true frequency; it exceeds it by more than ``error_bound`` (e / width
times all pairs of term and document) with a probability of at most ``e ** -depth`` per term (Cormode and Muthukrishnan, 2005). The finished
sketch has a fixed size (262,144 counts by default) and becomes a literal, which the optimizer unpacks once; each document's terms are then
ranked in its row, without a join and without another exchange.

A term's cells are its MD5 digest's 32-bit words modulo the width, so that plain SQL gives the same sketch.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import bind
from lorekeep.functions.tokens import Tokenizer, term_counts

#: Cells of a row, rows of the sketch (at most four, an MD5 digest's words), characters that a keyword has at least, keywords.
WIDTH, DEPTH, LEAST_CHARS, KEYWORDS = 1 << 16, 4, 4, 5


def key_counts(text: Column, tokenizer: Tokenizer = Tokenizer()) -> Column:
    """Terms that can be keywords, with their counts: ``array<struct<term, tf>>``; empty for NULL."""
    found = F.filter(term_counts(tokenizer.tokens(F.coalesce(text, F.lit("")))), lambda t: F.length(t["term"]) >= LEAST_CHARS)
    return F.coalesce(found, F.array().cast("array<struct<term:string,tf:int>>"))


def _cells(term: Column, width: int, depth: int) -> list[Column]:
    digest = F.md5(term)
    return [F.conv(F.substring(digest, 1 + 8 * r, 8), 16, 10).cast("long") % width for r in range(depth)]


@dataclass(frozen=True)
class DocumentFrequencies:
    """A finished sketch: ``rows`` of cells as text (counts, comma between), documents counted, pairs of term and document."""

    rows: tuple[str, ...]
    documents: int
    pairs: int
    width: int

    @classmethod
    def of(cls, texts: DataFrame, text: str, tokenizer: Tokenizer = Tokenizer(), width: int = WIDTH, depth: int = DEPTH) -> DocumentFrequencies:
        """Count the documents of ``texts`` in one pass; ``depth * width`` counts reach the driver, however many documents there are."""
        if not (1 <= depth <= 4 and width >= 1):
            raise ValueError("depth must be 1 to 4, width at least 1")
        # Cell -1 counts the documents themselves, so that they are read once.
        cells = F.flatten(
            F.transform(
                key_counts(F.col(text), tokenizer), lambda t: F.array(*(c + r * width for r, c in enumerate(_cells(t["term"], width, depth))))
            )
        )
        counted = texts.select(F.explode(F.concat(F.array(F.lit(-1).cast("long")), cells)).alias("cell")).groupBy("cell").count()
        filled = dict(counted.collect())
        documents = filled.pop(-1, 0)
        rows = tuple(",".join(str(filled.get(r * width + c, 0)) for c in range(width)) for r in range(depth))
        pairs = sum(n for cell, n in filled.items() if cell < width)
        return cls(rows, documents, pairs, width)

    def error_bound(self) -> float:
        """By how much an estimate may exceed the frequency, with a probability of at least 1 - e ** -depth."""
        return math.e / self.width * self.pairs

    def estimate(self, term: Column) -> Column:
        """How many documents hold ``term``: at least as many as do."""
        rows = [F.split(F.lit(row), ",").cast("array<bigint>") for row in self.rows]
        cells = _cells(term, self.width, len(rows))
        return F.array_min(F.array(*(F.get(row, cell.cast("int")) for row, cell in zip(rows, cells, strict=True))))

    def ranked(self, text: Column, n: int = KEYWORDS, tokenizer: Tokenizer = Tokenizer()) -> Column:
        """The ``n`` best ``struct<score, term>`` of a text: count times ln((1 + documents) / (1 + estimate)), 6 digits; ties by term."""
        def scored(t: Column) -> Column:
            factor = F.log(F.lit(self.documents + 1.0) / (self.estimate(t["term"]) + 1).cast("double"))
            # A sketch may be older than the text: an estimate above its documents counts as in all of them.
            return F.struct(F.round(-t["tf"] * F.greatest(factor, F.lit(0.0)), 6).alias("low"), t["term"].alias("term"))

        best = F.slice(F.sort_array(F.transform(key_counts(text, tokenizer), scored)), 1, n)
        return F.transform(best, lambda t: F.struct((-t["low"]).alias("score"), t["term"].alias("term")))

    def keywords(self, text: Column, n: int = KEYWORDS, tokenizer: Tokenizer = Tokenizer()) -> Column:
        return bind(self.ranked(text, n, tokenizer), lambda found: F.transform(found, lambda t: t["term"]))
