"""Token counts of whole texts, as a byte-level BPE tokenizer of the ``tokenizers`` library gives them.

Method: no token crosses a pre-token, so a text has as many tokens as its pre-tokens have together. Lengths
of frequent pre-tokens are broadcast in a table of bounded size; a worker encodes each other pre-token once
and keeps its length in a bounded cache. No pre-token is ever shuffled.

The table saves time only: counts are the same with any table, or with none. It is therefore filled from a
sample of ``SAMPLE_ROWS`` rows, and holds ``TABLE_ROWS`` pre-tokens at most.

Defined results: a null text counts as empty (0 tokens, 0 bytes); added tokens of the vocabulary inside a text count
as the library counts them by default; a text with characters whose class depends on the version of Unicode
is counted by the library as a whole. Repeated rows are counted each; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import over_batches, record_batch

SAMPLE_ROWS = 20_000
TABLE_ROWS = 32_768
#: Pre-tokens that a worker remembers besides the table, and parts between spaces; each starts anew when the number is reached.
CACHE_ROWS = 500_000
#: Texts above this are walked pre-token by pre-token, without a list of them.
WALK = 200_000

#: Fixed value: the published pattern of byte-level BPE pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=1)
def _unassigned() -> re.Pattern:
    """Characters that newer versions of Unicode may put in another class than older ones."""
    spans, start = [], None
    for c in range(0x110001):
        odd = c < 0x110000 and not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) == "Cn"
        if odd and start is None:
            start = c
        elif not odd and start is not None:
            spans.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return re.compile("[" + "".join(spans) + "]")


def load(path: str):
    """The tokenizer without padding and truncation, and the strings of its added tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_padding()
    own.no_truncation()
    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    return own, described


def byte_names() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself if it shows, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (c for c in range(256) if c not in shown)
    return {c: chr(c) for c in shown} | {c: chr(256 + i) for i, c in enumerate(rest)}


_NAMES = byte_names()


def in_bytes(token: str) -> str:
    """The token in a byte-level vocabulary's spelling."""
    if token.isascii() and token.isprintable() and " " not in token:
        return token
    return token.encode().decode("latin-1").translate(_NAMES)


class _Lengths(dict):
    """Tokens of pre-tokens: the broadcast tier, and what the worker encodes, up to a bound."""

    def __init__(self, model, frequent: dict[str, int]):
        super().__init__(frequent)
        self.tokenize, self.frequent, self.odd = model.tokenize, frequent, _unassigned()

    def __missing__(self, token: str) -> int:
        if len(self) >= len(self.frequent) + CACHE_ROWS:
            self.clear()
            self.update(self.frequent)
        n = self[token] = _UNSURE if not token.isascii() and self.odd.search(token) else len(self.tokenize(in_bytes(token)))
        return n


class _Parts(dict):
    """Tokens of what follows a space up to the next one, up to a bound."""

    def __init__(self, known: _Lengths, find):
        super().__init__()
        self.known, self.find = known, find

    def __missing__(self, part: str) -> int:
        if len(self) >= CACHE_ROWS:
            self.clear()
        if not part or part[0].isspace() or part[-1].isspace():
            n = _APART
        else:
            n = sum(map(self.known.__getitem__, self.find.findall(" " + part)))
        self[part] = n
        return n


class Counts:
    """Counts tokens of texts. ``known`` starts as the broadcast tier and takes in the pre-tokens that the worker encodes.

    A single space between two other characters always begins a pre-token. Parts between such spaces recur, so their sums
    are remembered as well; a text with other white space beside a space is looked up pre-token by pre-token.
    """

    def __init__(self, path: str, frequent: dict[str, int]):
        self.own, described = load(path)
        kind = described["pre_tokenizer"] or {}
        if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or described["normalizer"]:
            raise ValueError("a vocabulary of plain byte-level BPE is needed")
        added = [x["content"] for x in described["added_tokens"]]
        self.added = added, re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or r"(?!)")
        self.find = regex.compile(PATTERN)
        self.known = _Lengths(self.own.model, frequent)
        self.parts = _Parts(self.known, self.find)

    def walked(self, text: str) -> int:
        """Tokens of a text without added tokens, pre-token by pre-token."""
        return sum(map(self.known.__getitem__, (m.group() for m in self.find.finditer(text))))

    def of(self, texts: list[str | None]) -> list[int]:
        """The number of tokens of every text."""
        counts, get = [], self.parts.__getitem__
        for t in texts:
            if not t:
                counts.append(0)
                continue
            n, special = _APART, any(x in t for x in self.added[0])
            if len(t) <= WALK and not special:
                first, *rest = t.split(" ")
                if not first[-1:].isspace() and (first or not rest):
                    n = self.walked(first) + sum(map(get, rest))
            if n < _UNSURE:
                n = sum(map(self.walked, self.added[1].split(t))) + (len(self.added[1].findall(t)) if special else 0)
            counts.append(n if n >= 0 else len(self.own.encode(t, add_special_tokens=False).ids))
        return counts


#: Stand in for lengths: the library has to count the text; it has to be walked pre-token by pre-token.
_UNSURE, _APART = -(1 << 30), -(1 << 58)


def frequent_lengths(df: DataFrame, path: str, text: str = "text", sample_rows: int = SAMPLE_ROWS, table_rows: int = TABLE_ROWS) -> dict[str, int]:
    """The broadcast tier: lengths of the pre-tokens that occur most often in a bounded sample."""
    rows = df.count()
    if not rows:
        return {}
    share = min(1.0, sample_rows / rows)

    def make():
        counts = Counts(path, {})

        def tally(batch):
            tally = Counter()
            for t in batch.column(0).to_pylist():
                if t and len(t) <= WALK and not counts.added[1].search(t):
                    tally.update(counts.find.findall(t))
            best = tally.most_common(table_rows)
            return record_batch(_TALLY, [[k for k, _ in best], [v for _, v in best]])

        return over_batches(lambda: tally)

    parts = df.select(F.col(text).alias("t")).sample(share, seed=1).mapInArrow(lambda batches: make()(batches), "token string, n long")
    best = parts.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(table_rows)
    found = Counts(path, {})
    return {row[0]: found.known[row[0]] for row in best.select("token").collect()}


_TALLY = pa.schema([("token", pa.string()), ("n", pa.int64())])


def count_tokens(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 512, **sample) -> DataFrame:
    """``key``, ``n_bytes``, ``n_tokens`` and whether the text has more than ``limit`` tokens."""
    frequent = df.sparkSession.sparkContext.broadcast(frequent_lengths(df, path, text, **sample))
    narrow = df.select(F.col(key).alias("key"), F.col(text).alias("t"))
    kind = narrow.schema["key"].dataType.simpleString()

    def make():
        counts = Counts(path, frequent.value)

        def count(batch):
            n = counts.of(batch.column(1).to_pylist())
            size = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).cast(pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n, pa.int64())], ["key", "n_bytes", "n_tokens"])

        return count

    counted = narrow.mapInArrow(over_batches(make), f"key {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
