"""Packing by concatenation and cutting: all documents' tokens in one row, cut into sequences of one length.

Method: the first pass encodes every document and writes its ids with its offset inside the task that encoded
it. Token totals per task (one row each) are summed up to the offset of every task; offset plus local offset
is a document's place in the whole. The second pass cuts at multiples of the sequence length. A document
that crosses a border becomes several pieces (boundary records), in consecutive sequences. Only the last
sequence may need padding. Nothing but task totals is gathered.

Defined results: a null or empty text is the end id alone; every row is packed, repeated ones too; extra
columns are ignored. Texts may have any length.

Encoding: no token of the vocabulary covers white space, so a text is split there and each distinct part is
encoded once per worker (bounded cache). A part of Latin letters, digits and ASCII signs is cut into the vocabulary's
words, whose merges the library's model does (another bounded cache); the library encodes every other part as a whole, and
texts with added tokens or with control characters that only Python counts as white space.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import over_batches, record_batch, stored
from lorekeep.llm.tokencounts import in_bytes, load
from lorekeep.operators.common import broadcast_if_small

SEQUENCE = 4096
END_ID = 2
#: Bytes of parts and of words, with their ids, that a worker remembers (each).
CACHE_BYTES = 96_000_000
#: What an entry takes besides its text and ids.
_ENTRY = 200
#: Characters whose lower case and composition no version of Unicode changes; words of them under the vocabulary's pattern.
_SIMPLE = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


class _Remembered(dict):
    """Ids as bytes by text, in two generations of bounded size.

    A full younger generation becomes the older one, and what is met again moves up, so that frequent
    texts stay while the others go.
    """

    def __init__(self, work, limit: int | None = None):
        super().__init__()
        self.work, self.limit, self.older, self.held = work, limit or CACHE_BYTES, {}, 0

    def __missing__(self, text: str) -> bytes:
        ids = self.older.get(text)
        if ids is None:
            ids = self.work(text)
        size = _ENTRY + len(text) + len(ids)
        if size > self.limit // 2:
            return ids
        if self.held + size > self.limit // 2:
            self.older = dict(self)
            self.clear()
            self.held = 0
        self.held += size
        self[text] = ids
        return ids


class Encoder:
    """Ids of texts under a vocabulary that drops white space."""

    def __init__(self, path: str, end_id: int, cache_bytes: int | None = None):
        self.own, described = load(path)
        split = str(described["pre_tokenizer"])
        if "'invert': True" not in split or "Removed" not in split:
            raise ValueError("a vocabulary that drops white space between words is needed")
        self.whole = [*(x["content"] for x in described["added_tokens"]), "\x1c", "\x1d", "\x1e", "\x1f"]
        self.end = array("I", [end_id]).tobytes()
        self.words, self.parts = _Remembered(self._word, cache_bytes), _Remembered(self._part, cache_bytes)

    def _word(self, word: str) -> bytes:
        return array("I", [t.id for t in self.own.model.tokenize(in_bytes(word))]).tobytes()

    def _part(self, part: str) -> bytes:
        if _SIMPLE.fullmatch(part):
            return b"".join(map(self.words.__getitem__, _WORDS.findall(part.lower())))
        return array("I", self.own.encode(part, add_special_tokens=False).ids).tobytes()

    def of(self, texts: list[str | None]) -> list[bytes]:
        """The ids of every text and the end id, as little-endian unsigned 32-bit numbers."""
        out, get = [], self.parts.__getitem__
        for text in texts:
            if not text:
                out.append(self.end)
            elif any(x in text for x in self.whole):
                out.append(array("I", self.own.encode(text, add_special_tokens=False).ids).tobytes() + self.end)
            else:
                out.append(b"".join(map(get, text.split())) + self.end)
        return out


@lru_cache(maxsize=1)
def encoder_of(path: str, end_id: int, cache_bytes: int | None = None) -> Encoder:
    """One encoder per worker process: its tasks share vocabulary and caches."""
    return Encoder(path, end_id, cache_bytes)


_ENCODED = "key {kind}, task int, local long, n long, ids binary"
_PIECES = pa.schema([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def encoded(df: DataFrame, path: str, key: str, text: str, end_id: int, cache_bytes: int | None = None) -> DataFrame:
    """Written table of ids with their offset inside the task that encoded them."""
    narrow = df.select(F.col(key).alias("key"), F.col(text).alias("t"))

    def make():
        encoder, task, sofar = encoder_of(path, end_id, cache_bytes), TaskContext.get().partitionId(), 0
        wide = encoder.own.get_vocab_size() > 65536

        def work(batch):
            nonlocal sofar
            ids = encoder.of(batch.column(1).to_pylist())
            n = np.array([len(x) // 4 for x in ids], np.int64)
            local = sofar + np.cumsum(n) - n
            sofar += int(n.sum())
            if not wide:
                ids = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), task, np.int32)), pa.array(local), pa.array(n), pa.array(ids, pa.binary())], ["key", "task", "local", "n", "ids"])

        return work

    kind = narrow.schema["key"].dataType.simpleString()
    return stored(narrow.mapInArrow(over_batches(make), _ENCODED.format(kind=kind)), "packing", compression="zstd")


def pack(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = SEQUENCE, end_id: int = END_ID, ids: bool = False, cache_bytes: int | None = None) -> DataFrame:
    """One row per piece: ``key``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``; with ``ids``, the ids too."""
    table = encoded(df, path, key, text, end_id, cache_bytes)
    kind = table.schema["key"].dataType.simpleString()
    totals = table.groupBy("task").agg(F.max(F.col("local") + F.col("n")).alias("total"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases, _ = broadcast_if_small(totals.select("task", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")))
    placed = table.join(bases, "task").select("key", (F.col("base") + F.col("local")).alias("at"), "n", "ids")
    schema = pa.schema([*_PIECES, *([("ids", pa.list_(pa.int64()))] if ids else [])])

    def make():
        def work(batch):
            at, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            rows, owner = [], []
            for i, held in enumerate(batch.column(3).to_pylist()):
                own = np.frombuffer(held, "<u2" if len(held) == 2 * n[i] else "<u4").astype("<u4")
                start = 0
                while start < n[i]:
                    sequence, offset = divmod(int(at[i]) + start, length)
                    size = min(int(n[i]) - start, length - offset)
                    piece = own[start : start + size]
                    row = (start, size, zlib.crc32(piece.tobytes()), int(n[i]), sequence, offset)
                    rows.append((*row, piece.tolist()) if ids else row)
                    owner.append(i)
                    start += size
            pieces = record_batch(schema, list(zip(*rows, strict=True)))
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), *pieces.columns], ["key", *schema.names])

        return work

    fields = f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<long>" if ids else "")
    return placed.mapInArrow(over_batches(make), fields).withColumnRenamed("key", key)
