"""Document fingerprints by locally consistent parsing.

Method (Sahinalp and Vishkin; Mehlhorn, Sundar and Uhrig): a text is parsed into phrases level by level. Runs of one
symbol become one symbol; then neighbours differ, and deterministic coin tossing (the lowest bit in which a symbol
differs from the one before, and that bit) brings the alphabet below six in four rounds. A phrase starts
where the result has a local maximum, so its borders depend on a few neighbours only. The name of a phrase is a hash of
its symbols; names are the symbols of the next level. Equal passages therefore get equal names, but for a few phrases at
their ends, wherever they stand.

The fingerprint of a text is the ``SKETCH`` smallest of its distinct phrase names of level ``LEVEL``, in hexadecimal,
ascending; the likeness of two fingerprints is the share of common names among the smallest of both together, an
estimate of the Jaccard similarity of their phrases.

Defined results: null and empty texts have the empty fingerprint; two empty ones have likeness 1, an empty and another
one 0. The next row is that with the next larger (key, text hash), nulls first; after the last comes the
first, so a single row is its own next. Rows with equal keys are each processed. Extra columns are ignored.

Plan: one exchange deals the compressed texts into sorted ranges of the key. A task has its rows' successors at hand, but for its
last row; the first and the last text of every range are written beside the results and joined afterwards.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import over_batches, record_batch, slices, spread_bits, steps, stored

LEVEL = 2
SKETCH = 64
#: Texts are parsed in slices of about so many characters, whose arrays fit a processor's cache.
_SLICE = 100_000
_POWERS = np.random.default_rng(8).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _tossed(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Twice the lowest differing bit's number, and the bit; ``first`` marks symbols without one before."""
    one = x.dtype.type(1)
    differ = np.ones_like(x)
    np.bitwise_xor(x[1:], x[:-1], out=differ[1:])
    differ[first] = one
    low = np.bitwise_count((differ & (~differ + one)) - one)
    return (low << np.uint8(1)) | ((x >> low.astype(x.dtype)) & one).astype(np.uint8)


def parse(x: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: names of the phrases of ``x``, and their owners. Phrases never cross owners, which are in order."""
    fresh = np.ones(len(x), bool)
    fresh[1:] = (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(fresh)
    runs = np.diff(np.append(starts, len(x))).astype(np.uint64)
    x, owner = spread_bits(x[starts] + runs * _POWERS[0]), owner[starts]
    first = np.ones(len(x), bool)
    first[1:] = owner[1:] != owner[:-1]
    label = x
    for _ in range(4):
        label = _tossed(label, first)
    peak = np.zeros(len(x), bool)
    peak[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~first[2:]
    starts = np.flatnonzero(peak | first)
    lengths = np.diff(np.append(starts, len(x)))
    place = np.arange(len(x)) - np.repeat(starts, lengths)
    names = np.add.reduceat(x * _POWERS[place & 63], starts)
    return spread_bits(names + lengths.astype(np.uint64)), owner[starts]


def phrases(texts: list[str], level: int = LEVEL) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of that level of all texts together, and the number of the text of each."""
    sizes = np.array([len(t) for t in texts])
    x = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    for _ in range(level if len(x) else 0):
        x, owner = parse(x, owner)
    return x, owner


def sketches(texts: list[str], level: int = LEVEL, size: int = SKETCH) -> list[np.ndarray]:
    """The smallest distinct names of every text, ascending, of 32 bits each."""
    out = []
    for part in slices(texts, _SLICE):
        names, owner = phrases([texts[i] for i in part], level)
        packed = np.sort((owner.astype(np.uint64) << np.uint64(32)) | (names >> np.uint64(32)))
        packed = packed[np.append(True, packed[1:] != packed[:-1])[: len(packed)]]
        ends = np.searchsorted(packed >> np.uint64(32), np.arange(len(part) + 1, dtype=np.uint64))
        low = packed.astype(np.uint32)
        out.extend(low[a : min(b, a + size)] for a, b in zip(ends[:-1], ends[1:], strict=True))
    return out


def likeness(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> float:
    """Share of common names among the smallest of both sketches."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate((a, b)))
    again = np.append(both[1:] == both[:-1], False)
    first = np.append(True, ~again[:-1])
    return float(again[first][:size].mean())


def written(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last quarter of the text replaced by as much of the start of the following one."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def _rows(texts: list[str], following: list[str], own: list[np.ndarray], after: list[np.ndarray]) -> list[tuple]:
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    marks = sketches(changed)
    return [
        (len(t), hashlib.sha256(c.encode()).hexdigest(), written(o), written(m), likeness(o, m), likeness(o, a))
        for t, c, o, m, a in zip(texts, changed, own, marks, after, strict=True)
    ]


_FIELDS = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_COLUMNS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_WHOLE = pa.schema([*_FIELDS, ("range", pa.int32()), ("role", pa.string()), ("t", pa.string())])


def _unpacked(packed: pa.Array, sizes: list[int]) -> list[str]:
    codec = pa.Codec("zstd")
    return [codec.decompress(z.as_buffer(), n, asbytes=True).decode() for z, n in zip(packed, sizes, strict=True)]


def _along(batches):
    """Results of all rows but the range's last one, and its first and last text."""
    number, held, begun = TaskContext.get().partitionId(), None, False

    def out(keys, rows):
        columns = record_batch(_WHOLE, list(zip(*rows, strict=True)))
        return pa.RecordBatch.from_arrays([keys, *columns.columns], ["key", *_WHOLE.names])

    nothing = (None,) * len(_FIELDS)
    for batch in steps(batches):
        texts = _unpacked(batch.column(1), batch.column(2).to_pylist())
        keys = batch.column(0)
        for part in slices(texts):
            some, ids = [texts[i] for i in part], keys.slice(part.start, len(part))
            marks = sketches(some)
            if not begun:
                begun = True
                yield out(ids.slice(0, 1), [(*nothing, number, "first", some[0])])
            if held is not None:
                some, marks = [held[1], *some], [held[2], *marks]
                ids = pa.concat_arrays([held[0], ids])
            if len(some) > 1:
                rows = _rows(some[:-1], some[1:], marks[:-1], marks[1:])
                yield out(ids.slice(0, len(some) - 1), [(*row, number, "row", None) for row in rows])
            held = ids.slice(len(some) - 1, 1), some[-1], marks[-1]
    if held is not None:
        yield out(held[0], [(*nothing, number, "last", held[1])])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``."""
    narrow = df.select(F.col(key).alias("key"), F.col(text).alias("t"))
    kind = narrow.schema["key"].dataType.simpleString()

    def pack():
        codec = pa.Codec("zstd")

        def work(batch):
            held = [(t or "").encode() for t in batch.column(2).to_pylist()]
            packed = [codec.compress(t, asbytes=True) for t in held]
            columns = [pa.array(packed, pa.binary()), pa.array([len(t) for t in held], pa.int64())]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["key", "h", "z", "size"])

        return work

    packed = narrow.select("key", F.xxhash64("t").alias("h"), "t").mapInArrow(over_batches(pack), f"key {kind}, h long, z binary, size long")
    dealt = packed.repartitionByRange("key", "h").sortWithinPartitions("key", "h").select("key", "z", "size")
    table = stored(dealt.mapInArrow(_along, f"key {kind}, {_COLUMNS}, range int, role string, t string"), "fingerprints")
    names = [c.split()[0] for c in _COLUMNS.split(", ")]
    firsts = table.where("role = 'first'").select(F.col("range").alias("following"), F.col("t").alias("f"))
    order = Window.orderBy("range")
    after = table.where("role = 'first'").select("range", F.lead("range").over(order).alias("n"), F.min("range").over(Window.partitionBy()).alias("m"))
    ends = table.where("role = 'last'").select("key", "range", "t").join(after.select("range", F.coalesce("n", "m").alias("following")), "range").join(firsts, "following")

    def make():
        def work(batch):
            texts, following = ([t or "" for t in batch.column(i).to_pylist()] for i in (1, 2))
            rows = _rows(texts, following, sketches(texts), sketches(following))
            columns = record_batch(pa.schema(_FIELDS), list(zip(*rows, strict=True)))
            return pa.RecordBatch.from_arrays([batch.column(0), *columns.columns], ["key", *names])

        return work

    mended = ends.select("key", "t", "f").mapInArrow(over_batches(make), f"key {kind}, {_COLUMNS}")
    return table.where("role = 'row'").select("key", *names).unionByName(mended).withColumnRenamed("key", key)
