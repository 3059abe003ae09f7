"""Postings in runs: what a task has counted leaves it packed, and nothing is sorted or sent across the network to store it.

A run is up to ``RUN_TEXTS`` consecutive texts of a task, ordered by length and cut into blocks. It is stored as a row per term, in the
order of terms: the places of the texts that hold it, ascending, how often each does, and the least length of those in every block. The
first row of a run, of the empty term, holds its texts. Columns: ``term, run, side, at, tf, least, texts``, where ``run`` is the number
of the first block, ``side`` the number of texts of a block, and ``at`` a place in the run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.operators.common import BROADCAST_ROWS, give_back, has_at_most, tasks_for

# A run ends with as many texts (places are 16-bit numbers), or as soon as it has as many postings.
RUN_TEXTS = 2048
RUN_POSTINGS = 1_000_000
PIECE_TEXTS = 256
# Rows and bytes of a batch that a worker gets while runs are packed or read.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20

Batches = Iterator[pa.RecordBatch]


@contextmanager
def small_batches(spark: SparkSession):
    """Bounded Arrow batches for what is run inside; the session's own bounds hold again afterwards."""
    bounds = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {name: spark.conf.get(name, None) for name in bounds}
    for name, value in bounds.items():
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A task that gives its memory back when it ends."""

    def tidy(batches: Batches) -> Batches:
        yield from run(batches)
        give_back()

    return tidy


def _places(lists: pa.ListArray, kind: type = np.int64) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(kind)


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.append(True, np.any([np.diff(c) != 0 for c in columns], axis=0)))


def _pack(held: list[pa.RecordBatch], key: str, run: int, side: int) -> pa.RecordBatch:
    whole = pa.Table.from_batches(held).combine_chunks()
    order = pc.sort_indices(whole.select(["doc_len", key]), [("doc_len", "ascending"), (key, "ascending")]).to_numpy()
    texts = whole.drop_columns(["terms"]).take(pa.array(order))
    n = len(order)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    lists = whole["terms"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    entries = lists.flatten()
    at = place[pc.list_parent_indices(lists).to_numpy()]
    coded = entries.field("term").dictionary_encode()
    words = coded.dictionary
    sort = pc.sort_indices(words).to_numpy()
    rank = np.empty(len(words), np.int64)
    rank[sort] = np.arange(len(words))
    term = rank[coded.indices.to_numpy()]
    by = np.argsort(term << 16 | at)
    term, at, tf = term[by], at[by], entries.field("tf").to_numpy(zero_copy_only=False)[by]
    length = texts["doc_len"].to_numpy()
    starts, blocks = _firsts(term), _firsts(term, at // side)
    ends = np.concatenate([[0], starts, [len(term)]])
    block_ends = np.searchsorted(blocks, ends)
    numbered = [*texts.columns, pa.array(run + np.arange(n) // side, pa.int64())]
    structs = pa.StructArray.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in numbered], [*texts.column_names, "block"])
    rows = len(words) + 1
    return pa.RecordBatch.from_pydict(
        {
            "term": pa.concat_arrays([pa.array([""], words.type), words.take(pa.array(sort))]),
            "run": pa.array(np.full(rows, run)),
            "side": pa.array(np.full(rows, side, np.int32)),
            "at": _lists(ends, at.astype(np.int16)),
            "tf": _lists(ends, tf.astype(np.int32)),
            "least": _lists(block_ends, length[at[blocks]].astype(np.int32)),
            "texts": pa.ListArray.from_arrays(pa.array(np.append(0, np.full(rows, n)), pa.int32()), structs),
        }
    )


def packed(terms: DataFrame, ids: list[str], side: int) -> DataFrame:
    """``terms`` (ids, batch, doc_len, terms) in runs, by the tasks that count them."""
    terms = terms.select(*ids, "batch", "doc_len", "terms")
    columns = [terms.schema[c] for c in (*ids, "batch", "doc_len")]
    text = T.StructType([*[T.StructField(c.name, c.dataType) for c in columns], T.StructField("block", T.LongType())])
    schema = T.StructType.fromDDL("term string, run bigint, side int, at array<smallint>, tf array<int>, least array<int>").add("texts", T.ArrayType(text))
    key = ids[0]

    def run(batches: Batches) -> Batches:
        held, texts, postings, block = [], 0, 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, min(PIECE_TEXTS, RUN_TEXTS - texts))
                held.append(piece)
                at, texts, postings = at + piece.num_rows, texts + piece.num_rows, postings + (pc.sum(pc.list_value_length(piece.column("terms"))).as_py() or 0)
                if texts >= RUN_TEXTS or postings >= RUN_POSTINGS:
                    yield _pack(held, key, block, side)
                    block += -(-texts // side)
                    held, texts, postings = [], 0, 0
        if held:
            yield _pack(held, key, block, side)

    return terms.mapInArrow(_tidy(run), schema)


def blocks_of(rows: DataFrame) -> DataFrame:
    """``term, block, max_tf, min_len, n`` of packed postings: all rows of a block and a term are in one row."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            lists = batch.column("at")
            row, at = pc.list_parent_indices(lists).to_numpy(), _places(lists)
            block = batch.column("run").to_numpy()[row] + at // batch.column("side").to_numpy()[row]
            starts = _firsts(row, block)
            tf = _places(batch.column("tf"), np.int32)
            yield pa.RecordBatch.from_pydict(
                {
                    "term": batch.column("term").take(pa.array(row[starts])),
                    "block": pa.array(block[starts], pa.int64()),
                    "max_tf": pa.array(np.maximum.reduceat(tf, starts) if len(starts) else tf, pa.int32()),
                    "min_len": batch.column("least").flatten(),
                    "n": pa.array(np.diff(starts, append=len(row)), pa.int64()),
                }
            )

    rows = rows.where("term <> ''").select("term", "run", "side", "at", "tf", "least")
    return rows.mapInArrow(_tidy(run), "term string, block long, max_tf int, min_len int, n long")


def texts_in(rows: DataFrame) -> DataFrame:
    """``run, at``, ids, ``batch, doc_len, block`` of the texts of packed postings."""
    heads = rows.where("term = ''").select("run", F.posexplode("texts").alias("at", "_text"))
    return heads.select("run", F.col("at").cast("smallint").alias("at"), "_text.*")


def only_blocks(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Packed postings (with ``segment``) of some blocks, given by ``segment, block``; few blocks leave before anything is sent."""
    keys = chosen.select("segment", "block").distinct()
    if not has_at_most(keys, BROADCAST_ROWS):
        spread = rows.select("*", F.posexplode("at").alias("_nth", "_at")).withColumn("block", F.col("run") + F.floor(F.col("_at") / F.col("side")))
        spread = spread.join(keys, ["segment", "block"], "left_semi").groupBy("segment", "run", "term").agg(
            F.sort_array(F.collect_list(F.struct("_at", F.get("tf", F.col("_nth")).alias("tf")))).alias("_p")
        )
        some = spread.select("segment", "term", "run", F.col("_p._at").alias("at"), F.col("_p.tf").alias("tf"))
        return rows.where("term = ''").select("segment", "term", "run", "at", "tf", "texts").unionByName(some, allowMissingColumns=True)
    held: dict[int, list[int]] = {}
    for r in keys.collect():
        held.setdefault(r["segment"], []).append(r["block"])
    shared = rows.sparkSession.sparkContext.broadcast({s: np.sort(np.array(b, np.int64)) for s, b in held.items()})

    def run(batches: Batches) -> Batches:
        known = shared.value
        for batch in batches:
            segment, first, side = (batch.column(c).to_numpy() for c in ("segment", "run", "side"))
            lists = batch.column("at")
            row, at = pc.list_parent_indices(lists).to_numpy(), _places(lists)
            block = first[row] + at // side[row]
            kept = np.zeros(len(row), bool)
            for s in np.unique(segment):
                if int(s) in known:
                    own = np.flatnonzero(segment[row] == s)
                    blocks = known[int(s)]
                    nth = np.minimum(np.searchsorted(blocks, block[own]), len(blocks) - 1)
                    kept[own] = blocks[nth] == block[own]
            n = np.bincount(row[kept], minlength=batch.num_rows)
            ends = np.append(0, np.cumsum(n))
            tf = _places(batch.column("tf"), np.int32)
            out = pa.RecordBatch.from_arrays(
                [batch.column("segment"), batch.column("term"), batch.column("run"), _lists(ends, at[kept].astype(np.int16)), _lists(ends, tf[kept]), batch.column("texts")],
                ["segment", "term", "run", "at", "tf", "texts"],
            )
            yield out.filter(pa.array((n > 0) | pc.equal(out.column("term"), "").to_numpy(zero_copy_only=False)))

    rows = rows.select("segment", "term", "run", "side", "at", "tf", "texts")
    return rows.mapInArrow(_tidy(run), rows.drop("side").schema)


def _transposed(run: pa.Table, ids: list[str], every: bool) -> pa.RecordBatch | None:
    """Texts of one run with their terms, in the order of terms; ``every``: also those without."""
    head = run.slice(0, 1)
    texts = head["texts"].combine_chunks()
    texts = (texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts).flatten()
    lists = pa.chunked_array(run["at"]).combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    row, at = pc.list_parent_indices(lists).to_numpy(), _places(lists)
    tf = np.concatenate([_places(c, np.int32) for c in run["tf"].chunks])
    order = np.argsort(at, kind="stable")
    counts = np.bincount(at, minlength=len(texts))
    words = run["term"].combine_chunks()
    words = (words.chunk(0) if isinstance(words, pa.ChunkedArray) else words).take(pa.array(row[order]))
    terms = pa.StructArray.from_arrays([words, pa.array(tf[order])], ["term", "tf"])
    kept = np.ones(len(texts), bool) if every else counts > 0
    gone = head["gone"][0].as_py() if "gone" in run.column_names else None
    kept[np.array(gone or [], np.int64)] = False
    if not kept.any():
        return None
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), terms)
    names = [*ids, "batch", "doc_len"]
    found = pa.RecordBatch.from_arrays([*(texts.field(c) for c in names), lists], [*names, "terms"])
    return found.filter(pa.array(kept))


def by_text(batches: Batches, ids: list[str], every: bool) -> Batches:
    """Texts with their terms from packed postings that come run by run, each with its texts first."""
    held, last = [], None

    def ended() -> Batches:
        found = _transposed(pa.Table.from_batches(held), ids, every) if held else None
        return () if found is None else (found,)

    for batch in batches:
        segment, run = batch.column("segment").to_numpy(), batch.column("run").to_numpy()
        starts = _firsts(segment, run)
        for start, end in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
            name = segment[start], run[start]
            if name != last:
                yield from ended()
                held, last = [], name
            held.append(batch.slice(start, end - start))
    yield from ended()


def over_runs(rows: DataFrame, n: int, work: Callable[[Batches], Batches], schema) -> DataFrame:
    """``work`` on packed postings whose runs are whole, in the order of terms; there are about ``n`` postings."""
    dealt = rows.repartition(tasks_for(rows.sparkSession, n), "segment", "run").sortWithinPartitions("segment", "run", "term")
    return dealt.mapInArrow(_tidy(work), schema)


def texts_with_terms(rows: DataFrame, n: int, ids: list[str]) -> DataFrame:
    """``ids, batch, doc_len, terms`` of all texts of packed postings (with ``segment``)."""
    text = rows.schema["texts"].dataType.elementType
    terms = T.StructType.fromDDL("terms array<struct<term: string, tf: int>>")
    schema = T.StructType([*[text[c] for c in (*ids, "batch", "doc_len")], *terms])
    rows = rows.select("segment", "run", "term", "at", "tf", "texts")
    return over_runs(rows, n, lambda batches: by_text(batches, ids, True), schema)
