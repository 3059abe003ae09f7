"""Exact cosine nearest neighbours.

Vectors stay partitioned where they are. Every task multiplies its Arrow
batches with the matrix of query vectors and keeps only the best rows per
query, so what leaves a task is ``queries x pool`` rows, whatever it read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.operators.common import has_at_most, materialize, top_per_group
from lorekeep.operators.topk import BestPerQuery, hit_schema, query_key

SCORE_DIGITS = 8
# Queries per pass over the vectors; larger sets are answered in several passes.
QUERY_BLOCK = 4096


def cosine(left: str, right: str):
    """Cosine similarity of two array columns in double precision (per row)."""
    dot = lambda x, y: F.aggregate(
        F.zip_with(F.col(x), F.col(y), lambda a, b: a.cast("double") * b.cast("double")),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )
    return dot(left, right) / F.sqrt(dot(left, left) * dot(right, right))


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _scan(
    vectors: DataFrame, ids: list[str], vector: str, block: list, key: T.DataType, pool: int
) -> DataFrame:
    """Best rows of every partition for a block of queries of one dimension."""
    spark_key, arrow_key = query_key(key)
    dim = len(block[0]["vector"])
    names = [r["query_id"] for r in block]
    matrix = vectors.sparkSession.sparkContext.broadcast(
        _unit_rows(np.array([r["vector"] for r in block], dtype=np.float64))
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = matrix.value
        best = BestPerQuery(names, ids, pool)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            flat = batch.column(len(ids)).flatten().to_numpy(zero_copy_only=False)
            rows = _unit_rows(flat.astype(np.float64).reshape(batch.num_rows, dim))
            scores = np.round(rows @ queries.T, SCORE_DIGITS)
            held = pa.table({i: batch.column(n) for n, i in enumerate(ids)})
            for q in range(len(queries)):
                best.offer(q, scores[:, q], held)
        yield from best.batches(arrow_key)

    fitting = vectors.where(F.col(vector).isNotNull() & (F.size(vector) == dim))
    return fitting.select(*ids, vector).mapInArrow(scan, hit_schema(vectors, ids, spark_key))


def knn_search(
    vectors: DataFrame, ids: list[str], vector: str, queries: DataFrame, pool: int
) -> DataFrame:
    """Best ``pool`` vectors per query: ``query_id, ids, score, rank``.

    ``queries`` holds ``query_id, vector``. Rows without a vector on either
    side take no part, nor do vectors of another dimension than the query's. The
    score is the cosine similarity, i.e. one minus the cosine distance.
    """
    usable = queries.where(F.col("vector").isNotNull()).select("query_id", "vector")
    key = usable.schema["query_id"].dataType
    blocks = [usable]
    if not has_at_most(usable, QUERY_BLOCK):
        n = -(-usable.count() // QUERY_BLOCK) * 2
        hashed = F.pmod(F.xxhash64("query_id"), F.lit(n))
        blocks = [usable.where(hashed == i) for i in range(n)]

    found = []
    for block in blocks:
        rows = block.collect()
        for dim in sorted({len(r["vector"]) for r in rows}):
            group = [r for r in rows if len(r["vector"]) == dim]
            hits = _scan(vectors, ids, vector, group, key, pool)
            # Of several blocks the driver holds one: its hits are written before the next is read.
            found.append(hits if len(blocks) == 1 else materialize(hits))
    if not found:
        nothing = hit_schema(vectors, ids, query_key(key)[0])
        found = [vectors.sparkSession.createDataFrame([], nothing)]
    hits = reduce(DataFrame.unionByName, found)
    return top_per_group(hits, ["query_id"], [F.desc("score"), F.asc(ids[0])], pool)
