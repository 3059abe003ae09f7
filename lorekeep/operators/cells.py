"""Exact nearest neighbours without reading every vector: cells with radii, pruned by the triangle inequality.

Unit vectors are dealt to the nearest of some centres, which k-means finds on a bounded sample. A cell's radius is the distance of its
farthest vector from the centre, so no vector of the cell is nearer to a query than the distance of the centre less the radius; for unit
vectors that bounds the cosine. The best cells of a query are read first; of the others only those whose bound reaches the score of the
last row found so far. The result is that of :func:`lorekeep.operators.nearest.knn_search`; the centres decide only how much is read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lorekeep.operators.common import materialize, top_per_group
from lorekeep.operators.nearest import SCORE_DIGITS, _unit_rows
from lorekeep.operators.topk import BestPerQuery, hit_schema, query_key

SAMPLE_ROWS = 20_000
MAX_CELLS = 1024
ROUNDS = 8
#: So many times the pool of vectors are read first.
FIRST_ROWS = 4
#: Queries per pass; the bounds of a pass are a matrix of queries x cells.
QUERY_BLOCK = 1024


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (rows**2).sum(axis=1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(axis=1)[None, :]
    return np.sqrt(np.maximum(square, 0))


def find_centres(sample: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """k-means on a sample of unit vectors; at most ``cells`` distinct centres."""
    distinct = np.unique(sample, axis=0)
    picked = np.random.default_rng(seed).choice(len(distinct), min(cells, len(distinct)), replace=False)
    centres = distinct[np.sort(picked)]
    for _ in range(ROUNDS):
        nearest = _distances(sample, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        counts = np.bincount(nearest, minlength=len(centres))
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


@dataclass(frozen=True)
class Cells:
    """Vectors of one dimension below ``path/cell=...``, and of every cell that has any the radius and the number of vectors."""

    spark: SparkSession
    path: str
    ids: tuple[str, ...]
    centres: np.ndarray
    radius: np.ndarray
    size: np.ndarray
    schema: StructType  # a table of no vectors has no files to tell it

    @staticmethod
    def build(vectors: DataFrame, ids: list[str], vector: str, dim: int, path: str, cells: int | None = None) -> Cells:
        spark = vectors.sparkSession
        fitting = vectors.where(F.col(vector).isNotNull() & (F.size(vector) == dim)).select(*ids, F.col(vector).alias("vector"))
        n = fitting.count()
        share = min(1.0, SAMPLE_ROWS / max(n, 1))
        sample = fitting.select("vector").sample(share, seed=7).limit(2 * SAMPLE_ROWS).toArrow()["vector"]
        rows = _unit_rows(sample.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))
        rows = rows if len(rows) else np.zeros((1, dim))
        centres = find_centres(rows, cells or max(1, min(MAX_CELLS, int(n**0.5))))
        shared = spark.sparkContext.broadcast(centres)

        def deal(batches):
            for batch in batches:
                if batch.num_rows:
                    own = _unit_rows(batch.column(len(ids)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, dim))
                    far = _distances(own, shared.value)
                    cell = far.argmin(axis=1)
                    columns = [*batch.columns, pa.array(far[np.arange(len(cell)), cell]), pa.array(cell.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, [*ids, "vector", "far", "cell"])

        schema = hit_fields(fitting, ids)
        dealt = fitting.mapInArrow(deal, f"{schema}, vector {fitting.schema['vector'].dataType.simpleString()}, far double, cell int")
        # Ranges over cell and id: a cell that holds a third of all vectors is written by many tasks.
        dealt.repartitionByRange("cell", ids[0]).sortWithinPartitions("cell", ids[0]).write.mode("overwrite").partitionBy("cell").parquet(path)
        stored = spark.read.schema(dealt.schema).parquet(path)
        found = stored.groupBy("cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).collect()  # a row per cell
        radius, size = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
        for r in found:
            radius[r["cell"]], size[r["cell"]] = r["radius"], r["n"]
        return Cells(spark, path, tuple(ids), centres, radius, size, dealt.schema)

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Cosine that no vector of a cell exceeds, queries x cells; -inf where a cell is empty."""
        gap = np.maximum(_distances(queries, self.centres) - self.radius - 1e-7, 0)
        return np.where(self.size > 0, 1 - gap**2 / 2, -np.inf)

    def _scan(self, names: list, matrix: np.ndarray, chosen: np.ndarray, key, pool: int) -> DataFrame:
        """Best rows of every task; ``chosen``: which cells each query reads. Other cells are not read at all."""
        stored = self._stored()
        ids = list(self.ids)
        spark_key, arrow_key = query_key(key)
        wanted = {int(c): np.flatnonzero(chosen[:, c]) for c in np.flatnonzero(chosen.any(axis=0))}
        shared = self.spark.sparkContext.broadcast((names, matrix, wanted))

        def scan(batches):
            names, matrix, wanted = shared.value
            best = BestPerQuery(names, ids, pool)
            for batch in batches:
                cells = batch.column(len(ids) + 1)
                for cell in pc.unique(cells).to_pylist():
                    part = batch.filter(pc.equal(cells, cell))
                    flat = part.column(len(ids)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    asked = wanted[cell]
                    scores = np.round(_unit_rows(flat.reshape(part.num_rows, matrix.shape[1])) @ matrix[asked].T, SCORE_DIGITS)
                    held = pa.table({i: part.column(n) for n, i in enumerate(ids)})
                    for n, q in enumerate(asked):
                        best.offer(int(q), scores[:, n], held)
            yield from best.batches(arrow_key)

        read = stored.where(F.col("cell").isin(sorted(wanted))).select(*ids, "vector", "cell")
        return read.mapInArrow(scan, hit_schema(stored, ids, spark_key))

    def search(self, queries: DataFrame, pool: int) -> tuple[DataFrame, dict[str, float]]:
        """As ``knn_search`` for queries of this dimension, and the share of vectors and of cells that each query read on average."""
        usable = queries.where(F.col("vector").isNotNull() & (F.size("vector") == self.centres.shape[1])).select("query_id", "vector")
        key = usable.schema["query_id"].dataType
        order = [F.desc("score"), F.asc(self.ids[0])]
        n = -(-usable.count() // QUERY_BLOCK)
        found, read, cells, asked = None, 0, 0, 0
        for block in range(n):
            rows = usable.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == block).collect() if n > 1 else usable.collect()
            if not rows:
                continue
            names, matrix = [r["query_id"] for r in rows], _unit_rows(np.array([r["vector"] for r in rows], np.float64))
            bounds = self.bounds(matrix)
            best_first = np.argsort(-bounds, axis=1, kind="stable")
            before = np.cumsum(self.size[best_first], axis=1) - self.size[best_first]
            chosen = np.zeros(bounds.shape, bool)
            np.put_along_axis(chosen, best_first, before < FIRST_ROWS * pool, axis=1)
            chosen &= bounds > -np.inf
            first = materialize(top_per_group(self._scan(names, matrix, chosen, key, pool), ["query_id"], order, pool).drop("rank"))
            reached = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= pool, F.min("score")).alias("least")).collect()  # a row per query
            least = {r["query_id"]: r["least"] for r in reached}
            floor = np.array([-np.inf if least.get(q) is None else least[q] for q in names])
            more = ~chosen & (bounds > -np.inf) & (bounds + 10.0**-SCORE_DIGITS >= floor[:, None])
            hits = first if not more.any() else first.unionByName(self._scan(names, matrix, more, key, pool))
            hits = materialize(top_per_group(hits, ["query_id"], order, pool))
            found = hits if found is None else found.unionByName(hits)
            read += int(((chosen | more) * self.size).sum())
            cells += int((chosen | more).sum())
            asked += len(names)
        if found is None:
            stored = self._stored()
            found = top_per_group(self.spark.createDataFrame([], hit_schema(stored, list(self.ids), query_key(key)[0])), ["query_id"], order, pool)
        share = {"vectors": read / max(1, asked * int(self.size.sum())), "cells": cells / max(1, asked * int((self.size > 0).sum()))}
        return found, share


def hit_fields(df: DataFrame, ids: list[str]) -> str:
    return ", ".join(f"`{i}` {df.schema[i].dataType.simpleString()}" for i in ids)
