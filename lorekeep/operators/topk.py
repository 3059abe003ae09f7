"""Best rows per query inside a task, for scorers that run on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def best_rows(scores: np.ndarray, ids: pa.Array, pool: int) -> np.ndarray:
    """Positions of the best scores, ties by id; exact also for many equal scores."""
    if len(scores) > pool:
        floor = np.partition(scores, len(scores) - pool)[len(scores) - pool]
        kept = np.flatnonzero(scores >= floor)
    else:
        kept = np.arange(len(scores))
    candidates = pa.table({"score": scores[kept], "id": ids.take(pa.array(kept))})
    order = pc.sort_indices(candidates, [("score", "descending"), ("id", "ascending")])
    return kept[order.to_numpy()[:pool]]


class BestPerQuery:
    """Running best ``pool`` rows of every query; what a task keeps is bounded."""

    def __init__(self, names: list, ids: list[str], pool: int) -> None:
        self.names, self.ids, self.pool = names, ids, pool
        self.best: list[pa.Table | None] = [None] * len(names)
        #: Scores below a query's floor cannot be among its best any more.
        self.floors = np.full(len(names), -np.inf)

    def offer(self, query: int, scores: np.ndarray, rows: pa.Table) -> None:
        """Scores of ``rows`` (a table of id columns) for one query."""
        if len(scores) == 0:
            return
        top = best_rows(scores, rows[self.ids[0]], self.pool)
        found = rows.take(pa.array(top)).append_column("score", pa.array(scores[top]))
        held = self.best[query]
        if held is not None:
            both = pa.concat_tables([held, found])
            again = best_rows(both["score"].to_numpy(), both[self.ids[0]], self.pool)
            found = both.take(pa.array(again))
        self.best[query] = found
        if len(found) >= self.pool > 0:
            self.floors[query] = found["score"][self.pool - 1].as_py()

    def batches(self, name_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        for name, found in zip(self.names, self.best):
            if found is not None:
                column = pa.array([name] * len(found), name_type)
                yield from found.add_column(0, "query_id", column).combine_chunks().to_batches()


def query_key(data_type: T.DataType) -> tuple[T.DataType, pa.DataType]:
    """Type of query ids in Spark and in Arrow: whole numbers or text."""
    if isinstance(data_type, T.IntegralType):
        return T.LongType(), pa.int64()
    return T.StringType(), pa.string()


def hit_schema(rows: DataFrame, ids: list[str], query_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", query_type),
            *[rows.schema[i] for i in ids],
            T.StructField("score", T.DoubleType()),
        ]
    )
