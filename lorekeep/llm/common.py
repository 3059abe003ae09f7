"""What several operators of this folder share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lorekeep.operators.common import give_back, shared_folder

#: Texts are worked on in slices of about so many characters, which bounds what a worker holds besides its batch.
SLICE_CHARS = 1_000_000

#: Rows of an Arrow batch that are worked on at once; results leave the worker in such steps.
STEP_ROWS = 1000


def small_batches(spark: SparkSession, max_bytes: int | None = None) -> None:
    """Arrow batches of as many rows in this session, and bytes if given, so that long texts do not fill workers and buffers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(STEP_ROWS))
    if max_bytes is not None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(max_bytes))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all executors share."""
    return f"{shared_folder(spark)}/lorekeep-llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written to the shared folder and read again, so that lost executors cost no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(texts: list, limit: int = SLICE_CHARS) -> Iterator[range]:
    """Ranges of consecutive texts of at most ``limit`` characters, or of one longer text."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > start and held + n > limit:
            yield range(start, i)
            start, held = i, 0
        held += n
    if start < len(texts):
        yield range(start, len(texts))


def steps(batches, rows: int = STEP_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def over_batches(make: Callable) -> Callable:
    """For mapInArrow: ``make()`` runs once in each task and returns a function from a batch to arrays or a batch."""

    def run(batches):
        work = make()
        for batch in steps(batches):
            out = work(batch)
            if out is not None and out.num_rows:
                yield out
        del work
        give_back()

    return run


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def spread_bits(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
