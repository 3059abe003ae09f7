"""Small helpers that keep physical plans in shape."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A side with more rows than this is never broadcast.
BROADCAST_ROWS = 200_000
# Narrow rows (postings, scores) that a task sorts or groups.
TASK_ROWS = 2_000_000


def unnest(df: DataFrame, keep: list[str], array: Column, alias: str = "_item") -> DataFrame:
    """One row per array element, as ``keep`` plus the element's fields.

    The outer form is used on purpose: the inner form makes the optimizer infer
    a ``size(array) > 0`` filter, which would evaluate a costly array expression
    a second time below the next exchange.
    """
    rows = df.select(*keep, F.explode_outer(array).alias(alias))
    return rows.where(F.col(alias).isNotNull()).select(*keep, f"{alias}.*")


def unnest_values(df: DataFrame, keep: list[str], array: Column, name: str) -> DataFrame:
    """One row per element of an array of plain values."""
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def spread(df: DataFrame) -> DataFrame:
    """Use every core for a costly row-wise step over a scan with few splits.

    A no-op as soon as the scan has as many splits as there are cores, which
    is always the case at scale. Call it on plain scans only.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def is_one_of(column: str, values: list) -> Column:
    """``column IN (values)`` built in one call, however many values there are."""
    if not values or not all(isinstance(v, str) for v in values):
        return F.col(column).isin(values)
    quoted = ("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
    return F.expr(f"`{column}` IN ({', '.join(quoted)})")


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Partitions of about ``TASK_ROWS`` rows, at least one per core: more rows make more tasks, not larger ones."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def dealt(df: DataFrame, rows: int, key: str) -> DataFrame:
    """By key to the tasks that ``rows`` rows need; where one is enough, Spark may merge partitions."""
    return df.repartition(key) if rows <= TASK_ROWS else df.repartition(tasks_for(df.sparkSession, rows), key)


def give_back() -> None:
    """Return what a finished task has freed to the system: workers go on to other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def has_at_most(df: DataFrame, rows: int) -> bool:
    return df.select(F.lit(1)).limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Hint a broadcast only after counting that the side is within the bound."""
    small = has_at_most(df, rows)
    return (F.broadcast(df) if small else df), small


def top_per_group(
    df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """The first ``n`` rows of every group with a 0-based rank.

    Filtering on the row number lets Spark cut every group to ``n`` rows before
    the exchange, so a group that holds most of the rows stays cheap.
    """
    position = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return (
        df.withColumn(rank, position)
        .where(F.col(rank) <= n)
        .withColumn(rank, F.col(rank) - 1)
    )


def join_with_hot_keys(
    left: DataFrame, right: DataFrame, key: str, how: str, hot_rows: int = 1_000_000
) -> DataFrame:
    """Join many rows to a side that is unique by ``key`` without a hot task.

    Keys with more than ``hot_rows`` left rows are joined by broadcasting their
    (single) right rows: there are at most ``rows / hot_rows`` such keys. All
    other keys go through an ordinary shuffled join.
    """
    counts = left.groupBy(key).count().where(F.col("count") > hot_rows).select(key)
    hot = [r[0] for r in counts.collect()]
    if not hot:
        return left.join(right, key, how)
    is_hot = is_one_of(key, hot)
    return (
        left.where(is_hot)
        .join(F.broadcast(right.where(is_hot)), key, how)
        .unionByName(left.where(~is_hot | F.col(key).isNull()).join(right, key, how))
    )


def shared_folder(spark: SparkSession, fallback: str | None = None) -> str:
    """Folder for intermediate tables that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a
    caller's own shared folder is used; a local session may fall back to a
    temporary folder, a cluster may not.
    """
    named = (
        spark.conf.get("spark.checkpoint.dir", None)
        or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        or fallback
    )
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_scratch()


@lru_cache(maxsize=1)
def _local_scratch() -> str:
    folder = tempfile.mkdtemp(prefix="lorekeep-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def materialize(df: DataFrame, fallback: str | None = None) -> DataFrame:
    """Write once, read back: for results that several plans use.

    Unlike a cache, the written table survives the loss of executors. Texts repeat in it, so it is packed tightly.
    """
    path = f"{shared_folder(df.sparkSession, fallback)}/lorekeep/{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)
