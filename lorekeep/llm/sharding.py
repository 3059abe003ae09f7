"""Shards by jump consistent hashing, with gapless slots inside every shard.

Method (Lamping and Veach, 2014): the key seeds a linear congruential generator whose values are the
shard counts at which the key would move; the last one below the shard count is its shard. No table of
shards is kept, and with one more shard a row either stays or goes to the new shard.

Defined results: a null key counts as key 0; keys that are not integers are hashed first; rows with equal
keys share a shard. Slots follow the order of the key, rows with equal keys (repeated rows too) get
different slots. Extra columns are ignored unless they are named in ``keep``. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.llm.common import scratch
from lorekeep.operators.common import broadcast_if_small

_STEP, _TOP = np.uint64(2862933555777941757), np.float64(1 << 31)
#: Equal keys are dealt to so many ranges at most, so that one hot key is not one task.
TIE_RANGES = 64


def jump(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of every key among ``shards`` and among ``shards + 1``."""
    state = keys.astype(np.int64).view(np.uint64).copy()
    here, ahead = np.full(len(state), -1, np.int64), np.zeros(len(state), np.int64)
    open_ = np.arange(len(state))
    while open_.size:
        here[open_] = ahead[open_]
        state[open_] = state[open_] * _STEP + np.uint64(1)
        ratio = _TOP / ((state[open_] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        ahead[open_] = ((here[open_] + 1) * ratio).astype(np.int64)
        open_ = open_[ahead[open_] < shards]
    return here, np.where(ahead == shards, shards, here)


def shard_of(key: Column, shards: int) -> Column:
    """A struct of ``shard`` and ``grown_shard`` for a column of 64-bit keys."""

    @F.pandas_udf("struct<shard:int,grown_shard:int>")
    def both(keys: pd.Series) -> pd.DataFrame:
        now, grown = jump(keys.fillna(0).to_numpy(), shards)
        return pd.DataFrame({"shard": now.astype(np.int32), "grown_shard": grown.astype(np.int32)})

    return both(key)


def assign_shards(df: DataFrame, shards: int, key: str = "doc_id", keep: tuple = ()) -> DataFrame:
    """``key``, the columns of ``keep``, ``shard``, ``grown_shard`` and ``slot``.

    One exchange deals the rows into sorted ranges of (shard, key). They are written; a row's slot is its
    place in its file, plus the rows of its shard in earlier files. Only (file, shard) counts are gathered,
    of which there are as many as files and shards together.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    spark = df.sparkSession
    whole = isinstance(df.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    seed = F.coalesce(F.col(key).cast("long"), F.lit(0)) if whole else F.when(F.col(key).isNull(), 0).otherwise(F.xxhash64(key))
    names = [key, *(c for c in keep if c != key)]
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
    tie = F.pmod(F.monotonically_increasing_id(), F.lit(TIE_RANGES))
    dealt = df.select(*columns, seed.alias("seed"), tie.alias("tie")).withColumn("at", shard_of(F.col("seed"), shards))
    dealt = dealt.select(*(f"c{i}" for i in range(len(names))), "tie", "at.shard", "at.grown_shard")
    path = scratch(spark, "shards")
    dealt.repartitionByRange("shard", "c0", "tie").sortWithinPartitions("shard", "c0", "tie").write.parquet(path)
    table = spark.read.schema(dealt.schema).parquet(path).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("place"))
    runs = table.groupBy("file", "shard").agg(F.count("*").alias("rows"), F.min("place").alias("first"))
    before = Window.partitionBy("shard").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("file", "shard", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    runs, _ = broadcast_if_small(runs)
    slot = (F.col("place") + F.col("shift")).alias("slot")
    return table.join(runs, ["file", "shard"]).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), "shard", "grown_shard", slot)
