"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Every source is a queue of its documents in a shuffled order, which starts again from the front up to ``max_repeats`` times. A document
that leaves the queue after ``x`` of its source's tokens have its virtual finish time ``x / target``: sources advance side by side in
proportion to their targets. All queued documents, whatever their source, are sorted by finish time over ranges and the mix is the
beginning of that order, up to the total budget.

Targets share ``share`` of all tokens in proportion to the weights. No target exceeds ``max_repeats`` times its source's tokens; what is above is
shared among the others by weight until none is above. Sources take the weights in turn, in the order of their code points, null last.

Whole documents are taken, each at most ``max_repeats`` times. All items that finish by time 1 are in the mix, so a source falls short of its
target by less than its largest document; what that leaves of the budget goes on in the same proportions, so a source exceeds its target by at most
its share of the sum of every source's largest document. The order within a source depends on ids (their MD5), then sizes only, so reruns agree on all but
which of several equal rows is taken. Null texts have no tokens; texts without tokens take part with zero. Null sources are one
source. Null and repeated ids are rows of their own. An empty table gives an empty mix. Other columns are not read.

Prefix sums take two passes: sums of ranges, whose starts are added up over as many rows as there are ranges, then sums within each range.
A source that holds most rows is spread over many ranges; nothing is grouped by source but its sums.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import stored
from lorekeep.operators.common import broadcast_if_small

#: A token is a run of characters other than these.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3


def running_totals(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """``df`` with inclusive running totals: ``sums`` maps a column to the name of its total over the order.

    The order must be total up to exchangeable rows. One range exchange, one exchange by range number.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = ranged.groupBy("_part").agg(*[F.sum(v).alias(f"_of_{t}") for v, t in sums.items()])
    starts = totals.select("_part", *[F.coalesce(F.sum(f"_of_{t}").over(before), F.lit(0)).alias(f"_from_{t}") for t in sums.values()])
    joined = ranged.join(F.broadcast(starts), "_part")  # one row per range
    return joined.select(*df.columns, *[(F.col(f"_from_{t}") + F.sum(v).over(within)).alias(t) for v, t in sums.items()])


def shuffle_key(doc: Column) -> Column:
    """60 bits of the MD5 of an id as text: a shuffled order that any engine can repeat."""
    digest = F.md5(F.coalesce(doc.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...], share: float, max_repeats: int) -> DataFrame:
    """``source, source_size, source_from, target`` of ``source, size`` rows; ``source_from``: tokens of all sources before it."""
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1))
    ranked = running_totals(per_source, [F.asc_nulls_last("source")], {"one": "rank", "source_size": "through"})
    turn = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    most = max_repeats * F.col("source_size")
    weighted = ranked.select(
        "source", "source_size", (F.col("through") - F.col("source_size")).alias("source_from"), turn.alias("weight"), most.alias("most"), (most / turn).alias("ratio")
    )
    # Those with the least room for their weight reach their limit first.
    filled = stored(running_totals(weighted, [F.asc("ratio"), F.asc_nulls_last("source")], {"weight": "weights", "most": "mosts"}), "sources")
    every = filled.agg(F.sum("weight").alias("weight"), F.sum("source_size").alias("size")).first()
    budget = share * (every["size"] or 0)
    left = F.lit(budget) - (F.col("mosts") - F.col("most"))
    filled = filled.withColumn("full", F.col("most") * (F.lit(every["weight"] or 0.0) - (F.col("weights") - F.col("weight"))) <= F.col("weight") * left)
    full = filled.where("full").agg(F.sum("weight").alias("weight"), F.sum("most").alias("most")).first()
    room = (every["weight"] or 0.0) - (full["weight"] or 0.0)
    level = (budget - (full["most"] or 0)) / room if room > 0 else 0.0
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return filled.select("source", "source_size", "source_from", target.alias("target"))


@dataclass(frozen=True)
class Mix:
    """``queue``: a row per document, ``items``: a row per document and repeat, in the order of virtual finish times.

    The mix ends with the item at (``finish``, ``through``), or is empty.
    """

    queue: DataFrame
    items: DataFrame
    max_repeats: int
    finish: float | None
    through: int | None

    def _is_taken(self, finish: Column) -> Column:
        if self.finish is None:
            return F.lit(False)
        return (finish < self.finish) | ((finish == self.finish) & (F.col("through") <= self.through))

    def taken(self) -> DataFrame:
        """``doc_id, size, source_size, target, taken``: tokens taken of every document, repeats counted."""
        times = sum((F.when(self._is_taken(_finish(F.lit(e))), 1).otherwise(0) for e in range(self.max_repeats)), F.lit(0))
        taken = F.when((F.col("size") > 0) & (F.col("target") > 0), F.col("size") * times).otherwise(F.lit(0))
        return self.queue.select(F.col("doc").alias("doc_id"), "size", "source_size", "target", taken.cast("long").alias("taken"))

    def schedule(self) -> DataFrame:
        """``doc, source, size, repeat, finish, mixed`` of the mix; ``mixed``: tokens up to and with the item. Sorted over ranges."""
        mine = self.items.where(self._is_taken(F.col("finish")))
        return mine.select("doc", "source", "size", "repeat", "finish", "mixed").orderBy("mixed")


def _finish(repeat: Column) -> Column:
    return (repeat * F.col("source_size") + F.col("within")).cast("double") / F.col("target")


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.0,
    max_repeats: int = MAX_REPEATS,
) -> Mix:
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    sized = stored(
        docs.select(F.col(key).alias("doc"), F.col(source).alias("source"), size.alias("size"), shuffle_key(F.col(key)).alias("shuffled"), F.monotonically_increasing_id().alias("tie")),
        "sizes",
    )
    targets = source_targets(sized, weights, share, max_repeats)
    few = broadcast_if_small(targets)[0]
    known = sized.join(few.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    order = [F.asc_nulls_last("source"), F.asc("shuffled"), F.asc("doc"), F.asc("size"), F.asc("tie")]
    queue = running_totals(known, order, {"size": "through"}).withColumn("within", F.col("through") - F.col("source_from"))
    queue = stored(queue.drop("shuffled", "tie", "source_from"), "queue")

    repeats = F.least(F.lit(max_repeats), F.ceil(F.col("target") / F.col("source_size")) + 1).cast("int")
    queued = queue.where((F.col("size") > 0) & (F.col("target") > 0)).withColumn("repeat", F.explode(F.sequence(F.lit(0), repeats - 1)))
    items = queued.select("doc", "source", "size", "repeat", "through", _finish(F.col("repeat")).alias("finish"))
    # `through` differs for all documents with tokens, so the order has no ties.
    items = running_totals(items, [F.asc("finish"), F.asc("through")], {"size": "mixed"})
    budget = share * (queue.agg(F.sum("size")).first()[0] or 0)
    last = items.where(F.col("mixed") <= budget).agg(F.max(F.struct("finish", "through")).alias("last")).first()["last"]
    return Mix(queue, items, max_repeats, *(last or (None, None)))
