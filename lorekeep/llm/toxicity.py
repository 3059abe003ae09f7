"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Method (Wang and Manning, 2012): a text has the binary features of its distinct n-grams of 3 to 5 characters (lower
case, white space folded), hashed to ``2 ** BITS`` numbers. Each feature is scaled by the log ratio of its smoothed
shares among toxic and other training texts; logistic regression on the scaled features gives the
probability. Only the ``SELECTED`` features whose counts speak most clearly for either class enter the
regression.

Training rows: labelled rows that are not held out, at most ``TRAIN_ROWS`` of them, chosen by a hash of the id. Nothing
but their texts and labels is learnt from. The model is a table of fixed size; texts are scored where they are read,
whatever their length, and never shuffled.

Defined results: null and empty texts get the score of a text without features; null labels are no labels;
of several labels of one id the highest counts; without training rows of both classes every score is the share of toxic
training rows (0 without any). Repeated rows are scored each; extra columns are ignored or, in ``keep_clean``, carried.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import over_batches, slices, steps, stored

BITS = 18
ORDERS = (3, 4, 5)
SELECTED = 8192
TRAIN_ROWS = 20_000
MIN_TEXTS = 3
SMOOTHING = 1.0
REGULARISATION = 2e-4
LIMIT = 0.3
#: Texts are worked on in slices of about so many characters, whose arrays stay small.
_SLICE = 100_000
_GAP = "\0" * (max(ORDERS) - 1)
_KEYS = np.random.default_rng(9).integers(1, 1 << 63, max(ORDERS), dtype=np.uint64) | np.uint64(1)


def hashed(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order, the feature of every n-gram of the texts and the number of its text."""
    folded = [_GAP + " ".join((t or "").lower().split()) for t in texts]
    joined = "".join(folded) + _GAP
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(t) for t in folded])
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    mixed = [points * k for k in _KEYS]
    out = []
    rolling = mixed[0] + np.uint64(0)
    for n in range(2, max(ORDERS) + 1):
        rolling = rolling[:-1] + mixed[n - 1][n - 1 :]
        if n in ORDERS:
            grams = rolling + np.uint64(n)
            grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append(((grams >> np.uint64(64 - BITS)).astype(np.int32)[: len(owner)], owner[: len(grams)]))
    return out


def distinct_features(texts: list[str | None], chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of every distinct feature of every text, of the ``chosen`` ones only if given."""
    found = []
    for features, owner in hashed(texts):
        if chosen is not None:
            on = chosen[features]
            features, owner = features[on], owner[on]
        found.append((owner.astype(np.int64) << BITS) | features)
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


@dataclass(frozen=True)
class Model:
    """Weight of every feature (coefficient times log-count ratio) and the intercept."""

    weights: np.ndarray
    intercept: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        total = np.full(len(texts), self.intercept)
        chosen = self.weights != 0
        for part in slices(texts, _SLICE):
            owner, features = distinct_features([texts[i] for i in part], chosen)
            total[part.start : part.stop] += np.bincount(owner, self.weights[features], len(part))
        return 1.0 / (1.0 + np.exp(-np.clip(total, -500, 500)))


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2


def training_rows(labels: DataFrame, key: str = "doc_id", label: str = "toxic", rows: int = TRAIN_ROWS) -> DataFrame:
    """At most ``rows`` labelled ids that are not held out."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    known = known.groupBy(F.col(key).alias("key")).agg(F.max((F.col(label) > 0).cast("double")).alias("label"))
    return known.orderBy(F.xxhash64("key"), "key").limit(rows)


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """Train on the texts of ``training_rows``; ``labels`` has one row per label."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors, VectorUDT

    spark = df.sparkSession
    chosen_rows = F.broadcast(training_rows(labels, key, label, rows))
    texts = df.select(F.col(key).alias("key"), F.col(text).alias("t")).join(chosen_rows, "key").select("label", "t")
    texts = stored(texts.repartition(max(1, min(32, spark.sparkContext.defaultParallelism))), "toxicity")

    def tally(batches):
        counts = np.zeros((2, 1 << BITS), np.int64)
        for batch in steps(batches):
            marks, held = batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_pylist()
            for part in slices(held, _SLICE):
                owner, features = distinct_features([held[i] for i in part])
                np.add.at(counts, (marks[part.start + owner], features), 1)
        some = np.flatnonzero(counts.sum(axis=0))
        for at in range(0, len(some), 65536):
            f = some[at : at + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(counts[0, f]), pa.array(counts[1, f])], ["f", "clean", "toxic"])

    sizes = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    clean_rows, toxic_rows = sizes.get(0.0, 0), sizes.get(1.0, 0)
    flat = np.zeros(1 << BITS)
    if not clean_rows or not toxic_rows:
        share = toxic_rows / max(1, toxic_rows + clean_rows)
        return Model(flat, float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    sums = texts.mapInArrow(tally, "f long, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    p = (F.col("toxic") + SMOOTHING) / (toxic_rows + 2 * SMOOTHING)
    q = (F.col("clean") + SMOOTHING) / (clean_rows + 2 * SMOOTHING)
    a = toxic_rows / (toxic_rows + clean_rows)
    every = F.col("toxic") + F.col("clean")
    surprise = F.pow(F.col("toxic") - a * every, 2) / (every * a * (1 - a))
    best = sums.where(every >= MIN_TEXTS).select("f", F.log(p / q).alias("ratio"), surprise.alias("surprise"))
    table = best.orderBy(F.desc("surprise"), "f").limit(SELECTED).select("f", "ratio").toPandas().sort_values("f")
    chosen = np.zeros(1 << BITS, bool)
    chosen[table["f"]] = True
    place = np.full(1 << BITS, -1, np.int64)
    place[table["f"]] = np.arange(len(table))
    ratio = table["ratio"].to_numpy()

    def rows_of(batches):
        for batch in steps(batches):
            held = batch.column(1).to_pylist()
            lists = []
            for part in slices(held, _SLICE):
                owner, features = distinct_features([held[i] for i in part], chosen)
                cuts = np.searchsorted(owner, np.arange(1, len(part)))
                lists.extend(x.tolist() for x in np.split(np.sort(place[features]) if len(part) == 1 else place[features], cuts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int64()))], ["label", "fs"])

    size = len(table)
    vector = F.udf(lambda fs: Vectors.sparse(size, fs, ratio[fs]), VectorUDT())
    data = texts.mapInArrow(rows_of, "label double, fs array<long>").select("label", vector("fs").alias("features"))
    fitted = LogisticRegression(maxIter=100, regParam=REGULARISATION, elasticNetParam=0.0, standardization=False).fit(data)
    weights = flat
    weights[table["f"]] = fitted.coefficients.toArray() * ratio
    return Model(weights, float(fitted.intercept))


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", limit: float = LIMIT) -> DataFrame:
    """``key``, ``held_out``, ``score`` and ``predicted``."""
    held = df.sparkSession.sparkContext.broadcast(model)
    narrow = df.select(F.col(key).alias("key"), F.col(text).alias("t"))
    kind = narrow.schema["key"].dataType.simpleString()

    def make():
        def work(batch):
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.scores(batch.column(1).to_pylist()))], ["key", "score"])

        return work

    scored = narrow.mapInArrow(over_batches(make), f"key {kind}, score double")
    predicted = (F.col("score") >= limit).cast("int").alias("predicted")
    return scored.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "score", predicted)


def keep_clean(df: DataFrame, model: Model, text: str = "text", limit: float = LIMIT) -> DataFrame:
    """The rows of ``df`` whose score is below ``limit``, with their columns."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(batch):
            at = batch.schema.get_field_index(text)
            return batch.filter(pa.array(held.value.scores(batch.column(at).to_pylist()) < limit))

        return work

    return df.mapInArrow(over_batches(make), df.schema)
