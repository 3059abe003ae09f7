"""A corpus for training: toxic and bad documents go, one of each group of near duplicates stays, the rest is packed.

``run(spark, sf_dir)`` applies the stages to the table of documents. Each stage works on all rows that the one before kept; its
result is written to the shared folder and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm import neardup, packing, quality, toxicity
from lorekeep.llm.common import read_table, small_batches, stored
from lorekeep.session import ship_package


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trains on the labelled documents of ``docs`` and drops those that the model rejects."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the rules or are outliers of their language and source."""
    return quality.keep_good(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates."""
    return neardup.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the documents' tokens into sequences; one row per piece."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), cache_bytes=PACKING_CACHE_BYTES)


def _prepared(stage):
    """A stage that brings the package to the executors and keeps their batches small."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


#: Workers of earlier stages go on to packing, so that its caches are smaller here than alone; ids are the same.
PACKING_CACHE_BYTES = 24_000_000

STAGES = [
    ("toxicity", _prepared(without_toxic)),
    ("quality rules", _prepared(of_quality)),
    ("near duplicates", _prepared(without_near_copies)),
    ("packing", _prepared(packed)),
]

#: SQL expresses neither the classifier nor the estimates; tests/llm compares every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
