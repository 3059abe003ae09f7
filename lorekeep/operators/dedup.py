"""Which incoming files are new, changed, known or not for ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.common import join_with_hot_keys
from lorekeep.sources.files import clean_path, is_below, is_textual


def classify_files(files: DataFrame, documents: DataFrame, force: bool = False) -> DataFrame:
    """Add ``status`` (dup, skip_binary, updated, new) and ``old_id`` to files.

    ``files`` has ``path, id`` with the content hash as id; ``documents`` has
    ``id, file_path``. One row per content is kept, the one with the smallest
    path; copies are found by a partial aggregation over hashes, and a hash
    shared by very many files is joined without sending them to one task.
    ``force`` ingests known contents again.
    """
    textual = is_textual(F.col("path"))
    seen = files.groupBy("id").agg(F.min(F.when(textual, F.col("path"))).alias("first_path"))
    stored = documents.select("id", F.lit(True).alias("is_stored"))
    seen = seen.join(stored, "id", "left")
    rows = join_with_hot_keys(files, seen, "id", "left")
    known = F.coalesce(F.col("is_stored"), F.lit(False)) & F.lit(not force)
    copy = F.col("path") != F.col("first_path")
    rows = rows.withColumn(
        "status",
        F.when(known, "dup")
        .when(~textual, "skip_binary")
        .when(copy, "dup")
        .otherwise("new"),
    ).drop("first_path", "is_stored")
    older = documents.groupBy(F.col("file_path").alias("path")).agg(F.min("id").alias("old_id"))
    rows = rows.join(older, "path", "left")
    replaces = (F.col("status") == "new") & F.col("old_id").isNotNull()
    return rows.withColumn(
        "old_id", F.when(replaces & (F.col("old_id") != F.col("id")), F.col("old_id"))
    ).withColumn("status", F.when(replaces, "updated").otherwise(F.col("status")))


def missing_documents(documents: DataFrame, present: DataFrame, directory: str) -> DataFrame:
    """Stored documents below ``directory`` whose file is gone (``present`` has ``path``)."""
    base = directory.rstrip("/").removeprefix("file:")
    stored = documents.withColumn("path", clean_path(F.col("file_path")))
    return stored.where(is_below(F.col("path"), base)).join(present, "path", "left_anti")


def status_histogram(outcome: DataFrame) -> DataFrame:
    """Files and chunks per ingestion status."""
    return outcome.groupBy("status").agg(
        F.count(F.lit(1)).alias("files"), F.sum("n_chunks").alias("chunks")
    )
