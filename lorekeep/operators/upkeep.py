"""Backfill selection, validation and progress reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.common import broadcast_if_small


def pending(
    rows: DataFrame,
    documents: DataFrame,
    text: str,
    order: list[str],
    rebuild: bool = False,
    filter_sql: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Rows with text and, unless ``rebuild``, without a vector.

    ``filter_sql`` is one boolean expression over the row's and its document's
    columns. Catalyst parses it as an expression, so it cannot carry a statement.
    """
    wanted = F.length(F.coalesce(F.col(text), F.lit(""))) > 0
    if not rebuild:
        wanted = wanted & F.col("embedding").isNull()
    names = [c for c in documents.columns if c != "id" and c not in rows.columns]
    owners = documents.select(F.col("id").alias("document_id"), *names)
    found = rows.where(wanted).join(owners, "document_id")
    if filter_sql:
        found = found.where(F.expr(filter_sql))
    if limit is not None:
        found = found.orderBy(*order).limit(limit)
    return found.select(*rows.columns)


def fill_vectors(rows: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """New vectors replace old ones; rows without a new vector keep theirs."""
    fresh = vectors.select(key, F.col("embedding").alias("_fresh"))
    return (
        rows.join(fresh, key, "left")
        .withColumn("embedding", F.coalesce("_fresh", "embedding"))
        .drop("_fresh")
    )


def duplicate_keys(table: DataFrame, key: str) -> DataFrame:
    return table.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def refused_keys(new: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Keys that ``new`` rows may not be inserted with: ``key``, ``copies`` among them, and whether a live row has it (``known``).

    New rows are counted per key first. Where few keys are new, the live table is looked through without an exchange.
    A NULL key is refused too.
    """
    counted = new.groupBy(key).agg(F.count(F.lit(1)).alias("copies"))
    keys, _ = broadcast_if_small(counted.select(key))
    known = live.select(key).join(keys, key, "left_semi").distinct().withColumn("known", F.lit(True))
    found = counted.join(known, key, "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return found.where(F.col("known") | (F.col("copies") > 1) | F.col(key).isNull())


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose parent does not exist."""
    return child.join(parent, child[child_key] == parent[parent_key], "left_anti")


def remaining(all_rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return all_rows.join(done.select(key), key, "left_anti")


def corpus_status(
    documents: DataFrame, chunks: DataFrame, metadata: DataFrame, expected: int
) -> DataFrame:
    """One row of progress figures, one aggregation per table."""
    docs = documents.agg(F.count(F.lit(1)).alias("documents"))
    parts = chunks.agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count_if(F.col("embedding").isNotNull()).alias("embedded_chunks"),
        F.coalesce(F.avg(F.length("text")), F.lit(0.0)).alias("mean_chunk_chars"),
    )
    usable = ~F.col("summary").like("No summary%") & (F.col("summary") != "")
    notes = metadata.agg(F.count_if(usable).alias("summaries"))
    figures = docs.withColumn("_c", parts.select(F.struct("*")).scalar()).withColumn(
        "summaries", notes.scalar()
    )
    return figures.select(
        "documents",
        F.lit(expected).cast("long").alias("expected"),
        F.floor(F.col("documents") * 100 / expected).cast("long").alias("percent"),
        (F.lit(expected) - F.col("documents")).alias("left"),
        "_c.chunks",
        "_c.embedded_chunks",
        "_c.mean_chunk_chars",
        "summaries",
    )


def progress(log: DataFrame, total: int) -> DataFrame:
    """Success and failure counts, mean seconds and the time still to go.

    ``log`` holds one row per processed item: ``ok`` and ``seconds``.
    """
    done = log.agg(
        F.count_if("ok").alias("done"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.avg("seconds").alias("mean_seconds"),
    )
    return done.withColumn(
        "eta_seconds",
        F.greatest(F.lit(total) - F.col("done") - F.col("failed"), F.lit(0)) * F.col("mean_seconds"),
    )


# Words that hint at a description of a picture.
VISUAL_WORDS = ("capture", "bouton", "fenetre", "ecran", "interface", "schema")


def keyword_report(
    chunks: DataFrame, documents: DataFrame, words: tuple[str, ...] = VISUAL_WORDS, top: int = 20
) -> DataFrame:
    """Files by number of chunks that contain any of the words."""
    hit = F.lit(False)
    for word in words:
        hit = hit | F.col("text").ilike(f"%{word}%")
    per_document = chunks.where(hit).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    names = documents.select(F.col("id").alias("document_id"), "file_name")
    return (
        per_document.join(names, "document_id")
        .groupBy("file_name")
        .agg(F.sum("n").alias("n_chunks"))
        .orderBy(F.desc("n_chunks"), "file_name")
        .limit(top)
    )
