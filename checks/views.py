"""The driver's tables seen as a knowledge base."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.chunks import ChunkRules, chunk_elements
from lorekeep.functions.elements import text_elements
from lorekeep.functions.text import chunk_id
from lorekeep.operators.common import materialize, spread, unnest
from lorekeep.plans.search import Corpus


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents on all cores, for steps that are costly per row."""
    return spread(read(spark, folder, "documents"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "documents")
    name = F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt"))
    return rows.select(
        F.col("doc_id").cast("string").alias("id"),
        name.alias("file_name"),
        F.concat(F.col("source"), F.lit("/"), name).alias("file_path"),
        F.col("lang").alias("category"),
    )


def content(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read(spark, folder, "embeddings").select(
        F.col("vec_id").alias("doc_id"), "embedding"
    )
    rows = read(spark, folder, "documents").select("doc_id", F.col("text").alias("raw_text"))
    return spread(rows).join(vectors, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("document_id"), "raw_text", "embedding"
    )


def raw_texts(spark: SparkSession, folder: str) -> DataFrame:
    return texts(spark, folder).select(
        F.col("doc_id").cast("string").alias("document_id"), F.col("text").alias("raw_text")
    )


def metadata(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "labels")
    summary = F.format_string("quality %d, toxic %d", F.col("quality"), F.col("toxic"))
    return rows.select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.when(F.col("toxic") == 1, F.lit("No summary available (LLM failed)"))
        .otherwise(summary)
        .alias("summary"),
    )


def plain_chunks(
    spark: SparkSession, folder: str, rules: ChunkRules = ChunkRules()
) -> DataFrame:
    """Chunks of every document: document_id, chunk_index, text, parent_text, ..."""
    found = chunk_elements(text_elements(F.col("text")), rules)
    rows = texts(spark, folder).withColumn("document_id", F.col("doc_id").cast("string"))
    return unnest(rows, ["document_id"], found).withColumn(
        "id", chunk_id(F.col("document_id"), F.col("chunk_index"))
    )


def derived_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks with the vector of their document, if any, chunked where they are used."""
    vectors = read(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("document_id"), "embedding"
    )
    return plain_chunks(spark, folder).join(vectors, "document_id", "left")


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The same as a stored table, for plans that read it more than once."""
    return materialize(derived_chunks(spark, folder))


def corpus(
    spark: SparkSession, folder: str, with_chunks: bool = True, stored: bool = True
) -> Corpus:
    parts = None
    if with_chunks:
        parts = chunks(spark, folder) if stored else derived_chunks(spark, folder)
    return Corpus(
        documents(spark, folder), content(spark, folder), metadata(spark, folder), parts
    )


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """Every benchmark item as a query; its vector is the one of the same number."""
    items = read(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )
    vectors = read(spark, folder, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")
    )
    return items.join(vectors, "query_id", "left")
