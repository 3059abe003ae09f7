"""Weighted, cross-validated reciprocal rank fusion and what follows it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import _nonblank
from lorekeep.operators.common import is_one_of, top_per_group


@dataclass(frozen=True)
class FusionRules:
    """Fixed values of the fusion formula."""

    pool: int = 20
    rrf_k: int = 60
    fts_top_weights: tuple[float, ...] = (3.0, 2.0)
    vector_weight: float = 1.5
    validate_top: int = 8


def fused_order() -> list[Column]:
    """Score first; equal scores keep lexical rank, then vector rank, then id."""
    return [
        F.desc("score"),
        F.asc_nulls_last("fts_rank"),
        F.asc_nulls_last("vec_rank"),
        F.asc("id"),
    ]


def fts_weight(fts_rank: Column, vec_rank: Column, rules: FusionRules) -> Column:
    """Top lexical ranks count more, if the vector side confirms them."""
    confirmed = F.coalesce(vec_rank < rules.validate_top, F.lit(False))
    weight = F.lit(1.0)
    for rank, boost in reversed(list(enumerate(rules.fts_top_weights))):
        weight = F.when(confirmed & (fts_rank == rank), F.lit(boost)).otherwise(weight)
    return weight


def fuse(
    fts: DataFrame,
    vec: DataFrame,
    rules: FusionRules = FusionRules(),
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Merge two hit lists: ``query_id, id, carry, score, source, fts_rank, vec_rank``.

    The lists are stacked and grouped instead of outer-joined: one exchange on
    (query, id) over at most two pools of rows per query.
    """
    lists = fts.select(
        "query_id", "id", *carry, F.col("rank").alias("fts_rank"),
        F.lit(None).cast("int").alias("vec_rank"),
    ).unionByName(
        vec.select(
            "query_id", "id", *carry, F.lit(None).cast("int").alias("fts_rank"),
            F.col("rank").alias("vec_rank"),
        )
    )
    merged = lists.groupBy("query_id", "id").agg(
        F.max("fts_rank").alias("fts_rank"),
        F.max("vec_rank").alias("vec_rank"),
        *[F.max(c).alias(c) for c in carry],
    )
    fts_rank, vec_rank = F.col("fts_rank"), F.col("vec_rank")
    fts_part = fts_weight(fts_rank, vec_rank, rules) / (rules.rrf_k + fts_rank + 1)
    vec_part = F.lit(rules.vector_weight) / (rules.rrf_k + vec_rank + 1)
    source = (
        F.when(fts_rank.isNotNull() & vec_rank.isNotNull(), "both")
        .when(fts_rank.isNotNull(), "fts")
        .otherwise("vector")
    )
    return merged.select(
        "query_id", "id", *carry,
        (F.coalesce(fts_part, F.lit(0.0)) + F.coalesce(vec_part, F.lit(0.0))).alias("score"),
        source.alias("source"), "fts_rank", "vec_rank",
    )


def single_source(hits: DataFrame, source: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Hits of one engine in the shape of :func:`fuse`, with their own scores."""
    rank, none = F.col("rank"), F.lit(None).cast("int")
    return hits.select(
        "query_id", "id", *carry, "score", F.lit(source).alias("source"),
        (rank if source == "fts" else none).alias("fts_rank"),
        (rank if source == "vector" else none).alias("vec_rank"),
    )


def diversify(fused: DataFrame, per_document: int, k: int) -> DataFrame:
    """At most ``per_document`` rows of a document, then the best ``k`` per query."""
    known = fused.where(F.col("document_id").isNotNull())
    capped = top_per_group(known, ["query_id", "document_id"], fused_order(), per_document)
    return top_per_group(capped, ["query_id"], fused_order(), k)


def best(fused: DataFrame, k: int) -> DataFrame:
    return top_per_group(fused, ["query_id"], fused_order(), k)


def promote_parent(parent_text: Column, text: Column) -> Column:
    """The parent is returned when there is one, else the matched child."""
    return F.coalesce(_nonblank(parent_text), text)


# Up to this many ids are also handed to the scans as literals.
LITERAL_IDS = 1000


def _few_ids(ranked: DataFrame, column: str) -> list | None:
    """The distinct ids of the ranked rows, or None if there are many."""
    ids = [r[0] for r in ranked.select(column).distinct().limit(LITERAL_IDS + 1).collect()]
    return ids if len(ids) <= LITERAL_IDS else None


def _look_up(table: DataFrame, column: str, ids: list | None) -> DataFrame:
    """Rows of a big table that can match, found by file statistics if ids are few.

    The stored tables are sorted by id and carry bloom filters, so literal ids
    skip row groups: fetching k rows does not read a whole text column.
    """
    return table if ids is None else table.where(is_one_of(column, ids))


def hydrate_documents(
    ranked: DataFrame, documents: DataFrame, content: DataFrame, metadata: DataFrame
) -> DataFrame:
    """Attach names, text and summary; ids without stored rows disappear.

    ``ranked`` is a written table of k rows per query. Its size is known to the
    planner, which broadcasts it while it is small, so that the big tables are
    filtered where they are read, and shuffles otherwise.
    """
    ids = _few_ids(ranked, "id")
    docs = _look_up(documents, "id", ids).select("id", "file_name", "file_path")
    texts = _look_up(content, "document_id", ids).select(
        F.col("document_id").alias("id"), "raw_text"
    )
    notes = _look_up(metadata, "document_id", ids).select(
        F.col("document_id").alias("id"), "summary"
    )
    notes = notes.join(ranked.select("id"), "id", "left_semi")
    return (
        ranked.join(docs, "id").join(texts, "id").join(notes, "id", "left")
        .select(
            "query_id", "rank", F.col("id").alias("document_id"), "file_name", "file_path",
            "raw_text", "summary", "score", "source",
        )
    )


def hydrate_chunks(
    ranked: DataFrame, chunks: DataFrame, documents: DataFrame, metadata: DataFrame
) -> DataFrame:
    """Attach chunk, file name and summary; see :func:`hydrate_documents`."""
    owners = _few_ids(ranked, "document_id")
    parts = _look_up(chunks, "id", _few_ids(ranked, "id")).select(
        "id", "document_id", "chunk_index", "text", "parent_text", "element_type",
        "page_number", "section",
    )
    names = _look_up(documents, "id", owners).select(
        F.col("id").alias("document_id"), "file_name", "file_path"
    )
    notes = _look_up(metadata, "document_id", owners)
    notes = notes.select("document_id", "summary").join(
        ranked.select("document_id"), "document_id", "left_semi"
    )
    # The names are joined to the small side first: the chunk has its own document.
    named = ranked.join(names, "document_id").join(notes, "document_id", "left")
    return (
        named.join(parts, ["id", "document_id"])
        .select(
            "query_id", "rank", F.col("id").alias("chunk_id"), "document_id", "chunk_index",
            promote_parent(F.col("parent_text"), F.col("text")).alias("text"),
            F.col("text").alias("search_match"), "element_type", "page_number", "section",
            "file_name", "file_path", "summary", "score", "source",
        )
    )
