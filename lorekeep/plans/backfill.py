"""Vectors for rows that have none yet, and stored lexical indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lorekeep.backends import Embedder, embed_column
from lorekeep.operators.common import spread
from lorekeep.operators.lexical import LexicalIndex
from lorekeep.operators.segments import SegmentStore
from lorekeep.operators.upkeep import pending
from lorekeep.plans.search import Corpus
from lorekeep.session import KnowledgeBase

LEVELS = {
    "document_content": ("raw_text", ["document_id"]),
    "chunks": ("text", ["document_id", "chunk_index"]),
}


def embed_rows(rows: DataFrame, text: str, embedder: Embedder, dim: int) -> DataFrame:
    """The rows with new vectors, NULL where the model failed twice."""
    return rows.withColumn("embedding", embed_column(embedder, dim)(F.col(text)))


def embed_pending(
    kb: KnowledgeBase,
    embedder: Embedder,
    table: str = "document_content",
    rebuild: bool = False,
    filter_sql: str | None = None,
    limit: int | None = None,
) -> dict[str, int]:
    """Fill missing vectors of one table; counts of embedded and failed rows.

    A second run only sees what is still missing. Failed rows keep what they
    had. The counts are observed while the rows are written.
    """
    text, order = LEVELS[table]
    rows = pending(kb.table(table), kb.documents, text, order, rebuild, filter_sql, limit)
    if rows.isEmpty():
        return {"embedded": 0, "failed": 0}
    seen = Observation("embedding")
    embedded = embed_rows(spread(rows) if limit is None else rows, text, embedder, kb.settings.embed_dim)
    watched = embedded.observe(
        seen,
        F.count_if(F.col("embedding").isNotNull()).alias("embedded"),
        F.count_if(F.col("embedding").isNull()).alias("failed"),
    )
    kb.commit({table: watched.where(F.col("embedding").isNotNull())})
    return {k: int(v) for k, v in seen.get.items()}


# Level of a lexical index: its table, the name of its id there, what else it carries, its text.
INDEXES = {
    "documents": ("document_content", "document_id", [], "raw_text"),
    "chunks": ("chunks", "id", ["document_id"], "text"),
}


def segment_store(kb: KnowledgeBase, level: str) -> SegmentStore:
    return SegmentStore(kb.spark, f"{kb.root}/_lexical/{level}", ["id", *INDEXES[level][2]], kb.settings.tokenizer)


def refresh_index(kb: KnowledgeBase, level: str) -> LexicalIndex:
    """The stored index of the current version; new rows are tokenised, removed ones subtracted, others not touched."""
    table, key, carried, text = INDEXES[level]
    store, log = segment_store(kb, level), kb._log()
    version = kb.version_of(log)
    if not store.is_at(version):
        rows = kb.table(table, log, with_batch=True).select(F.col(key).alias("id"), *carried, text, "batch")
        store.refresh(rows, text, kb.batches_of(table, log), version)
    return store.index(version)


def build_indexes(kb: KnowledgeBase) -> None:
    """Store the postings of documents and chunks; from then on they follow every commit."""
    for level in INDEXES:
        refresh_index(kb, level)


def sweep_indexes(kb: KnowledgeBase) -> int:
    """Delete what merged segments and old versions left; only to be called while no job runs."""
    return sum(segment_store(kb, level).sweep(kb.version) for level in INDEXES)


def corpus_of(kb: KnowledgeBase) -> Corpus:
    """The tables with their lexical indexes, if any were built, brought up to the current version."""
    found = {level: refresh_index(kb, level) if segment_store(kb, level).exists() else None for level in INDEXES}
    return Corpus(
        kb.documents,
        kb.content,
        kb.metadata,
        kb.chunks,
        kb.settings.tokenizer,
        found["documents"],
        found["chunks"],
        f"{kb.root}/_staging",
    )
