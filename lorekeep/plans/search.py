"""Search over documents and chunks, one or many queries at a time."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.tokens import Tokenizer
from lorekeep.operators import fusion
from lorekeep.operators.common import materialize
from lorekeep.operators.fusion import FusionRules
from lorekeep.operators.lexical import LexicalIndex, bm25_search
from lorekeep.operators.nearest import knn_search

MODES = ("hybrid", "fts", "vector")
DOC_K = 3
CHUNK_K = 5
CHUNKS_PER_DOCUMENT = 2


@dataclass(frozen=True)
class Corpus:
    """The four tables and, optionally, stored indexes over them.

    ``staging`` is the shared folder for intermediate results where the cluster
    names none.
    """

    documents: DataFrame
    content: DataFrame
    metadata: DataFrame
    chunks: DataFrame | None = None
    tokenizer: Tokenizer = Tokenizer()
    document_index: LexicalIndex | None = None
    chunk_index: LexicalIndex | None = None
    staging: str | None = None

    def lexical_documents(self) -> LexicalIndex:
        return self.document_index or LexicalIndex.of(
            self.content.select(F.col("document_id").alias("id"), "raw_text"),
            ["id"],
            "raw_text",
            self.tokenizer,
            keep=True,
            staging=self.staging,
        )

    def lexical_chunks(self) -> LexicalIndex:
        return self.chunk_index or LexicalIndex.of(
            self.chunks.select("id", "document_id", "text"),
            ["id", "document_id"],
            "text",
            self.tokenizer,
            keep=True,
            staging=self.staging,
        )


def search_fts(corpus: Corpus, queries: DataFrame, pool: int = FusionRules().pool) -> DataFrame:
    return bm25_search(corpus.lexical_documents(), queries, pool, corpus.staging)


def search_fts_chunks(
    corpus: Corpus, queries: DataFrame, pool: int = FusionRules().pool
) -> DataFrame:
    return bm25_search(corpus.lexical_chunks(), queries, pool, corpus.staging)


def search_vector(corpus: Corpus, queries: DataFrame, pool: int = FusionRules().pool) -> DataFrame:
    vectors = corpus.content.select(F.col("document_id").alias("id"), "embedding")
    return knn_search(vectors, ["id"], "embedding", queries, pool)


def search_vector_chunks(
    corpus: Corpus, queries: DataFrame, pool: int = FusionRules().pool
) -> DataFrame:
    vectors = corpus.chunks.select("id", "document_id", "embedding")
    return knn_search(vectors, ["id", "document_id"], "embedding", queries, pool)


def _candidates(
    corpus: Corpus, queries: DataFrame, mode: str, rules: FusionRules, chunks: bool
) -> DataFrame:
    """Hits of the engines that the mode asks for; the other is never planned."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    carry = ("document_id",) if chunks else ()
    lexical = search_fts_chunks if chunks else search_fts
    nearest = search_vector_chunks if chunks else search_vector
    if mode == "fts":
        return fusion.single_source(lexical(corpus, queries, rules.pool), "fts", carry)
    if mode == "vector":
        return fusion.single_source(nearest(corpus, queries, rules.pool), "vector", carry)
    return fusion.fuse(
        lexical(corpus, queries, rules.pool), nearest(corpus, queries, rules.pool), rules, carry
    )


def hybrid_search(
    corpus: Corpus,
    queries: DataFrame,
    k: int = DOC_K,
    mode: str = "hybrid",
    rules: FusionRules = FusionRules(),
) -> DataFrame:
    """Best ``k`` documents per query with names, text and summary.

    ``queries`` holds ``query_id``, ``query`` (lexical modes) and ``vector``
    (vector modes; NULL leaves the query to the lexical engine).
    """
    ranked = materialize(fusion.best(_candidates(corpus, queries, mode, rules, chunks=False), k), corpus.staging)
    return fusion.hydrate_documents(ranked, corpus.documents, corpus.content, corpus.metadata)


# Lists of open queries grow by this factor.
WIDER = 4


def hybrid_search_chunks(
    corpus: Corpus,
    queries: DataFrame,
    k: int = CHUNK_K,
    mode: str = "hybrid",
    per_document: int = CHUNKS_PER_DOCUMENT,
    rules: FusionRules = FusionRules(),
    widen: bool = True,
) -> DataFrame:
    """Best ``k`` chunks per query, at most ``per_document`` of one document.

    A document with many matching chunks can fill the lists of a query. Queries that have fewer than ``k`` rows for that reason, and only
    those, are asked again with longer lists until ``k`` rows stand or both lists have ended; ``widen=False`` keeps the
    lists of ``rules``.
    """
    if widen:
        ranked = _until_k(corpus, queries, k, mode, per_document, rules)
    else:
        found = _candidates(corpus, queries, mode, rules, chunks=True)
        ranked = materialize(fusion.diversify(found, per_document, k), corpus.staging)
    return fusion.hydrate_chunks(ranked, corpus.chunks, corpus.documents, corpus.metadata)


def _until_k(corpus: Corpus, queries: DataFrame, k: int, mode: str, per_document: int, rules: FusionRules) -> DataFrame:
    done: list[DataFrame] = []
    while True:
        found = materialize(_candidates(corpus, queries, mode, rules, chunks=True), corpus.staging)
        ranked = materialize(fusion.diversify(found, per_document, k), corpus.staging)
        # A list as long as asked for may go on.
        lists = found.groupBy("query_id").agg(((F.count("fts_rank") >= rules.pool) | (F.count("vec_rank") >= rules.pool)).alias("goes_on"))
        full = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("query_id")
        short = materialize(lists.where("goes_on").select("query_id").join(full, "query_id", "left_anti"), corpus.staging)
        if short.isEmpty():
            return reduce(DataFrame.unionByName, [*done, ranked])
        done.append(ranked.join(short, "query_id", "left_anti"))
        queries = queries.join(short, "query_id", "left_semi")
        rules = replace(rules, pool=rules.pool * WIDER)


def unanswered(
    queries: DataFrame, hits: DataFrame, staging: str | None = None
) -> DataFrame | None:
    """Queries without a hit, written once; None if every query has one."""
    left = queries.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    left = materialize(left, staging)
    return None if left.isEmpty() else left


def search(
    corpus: Corpus,
    queries: DataFrame,
    k: int = DOC_K,
    mode: str = "hybrid",
    fallback_k: int | None = None,
) -> DataFrame:
    """Chunk search; queries without a chunk hit, and only those, search documents.

    ``level`` tells which; columns that a level does not have are NULL.
    """
    level = F.lit("document").alias("level")
    if corpus.chunks is None:
        return hybrid_search(corpus, queries, fallback_k or k, mode).select("*", level)
    hits = hybrid_search_chunks(corpus, queries, k, mode)
    found = hits.select("*", F.lit("chunk").alias("level"))
    left = unanswered(queries, hits, corpus.staging)
    if left is None:
        return found.withColumn("raw_text", F.lit(None).cast("string"))
    documents = hybrid_search(corpus, left, fallback_k or k, mode).select("*", level)
    return found.unionByName(documents, allowMissingColumns=True)
