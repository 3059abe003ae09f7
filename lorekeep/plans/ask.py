"""Questions to grounded prompts, and the frames of a streamed answer."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.backends import Embedder, embed_text
from lorekeep.operators import assembly
from lorekeep.plans.search import Corpus, hybrid_search, hybrid_search_chunks, unanswered

WEB_CHUNKS = 5
WEB_DOCUMENTS = 2


def as_queries(
    spark: SparkSession,
    questions: str | Iterable[str],
    embedder: Embedder | None = None,
    dim: int = 0,
) -> DataFrame:
    """Queries typed by a user, with their vectors if there is an embedder."""
    texts = [questions] if isinstance(questions, str) else list(questions)
    rows = [
        (n, text, None if embedder is None else embed_text(text, embedder, dim))
        for n, text in enumerate(texts)
    ]
    schema = T.StructType(
        [
            T.StructField("query_id", T.LongType()),
            T.StructField("query", T.StringType()),
            T.StructField("vector", T.ArrayType(T.DoubleType())),
        ]
    )
    return spark.createDataFrame(rows, schema)


def _passages(hits: DataFrame, queries: DataFrame, size: int, corpus: Corpus, matching: bool) -> DataFrame:
    return assembly.with_passages(hits, queries, size, corpus.tokenizer) if matching else hits


def web_prompts(corpus: Corpus, queries: DataFrame, mode: str = "hybrid", matching: bool = False) -> DataFrame:
    """``query_id, query, context, sources, prompt`` with a fallback to documents.

    A document is shown by its first characters or, with ``matching``, by the passage that matches the question best.
    """
    contexts, left = None, queries
    if corpus.chunks is not None:
        hits = hybrid_search_chunks(corpus, queries, WEB_CHUNKS, mode)
        contexts, left = assembly.web_context(hits), unanswered(queries, hits, corpus.staging)
    if left is not None:
        found = hybrid_search(corpus, left, WEB_DOCUMENTS, mode)
        documents = assembly.web_document_context(_passages(found, left, assembly.WEB_DOCUMENT_CHARS, corpus, matching))
        contexts = documents if contexts is None else contexts.unionByName(documents)
    wanted = queries.select("query_id", "query")
    return assembly.with_prompts(wanted, contexts, assembly.NO_DOCUMENT_WEB)


def benchmark_prompts(corpus: Corpus, queries: DataFrame, level: str = "document", matching: bool = False) -> DataFrame:
    """Prompts of a benchmark: lexical top-3 documents or hybrid top-5 chunks; ``matching`` as for ``web_prompts``."""

    def shown(hits: DataFrame) -> DataFrame:
        return assembly.document_context(_passages(hits, queries, assembly.DOCUMENT_CHARS, corpus, matching))

    if level == "document":
        contexts = shown(hybrid_search(corpus, queries, 3, "fts"))
    else:
        hits = hybrid_search_chunks(corpus, queries)
        contexts, left = assembly.chunk_context(hits), unanswered(queries, hits, corpus.staging)
        if left is not None:
            documents = shown(hybrid_search(corpus, left, 3))
            contexts = contexts.unionByName(documents)
    return assembly.with_prompts(queries, contexts)


def answer_frames(sources: list[str], deltas: Iterable[str]) -> Iterator[str]:
    """Server-sent events: the sources first, then the answer piece by piece."""

    def frame(payload: dict) -> str:
        return f"data: {json.dumps(payload)}\n\n"

    if not sources:
        yield frame({"sources": [], "chunk": assembly.NO_ANSWER})
    else:
        yield frame({"sources": sources, "chunk": ""})
        try:
            for delta in deltas:
                if delta:
                    yield frame({"chunk": delta})
        except Exception as problem:  # noqa: BLE001 - told to the reader
            yield frame({"chunk": f"\n\n**Erreur**: {problem}"})
    yield "data: [DONE]\n\n"


def first_row(prompts: DataFrame) -> dict:
    """The prompt of a single question (at most one row)."""
    return prompts.orderBy(F.col("query_id")).limit(1).collect()[0].asDict()
