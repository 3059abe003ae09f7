"""Ranking, fusion and hydration over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import sqlparts as S
from checks import views as V
from lorekeep.functions.text import bind
from lorekeep.functions.tokens import Tokenizer
from lorekeep.operators import fusion, lexical
from lorekeep.operators.cells import Cells
from lorekeep.operators.common import broadcast_if_small, shared_folder, top_per_group
from lorekeep.operators.lexical import LexicalIndex, bm25_search
from lorekeep.operators.nearest import cosine
from lorekeep.operators.segments import SegmentStore
from lorekeep.plans import search as P
from lorekeep.plans.backfill import refresh_index
from lorekeep.session import KnowledgeBase

DOC_BODY = "(SELECT CAST(doc_id AS VARCHAR) AS id, text AS body FROM documents)"
CHUNK_BODY = "(SELECT id, document_id, text AS body FROM ch)"
DOC_VECTORS = "(SELECT CAST(vec_id AS VARCHAR) AS id, embedding FROM embeddings JOIN documents ON vec_id = doc_id)"


def _index(spark, d):
    return lexical.LexicalIndex.of(V.raw_texts(spark, d), ["document_id"], "raw_text")


def bm25_docs(spark, d):
    hits = P.search_fts(V.corpus(spark, d, with_chunks=False), V.questions(spark, d))
    return hits.select("query_id", F.col("id").alias("document_id"), "score", F.col("rank").cast("long").alias("rank"))


def bm25_stored_index(spark, d):
    """The same ranking from an index that was stored and loaded again."""
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    LexicalIndex.of(V.raw_texts(spark, d), ["document_id"], "raw_text", keep=True).save(path)
    index = LexicalIndex.load(spark, path, ["document_id"], Tokenizer())
    hits = bm25_search(index, V.questions(spark, d), 20)
    return hits.select("query_id", "document_id", "score", F.col("rank").cast("long").alias("rank"))


def bm25_after_commits(spark, d):
    """An index that follows four commits: English texts, the others, removal of toxic ones, new texts for those of low quality."""
    kb = KnowledgeBase(spark, f"{shared_folder(spark)}/kb-{uuid.uuid4().hex}")
    rows = V.read(spark, d, "documents").select(F.col("doc_id"), F.col("doc_id").cast("string").alias("document_id"), F.col("text").alias("raw_text"), "lang", "source")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    labels = V.read(spark, d, "labels")
    toxic = labels.where("toxic = 1").select(F.col("doc_id").cast("string").alias("id"))
    # Few narrow keys are broadcast, so that the texts are not sent across the network to find those of low quality.
    low = broadcast_if_small(labels.where("quality = 0 AND toxic = 0").select("doc_id").distinct(), 1_000_000)[0]
    poor = rows.join(low, "doc_id", "left_semi")
    steps = [
        {"inserts": {"document_content": rows.where(english)}},
        {"inserts": {"document_content": rows.where(~english)}},
        {"removed": {"document_content": toxic}},
        {"upserts": {"document_content": poor.withColumn("raw_text", F.concat_ws(" ", "raw_text", "source"))}},
    ]
    for step in steps:
        kb.commit(**step)
        index = refresh_index(kb, "documents")
    hits = bm25_search(index, V.questions(spark, d), 20, kb.root)
    return hits.select("query_id", F.col("id").alias("document_id"), "score", F.col("rank").cast("long").alias("rank"))


_COMMITTED = """(SELECT CAST(d.doc_id AS VARCHAR) AS id,
 CASE WHEN d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 0 AND toxic = 0) THEN concat_ws(' ', text, source) ELSE text END AS body
 FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))"""


def bm25_pruned(spark, d):
    """The ranking of bm25_docs from blocks whose bound can reach it."""
    store = SegmentStore(spark, f"{shared_folder(spark)}/segments-{uuid.uuid4().hex}", ["document_id"], Tokenizer())
    store.refresh(V.raw_texts(spark, d).withColumn("batch", F.lit(1)), "raw_text", {1}, "1")
    hits = bm25_search(store.index("1"), V.questions(spark, d), 20)
    return hits.select("query_id", "document_id", "score", F.col("rank").cast("long").alias("rank"))


def bm25_chunks(spark, d):
    hits = P.search_fts_chunks(V.corpus(spark, d, stored=False), V.questions(spark, d))
    return hits.select("query_id", F.col("id").alias("chunk_id"), "document_id", "score", F.col("rank").cast("long").alias("rank"))


def bm25_corpus_stats(spark, d):
    return _index(spark, d).stats.select("n_docs", F.round("avg_len", 6).alias("avg_len"))


def postings_df(spark, d):
    return _index(spark, d).frequencies


def postings(spark, d):
    return _index(spark, d).posted.select(
        "document_id", "term", F.col("tf").cast("long").alias("tf"), F.col("doc_len").cast("long").alias("doc_len")
    )


def knn_docs(spark, d):
    hits = P.search_vector(V.corpus(spark, d, with_chunks=False), V.questions(spark, d))
    return hits.select("query_id", F.col("id").alias("document_id"), "score", F.col("rank").cast("long").alias("rank"))


def knn_chunks(spark, d):
    hits = P.search_vector_chunks(V.corpus(spark, d, stored=False), V.questions(spark, d))
    return hits.select("query_id", F.col("id").alias("chunk_id"), "document_id", "score", F.col("rank").cast("long").alias("rank"))


def knn_pruned(spark, d):
    """The neighbours of knn_chunks from cells that can hold one."""
    chunks = V.corpus(spark, d).chunks.select("id", "document_id", "embedding")
    queries = V.questions(spark, d)
    dim = queries.agg(F.coalesce(F.max(F.size("vector")), F.lit(1)).alias("dim")).first()["dim"]
    cells = Cells.build(chunks, ["id", "document_id"], "embedding", dim, f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}")
    hits, _ = cells.search(queries, 20)
    return hits.select("query_id", F.col("id").alias("chunk_id"), "document_id", "score", F.col("rank").cast("long").alias("rank"))


def cosine_distance(spark, d):
    """Similarity and distance of every vector to the one that its label numbers."""
    rows = V.read(spark, d, "embeddings")
    other = rows.select(F.col("vec_id").alias("label"), F.col("embedding").alias("other"))
    pairs = rows.select("vec_id", F.col("label").cast("long").alias("label"), "embedding").join(other, "label")
    score = cosine("embedding", "other")
    return pairs.select("vec_id", F.round(score, 6).alias("score"), F.round(1 - score, 6).alias("distance"))


def _fused(spark, d):
    corpus, q = V.corpus(spark, d, with_chunks=False), V.questions(spark, d)
    return fusion.fuse(P.search_fts(corpus, q), P.search_vector(corpus, q))


def rrf_fuse(spark, d):
    ranked = top_per_group(_fused(spark, d), ["query_id"], fusion.fused_order(), 40)
    return ranked.select(
        "query_id", F.col("id").alias("document_id"), F.round("score", 8).alias("score"), "source",
        F.col("rank").cast("long").alias("rank"),
    )


def rrf_source_tags(spark, d):
    return _fused(spark, d).groupBy("query_id", "source").agg(F.count(F.lit(1)).alias("n"))


def _document_result(hits):
    return hits.select(
        "query_id", F.col("rank").cast("long").alias("rank"), "document_id", "file_name", "file_path", "raw_text", "summary",
        F.round("score", 8).alias("score"), "source",
    )


def _chunk_result(hits):
    return hits.select(
        "query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "document_id",
        F.col("chunk_index").cast("long").alias("chunk_index"), "text", "search_match", "element_type",
        "file_name", "file_path", "summary", F.round("score", 8).alias("score"), "source",
    )


def hybrid_docs(spark, d):
    return _document_result(P.hybrid_search(V.corpus(spark, d, False), V.questions(spark, d)))


def hybrid_docs_fts(spark, d):
    return _document_result(P.hybrid_search(V.corpus(spark, d, False), V.questions(spark, d), mode="fts"))


def hybrid_docs_vector(spark, d):
    return _document_result(P.hybrid_search(V.corpus(spark, d, False), V.questions(spark, d), mode="vector"))


def hybrid_chunks(spark, d):
    return _chunk_result(P.hybrid_search_chunks(V.corpus(spark, d), V.questions(spark, d)))


def hybrid_chunks_full(spark, d):
    """Twelve chunks of different documents: lists of 20 often hold fewer, so they grow."""
    hits = P.hybrid_search_chunks(V.corpus(spark, d), V.questions(spark, d), k=12, per_document=1)
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "document_id", F.round("score", 8).alias("score"), "source")


def diversify_cap(spark, d):
    hits = P.search_fts_chunks(V.corpus(spark, d, stored=False), V.questions(spark, d))
    kept = fusion.diversify(fusion.single_source(hits, "fts", ("document_id",)), 2, 5)
    return kept.select("query_id", F.col("id").alias("chunk_id"), "document_id", F.col("rank").cast("long").alias("rank"))


def search_fallback(spark, d):
    """Rare-word queries; only documents marked toxic have chunks, the others fall back."""
    word = bind(
        Tokenizer().tokens(F.col("query")),
        lambda t: F.element_at(
            F.sort_array(F.transform(t, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1
        ),
    )
    queries = V.questions(spark, d).withColumn("query", word["w"])
    full = V.corpus(spark, d)
    toxic = V.read(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("document_id"))
    some = P.Corpus(full.documents, full.content, full.metadata, full.chunks.join(toxic, "document_id", "left_semi"))
    return P.search(some, queries, k=5, mode="fts", fallback_k=2).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "document_id", "chunk_id", "level", F.round("score", 6).alias("score")
    )


def hydrate_left_join(spark, d):
    docs, texts, notes = V.documents(spark, d), V.raw_texts(spark, d), V.metadata(spark, d)
    return (
        docs.join(texts, docs["id"] == texts["document_id"]).drop("document_id")
        .join(notes, docs["id"] == notes["document_id"], "left")
        .select("id", "file_name", F.length("raw_text").cast("long").alias("n_chars"), "summary")
    )


def parent_promote(spark, d):
    chunks = V.plain_chunks(spark, d)
    parent = F.when(F.col("element_type") == "NarrativeText", F.col("parent_text"))
    old = F.when(F.col("chunk_index") == 0, F.lit("")).otherwise(parent)
    return chunks.select("id", fusion.promote_parent(old, F.col("text")).alias("text"))


_BM_DOCS = S.bm25(DOC_BODY, S.QUESTIONS, 20)
_NN_DOCS = S.knn(DOC_VECTORS, S.QUESTIONS, 20)
_BM_CHUNKS = S.bm25(CHUNK_BODY, S.QUESTIONS, 20, "document_id")
_NN_CHUNKS = S.knn(S.CHUNK_VECTORS, S.QUESTIONS, 20, "document_id")
_DOC_JOIN = f"""JOIN {S.DOCUMENTS} d ON d.id = h.id JOIN {S.CONTENT} c ON c.document_id = h.id
 LEFT JOIN {S.METADATA} m ON m.document_id = h.id"""


def _doc_sql(ctes: str, hits: str, source: str) -> str:
    return f"""WITH {ctes}, h AS ({hits})
SELECT query_id, h.rank, h.id AS document_id, file_name, file_path, raw_text, summary,
 round(score, 8) AS score, {source} AS source FROM h {_DOC_JOIN}"""


_FUSED_CHUNKS = f"""WITH RECURSIVE {S.chunks()}, {_BM_CHUNKS}, {_NN_CHUNKS}, {S.rrf("document_id")},
cap AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY pos) AS nth FROM fu),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS rank FROM cap WHERE nth <= 2)"""

_RARE = f"""(SELECT query_id, list_sort(list_transform({S.tokens("query")},
 lambda w: {{'n': -length(w), 'w': w}}))[1].w AS query FROM {S.QUESTIONS})"""

CHECKS = {
    "bm25_docs": (bm25_docs, f"WITH {_BM_DOCS} SELECT query_id, id AS document_id, score, rank FROM bm"),
    "bm25_after_commits": (bm25_after_commits, f"WITH {S.bm25(_COMMITTED, S.QUESTIONS, 20)} SELECT query_id, id AS document_id, score, rank FROM bm"),
    "bm25_pruned": (bm25_pruned, f"WITH {_BM_DOCS} SELECT query_id, id AS document_id, score, rank FROM bm"),
    "bm25_stored_index": (bm25_stored_index, f"WITH {_BM_DOCS} SELECT query_id, id AS document_id, score, rank FROM bm"),
    "bm25_chunks": (
        bm25_chunks,
        f"WITH RECURSIVE {S.chunks()}, {_BM_CHUNKS} SELECT query_id, id AS chunk_id, document_id, score, rank FROM bm",
    ),
    "bm25_corpus_stats": (
        bm25_corpus_stats,
        f"SELECT count(*) AS n_docs, round(avg(len({S.tokens('text')})), 6) AS avg_len FROM documents",
    ),
    "postings_df": (
        postings_df,
        f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({S.tokens('text')}) AS term FROM documents) GROUP BY term",
    ),
    "postings": (
        postings,
        f"""SELECT CAST(doc_id AS VARCHAR) AS document_id, term, count(*) AS tf, any_value(n) AS doc_len FROM
 (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM (SELECT doc_id, {S.tokens('text')} AS t FROM documents))
 GROUP BY doc_id, term""",
    ),
    "knn_docs": (knn_docs, f"WITH {_NN_DOCS} SELECT query_id, id AS document_id, score, rank FROM nn"),
    "cosine_distance": (
        cosine_distance,
        """SELECT vec_id, round(s, 6) AS score, round(1 - s, 6) AS distance FROM (SELECT a.vec_id,
 list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s
 FROM embeddings a JOIN embeddings b ON b.vec_id = a.label)""",
    ),
    "knn_chunks": (
        knn_chunks,
        f"WITH RECURSIVE {S.chunks()}, {_NN_CHUNKS} SELECT query_id, id AS chunk_id, document_id, score, rank FROM nn",
    ),
    "knn_pruned": (
        knn_pruned,
        f"WITH RECURSIVE {S.chunks()}, {_NN_CHUNKS} SELECT query_id, id AS chunk_id, document_id, score, rank FROM nn",
    ),
    "rrf_fuse": (
        rrf_fuse,
        f"WITH {_BM_DOCS}, {_NN_DOCS}, {S.rrf()} SELECT query_id, id AS document_id, round(score, 8) AS score, source, pos AS rank FROM fu",
    ),
    "rrf_source_tags": (
        rrf_source_tags,
        f"WITH {_BM_DOCS}, {_NN_DOCS}, {S.rrf()} SELECT query_id, source, count(*) AS n FROM fu GROUP BY ALL",
    ),
    "hybrid_docs": (
        hybrid_docs,
        _doc_sql(f"{_BM_DOCS}, {_NN_DOCS}, {S.rrf()}", "SELECT *, pos AS rank FROM fu WHERE pos < 3", "source"),
    ),
    "hybrid_docs_fts": (hybrid_docs_fts, _doc_sql(_BM_DOCS, "SELECT * FROM bm WHERE rank < 3", "'fts'")),
    "hybrid_docs_vector": (
        hybrid_docs_vector,
        _doc_sql(_NN_DOCS, "SELECT * FROM nn WHERE rank < 3", "'vector'"),
    ),
    "hybrid_chunks": (
        hybrid_chunks,
        f"""{_FUSED_CHUNKS} SELECT query_id, h.rank, h.id AS chunk_id, h.document_id, chunk_index,
 parent_text AS text, text AS search_match, 'NarrativeText' AS element_type, file_name, file_path, summary,
 round(score, 8) AS score, source
 FROM h JOIN ch ON ch.id = h.id JOIN {S.DOCUMENTS} d ON d.id = h.document_id
 LEFT JOIN {S.METADATA} m ON m.document_id = h.document_id WHERE h.rank < 5""",
    ),
    "hybrid_chunks_full": (
        hybrid_chunks_full,
        f"""WITH RECURSIVE {S.chunks()}, {S.bm25(CHUNK_BODY, S.QUESTIONS, 81920, "document_id")}, {S.knn(S.CHUNK_VECTORS, S.QUESTIONS, 81920, "document_id")},
lv AS (SELECT unnest([20, 80, 320, 1280, 5120, 20480, 81920]) AS p),
b AS (SELECT p, query_id, id, document_id, rank FROM bm JOIN lv ON rank < p), v AS (SELECT p, query_id, id, document_id, rank FROM nn JOIN lv ON rank < p),
j AS (SELECT coalesce(b.p, v.p) AS p, coalesce(b.query_id, v.query_id) AS query_id, coalesce(b.id, v.id) AS id,
  coalesce(b.document_id, v.document_id) AS document_id, b.rank AS fr, v.rank AS vr FROM b FULL JOIN v ON b.p = v.p AND b.query_id = v.query_id AND b.id = v.id),
f AS (SELECT *, coalesce((CASE WHEN vr < 8 AND fr = 0 THEN 3.0 WHEN vr < 8 AND fr = 1 THEN 2.0 ELSE 1.0 END)::DOUBLE / (60 + fr + 1), 0)
  + coalesce(1.5::DOUBLE / (60 + vr + 1), 0) AS score FROM j),
c AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY p, query_id, document_id ORDER BY score DESC, fr NULLS LAST, vr NULLS LAST, id) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY p, query_id ORDER BY score DESC, fr NULLS LAST, vr NULLS LAST, id) - 1 AS rank FROM c QUALIFY rank < 12),
ended AS (SELECT p, query_id, count(fr) < p AND count(vr) < p AS ended FROM f GROUP BY p, query_id),
stop AS (SELECT query_id, min(p) AS p FROM ended JOIN (SELECT p, query_id, count(*) AS n FROM r GROUP BY ALL) USING (p, query_id) WHERE n = 12 OR ended GROUP BY query_id)
SELECT query_id, rank, id AS chunk_id, document_id, round(score, 8) AS score,
  CASE WHEN fr IS NULL THEN 'vector' WHEN vr IS NULL THEN 'fts' ELSE 'both' END AS source FROM r JOIN stop USING (p, query_id)""",
    ),
    "diversify_cap": (
        diversify_cap,
        f"""WITH RECURSIVE {S.chunks()}, {_BM_CHUNKS},
cap AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY rank) AS nth FROM bm)
SELECT query_id, id AS chunk_id, document_id, pos - 1 AS rank FROM (SELECT *, row_number() OVER
 (PARTITION BY query_id ORDER BY rank) AS pos FROM cap WHERE nth <= 2) WHERE pos <= 5""",
    ),
    "search_fallback": (
        search_fallback,
        f"""WITH RECURSIVE {S.chunks()}, {S.bm25(
            "(SELECT id, document_id, text AS body FROM ch SEMI JOIN (SELECT CAST(doc_id AS VARCHAR) AS document_id FROM labels WHERE toxic = 1) USING (document_id))",
            _RARE, 20, "document_id")},
c5 AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS rank, document_id,
   id AS chunk_id, 'chunk' AS level, score FROM (SELECT *, row_number() OVER
   (PARTITION BY query_id, document_id ORDER BY rank) AS nth FROM bm) WHERE nth <= 2),
{S.bm25(DOC_BODY, _RARE, 2).replace("bm", "bd")}
SELECT * FROM c5 WHERE rank < 5 UNION ALL SELECT query_id, rank, id, NULL, 'document', score FROM bd
 WHERE query_id NOT IN (SELECT query_id FROM c5)""",
    ),
    "hydrate_left_join": (
        hydrate_left_join,
        f"""SELECT d.id, file_name, length(raw_text) AS n_chars, summary FROM {S.DOCUMENTS} d
 JOIN {S.CONTENT} c ON c.document_id = d.id LEFT JOIN {S.METADATA} m ON m.document_id = d.id""",
    ),
    "parent_promote": (
        parent_promote,
        f"WITH RECURSIVE {S.chunks()} SELECT id, CASE WHEN chunk_index = 0 THEN text ELSE parent_text END AS text FROM ch",
    ),
}
