"""Ingestion states, validation, backfill and migration over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from checks import views as V
from checks import sqlparts as S
from lorekeep import KnowledgeBase, Settings
from lorekeep.functions import text as X
from lorekeep.operators import dedup, upkeep
from lorekeep.operators.common import shared_folder
from lorekeep.plans import migrate
from lorekeep.schemas import DOCUMENT_KEY, VECTOR

LONG = "long"


def pending_embeddings(spark, d):
    rows = upkeep.pending(V.content(spark, d), V.documents(spark, d), "raw_text", ["document_id"])
    return rows.select("document_id", F.length("raw_text").cast(LONG).alias("n_chars"))


def pending_first(spark, d):
    """The ordered head that `--limit` asks for."""
    rows = upkeep.pending(V.content(spark, d), V.documents(spark, d), "raw_text", ["document_id"], limit=25)
    return rows.select("document_id")


def pending_chunks(spark, d):
    rows = upkeep.pending(V.derived_chunks(spark, d), V.documents(spark, d), "text", ["document_id", "chunk_index"])
    return rows.select("id", "document_id")


def user_filter_expr(spark, d):
    rows = upkeep.pending(
        V.content(spark, d), V.documents(spark, d), "raw_text", ["document_id"], rebuild=True,
        filter_sql="file_path ILIKE '%SRC1/%' AND category <> 'en'",
    )
    return rows.select("document_id")


def fill_vectors(spark, d):
    """Pending documents take the vector of the embedding with their length's number, if any."""
    rows = V.content(spark, d)
    fresh = (
        rows.where("embedding IS NULL").select("document_id", F.length("raw_text").alias("n"))
        .join(V.read(spark, d, "embeddings").select(F.col("vec_id").alias("n"), "embedding"), "n")
    )
    filled = upkeep.fill_vectors(rows, fresh, "document_id")
    return filled.select(
        "document_id", F.round(F.get("embedding", 0).cast("double"), 6).alias("first"), F.col("embedding").isNotNull().alias("has_vector")
    )


def corpus_status(spark, d):
    found = upkeep.corpus_status(V.documents(spark, d), V.derived_chunks(spark, d), V.metadata(spark, d), 299)
    return found.withColumn("mean_chunk_chars", F.round("mean_chunk_chars", 6))


def _incoming(spark, d):
    """Every document as a file; one name per language and source stands for two suffixes."""
    suffix = F.when(F.col("lang") == "de", ".exe").otherwise(".txt")
    return V.read(spark, d, "documents").select(
        F.concat(F.col("source"), F.lit("/doc_"), F.col("doc_id"), suffix).alias("path"),
        X.content_hash(F.encode("text", "UTF-8")).alias("id"),
        "doc_id", "text",
    )


def _stored(spark, d):
    """Labelled documents are stored; the toxic ones with an older content."""
    rows = _incoming(spark, d).join(V.read(spark, d, "labels"), "doc_id")
    older = X.content_hash(F.encode(F.concat("text", F.lit("!")), "UTF-8"))
    return rows.groupBy(F.when(F.col("toxic") == 1, older).otherwise(F.col("id")).alias("id")).agg(
        F.min("path").alias("file_path")
    )


def dedup_state(spark, d):
    return dedup.classify_files(_incoming(spark, d).select("path", "id"), _stored(spark, d))


_INCOMING = """in_f AS (SELECT source || '/doc_' || doc_id || CASE WHEN lang = 'de' THEN '.exe' ELSE '.txt' END AS path,
 sha256(text) AS id, doc_id, text FROM documents),
st_f AS (SELECT CASE WHEN toxic = 1 THEN sha256(text || '!') ELSE id END AS sid, min(path) AS file_path
 FROM in_f JOIN labels USING (doc_id) GROUP BY 1),
fp_f AS (SELECT id, min(path) AS first_path FROM in_f WHERE path NOT LIKE '%.exe' GROUP BY id),
cl_f AS (SELECT path, id, CASE WHEN id IN (SELECT sid FROM st_f) THEN 'dup' WHEN path LIKE '%.exe' THEN 'skip_binary'
 WHEN path <> first_path THEN 'dup' ELSE 'new' END AS s FROM in_f LEFT JOIN fp_f USING (id)),
state AS (SELECT path, id, CASE WHEN s = 'new' AND sid IS NOT NULL THEN 'updated' ELSE s END AS status,
 CASE WHEN s = 'new' THEN sid END AS old_id FROM cl_f LEFT JOIN st_f ON file_path = path)"""


def ingest_status_histogram(spark, d):
    state = dedup_state(spark, d)
    counts = V.plain_chunks(spark, d).groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    ids = _incoming(spark, d).select("path", F.col("doc_id").cast("string").alias("document_id"))
    outcome = state.join(ids, "path").join(counts, "document_id", "left")
    done = F.when(F.col("status").isin("new", "updated"), F.coalesce("n_chunks", F.lit(0))).otherwise(0)
    return dedup.status_histogram(outcome.withColumn("n_chunks", done))


def _tables(spark, d):
    return {
        "documents": V.documents(spark, d), "document_content": V.raw_texts(spark, d),
        "document_ai_metadata": V.metadata(spark, d), "chunks": V.plain_chunks(spark, d),
    }


def purge_cascade(spark, d):
    """Rows left per table of a knowledge base after the toxic documents are deleted."""
    base = KnowledgeBase(spark, f"{shared_folder(spark)}/kb-{uuid.uuid4().hex}", Settings(embed_dim=64))
    base.initialize()
    base.commit(inserts=_tables(spark, d))
    base.purge(V.read(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("id")))
    counts = [base.table(name).agg(F.count(F.lit(1)).alias("rows")).withColumn("table", F.lit(name)) for name in DOCUMENT_KEY]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


def sync_orphans(spark, d):
    """Stored files below one folder of which only the labelled ones still exist."""
    present = V.read(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id"))
    files = V.documents(spark, d).join(present, "id", "left_semi").select(F.col("file_path").alias("path"))
    return dedup.missing_documents(V.documents(spark, d), files, "src1/").select("id", "file_path")


def dup_key_check(spark, d):
    return upkeep.duplicate_keys(_incoming(spark, d), "id")


def refused_inserts(spark, d):
    """Contents that may not be inserted as new documents: twice among the incoming, or stored already."""
    return upkeep.refused_keys(_incoming(spark, d).select("id"), _stored(spark, d).select("id"), "id")


def fk_orphans(spark, d):
    labels = V.read(spark, d, "labels").select("doc_id")
    return upkeep.orphans(V.read(spark, d, "embeddings").select("vec_id"), labels, "vec_id", "doc_id")


def reindex_pending_anti(spark, d):
    done = V.metadata(spark, d)
    return upkeep.remaining(V.raw_texts(spark, d), done, "document_id").select("document_id")


def _legacy_keywords(spark, d):
    """Legacy metadata: JSON text per document, NULL for French, unreadable for German."""
    raw = (
        F.when(F.col("lang") == "fr", F.lit(None))
        .when(F.col("lang") == "de", F.concat(F.lit("["), F.col("source")))
        .otherwise(F.to_json(F.array("lang", "source")))
    )
    return V.read(spark, d, "documents").select("doc_id", raw.alias("keywords"))


def migrate_keywords_json(spark, d):
    rows = migrate.convert_keywords(_legacy_keywords(spark, d))
    return rows.select("doc_id", F.array_join("keywords", "+").alias("keywords"), F.size("keywords").cast(LONG).alias("n"))


def invalid_json_sample(spark, d):
    return migrate.invalid_json(_legacy_keywords(spark, d))


def add_missing_column(spark, d):
    old = V.plain_chunks(spark, d).select("id", "document_id", "text")
    new = migrate.add_missing(old, {"parent_text": StringType(), "embedding": VECTOR})
    return new.groupBy("document_id").agg(
        F.count("text").alias("texts"), F.count("parent_text").alias("parents"), F.count("embedding").alias("vectors")
    )


def eta_metrics(spark, d):
    log = V.read(spark, d, "events").select((F.col("event_type") != "error").alias("ok"), F.col("value").alias("seconds"))
    found = upkeep.progress(log, 150_000)
    return found.select("done", "failed", F.round("mean_seconds", 6).alias("mean_seconds"), F.round("eta_seconds", 3).alias("eta_seconds"))


def visual_keyword_report(spark, d):
    return upkeep.keyword_report(V.plain_chunks(spark, d), V.documents(spark, d), ("THING", "eaux", "ción", "capture"))


CHECKS = {
    "pending_embeddings": (
        pending_embeddings,
        f"SELECT document_id, length(raw_text) AS n_chars FROM {S.CONTENT} WHERE length(coalesce(raw_text, '')) > 0 AND embedding IS NULL",
    ),
    "pending_first": (
        pending_first,
        f"SELECT document_id FROM {S.CONTENT} WHERE length(coalesce(raw_text, '')) > 0 AND embedding IS NULL ORDER BY 1 LIMIT 25",
    ),
    "pending_chunks": (
        pending_chunks,
        f"WITH RECURSIVE {S.chunks()} SELECT id, document_id FROM {S.CHUNK_VECTORS} WHERE embedding IS NULL",
    ),
    "user_filter_expr": (
        user_filter_expr,
        f"SELECT id AS document_id FROM {S.DOCUMENTS} WHERE file_path ILIKE '%SRC1/%' AND category <> 'en'",
    ),
    "fill_vectors": (
        fill_vectors,
        f"""SELECT document_id, round(CAST(coalesce(c.embedding, e.embedding)[1] AS DOUBLE), 6) AS first,
 coalesce(c.embedding, e.embedding) IS NOT NULL AS has_vector FROM {S.CONTENT} c
 LEFT JOIN embeddings e ON e.vec_id = length(raw_text)""",
    ),
    "embed_coverage_status": (
        corpus_status,
        f"""WITH RECURSIVE {S.chunks()}, n AS (SELECT count(*) AS documents FROM documents)
SELECT documents, CAST(299 AS BIGINT) AS expected, CAST(documents * 100 // 299 AS BIGINT) AS percent, 299 - documents AS "left", chunks,
 embedded_chunks, mean_chunk_chars, summaries FROM n,
 (SELECT count(*) AS chunks, count(e.vec_id) AS embedded_chunks, round(avg(length(text)), 6) AS mean_chunk_chars
  FROM ch LEFT JOIN embeddings e ON CAST(vec_id AS VARCHAR) = ch.document_id),
 (SELECT count(*) AS summaries FROM {S.METADATA} WHERE summary NOT LIKE 'No summary%' AND summary <> '')""",
    ),
    "dedup_state": (dedup_state, f"WITH {_INCOMING} SELECT * FROM state"),
    "ingest_status_histogram": (
        ingest_status_histogram,
        f"""WITH RECURSIVE {S.chunks()}, {_INCOMING}, k AS (SELECT document_id, count(*) AS n FROM ch GROUP BY 1)
SELECT status, count(*) AS files, CAST(sum(CASE WHEN status IN ('new', 'updated') THEN coalesce(n, 0) ELSE 0 END) AS BIGINT) AS chunks
FROM state JOIN in_f USING (path) LEFT JOIN k ON k.document_id = CAST(doc_id AS VARCHAR) GROUP BY status""",
    ),
    "purge_cascade": (
        purge_cascade,
        f"""WITH RECURSIVE {S.chunks()}, g AS (SELECT CAST(doc_id AS VARCHAR) AS gone FROM labels WHERE toxic = 1)
SELECT 'documents' AS "table", count(*) AS "rows" FROM documents WHERE CAST(doc_id AS VARCHAR) NOT IN (FROM g)
UNION ALL SELECT 'document_content', count(*) FROM documents WHERE CAST(doc_id AS VARCHAR) NOT IN (FROM g)
UNION ALL SELECT 'document_ai_metadata', count(*) FROM labels WHERE toxic <> 1
UNION ALL SELECT 'chunks', count(*) FROM ch WHERE document_id NOT IN (FROM g)""",
    ),
    "sync_orphans": (
        sync_orphans,
        f"SELECT id, file_path FROM {S.DOCUMENTS} WHERE file_path LIKE 'src1/%' AND CAST(id AS BIGINT) NOT IN (SELECT doc_id FROM labels)",
    ),
    "dup_key_check": (
        dup_key_check,
        "SELECT sha256(text) AS id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1",
    ),
    "refused_inserts": (
        refused_inserts,
        f"""WITH {_INCOMING} SELECT id, count(*) AS copies, id IN (SELECT sid FROM st_f) AS known FROM in_f GROUP BY id
HAVING count(*) > 1 OR id IN (SELECT sid FROM st_f)""",
    ),
    "fk_orphans": (fk_orphans, "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)"),
    "reindex_pending_anti": (
        reindex_pending_anti,
        "SELECT CAST(doc_id AS VARCHAR) AS document_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    ),
    "migrate_keywords_json": (
        migrate_keywords_json,
        """SELECT doc_id, CASE lang WHEN 'fr' THEN NULL WHEN 'de' THEN '' ELSE lang || '+' || source END AS keywords,
 CAST(CASE lang WHEN 'fr' THEN NULL WHEN 'de' THEN 0 ELSE 2 END AS BIGINT) AS n FROM documents""",
    ),
    "invalid_json_sample": (invalid_json_sample, "SELECT count(*) AS invalid FROM documents WHERE lang = 'de'"),
    "add_missing_column": (
        add_missing_column,
        f"WITH RECURSIVE {S.chunks()} SELECT document_id, count(*) AS texts, CAST(0 AS BIGINT) AS parents, CAST(0 AS BIGINT) AS vectors FROM ch GROUP BY 1",
    ),
    "eta_metrics": (
        eta_metrics,
        """SELECT count(*) FILTER (event_type <> 'error') AS done, count(*) FILTER (event_type = 'error') AS failed,
 round(avg(value), 6) AS mean_seconds, round(greatest(150000 - count(*), 0) * avg(value), 3) AS eta_seconds FROM events""",
    ),
    "visual_keyword_report": (
        visual_keyword_report,
        f"""WITH RECURSIVE {S.chunks()} SELECT file_name, count(*) AS n_chunks FROM ch JOIN {S.DOCUMENTS} d ON d.id = document_id
 WHERE text ILIKE '%THING%' OR text ILIKE '%eaux%' OR text ILIKE '%ción%' OR text ILIKE '%capture%'
 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
    ),
}
