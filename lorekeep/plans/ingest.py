"""Ingestion: files in, four consistent tables out."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.backends import Chat, Describer, Embedder, answer_column, embed_column
from lorekeep.backends import extractive_answer
from lorekeep.functions import text as X
from lorekeep.functions.chunks import ChunkRules, chunk_elements
from lorekeep.functions.elements import ELEMENTS, attach_sections, elements_to_text, typed
from lorekeep.operators.common import broadcast_if_small, materialize, unnest
from lorekeep.operators.dedup import classify_files, missing_documents
from lorekeep.operators.keyterms import DocumentFrequencies
from lorekeep.operators.upkeep import refused_keys
from lorekeep.schemas import PRIMARY_KEY
from lorekeep.sources.files import has_extension, not_excluded
from lorekeep.sources.listing import list_files, with_contents
from lorekeep.sources.router import extract_elements
from lorekeep.session import KnowledgeBase

DEFAULT_CATEGORY = "Uncategorized"
OUTCOME = ["path", "id", "status", "n_chunks", "detail"]


def _vector(embedder: Embedder | None, dim: int, text: Column) -> Column:
    if embedder is None:
        return F.lit(None).cast("array<float>")
    return F.when(X.strip(text) != "", embed_column(embedder, dim)(text))


def analyze(
    rows: DataFrame,
    analyzer: Chat | None = None,
    shorten: Callable[[Column], Column] | None = None,
    frequencies: DocumentFrequencies | None = None,
) -> DataFrame:
    """``document_id, summary, keywords``; without a model the text speaks for itself.

    ``frequencies`` makes its keywords those that tell it from other documents (tf-idf).

    A model reads a long text piece by piece; summaries are joined in order,
    keywords of all pieces are kept once, and a summary ends with the number of
    pieces that the model failed on, if there are any. ``shorten`` shows it one shortened
    text instead: ``head_and_tail``, or ``llm_input``, the plain cut.
    """
    if analyzer is None:
        told = frequencies.keywords(F.col("raw_text")) if frequencies else None
        answer = extractive_answer(F.col("raw_text"), told)
    elif shorten is not None:
        answer = answer_column(analyzer)(shorten(F.col("raw_text")))
    else:
        return _analyzed_in_pieces(rows, analyzer)
    told = rows.select("document_id", answer.alias("_answer"))
    return told.select("document_id", X.parse_analysis(F.col("_answer")).alias("_a")).select(
        "document_id", "_a.summary", "_a.keywords"
    )


def _analyzed_in_pieces(rows: DataFrame, analyzer: Chat) -> DataFrame:
    size = X.LLM_INPUT_CHARS
    pieces = F.regexp_extract_all(F.coalesce("raw_text", F.lit("")), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    pieces = F.when(F.size(pieces) > 0, pieces).otherwise(F.array(F.lit("")))
    one = rows.select("document_id", F.posexplode(pieces).alias("n", "piece"))
    told = one.select("document_id", "n", X.parse_analysis(answer_column(analyzer)(F.col("piece"))).alias("a"))
    told = told.withColumn("ok", F.col("a.summary") != X.FAILED_SUMMARY)
    good = told.groupBy("document_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct("n", "a")))).alias("good"),
        F.first("a").alias("any"),
        F.count(F.lit(1)).alias("n_pieces"),
    )
    words = F.array_distinct(F.flatten(F.transform("good", lambda g: g["a"]["keywords"])))
    some = F.size("good") > 0
    lost = F.col("n_pieces") - F.size("good")
    mark = F.when(lost > 0, F.format_string(" [%d of %d parts without an analysis]", lost, F.col("n_pieces"))).otherwise("")
    summary = F.concat(F.array_join(F.transform("good", lambda g: g["a"]["summary"]), " "), mark)
    return good.select(
        "document_id",
        F.when(some, summary).otherwise(F.col("any.summary")).alias("summary"),
        F.when(some, words).otherwise(F.col("any.keywords")).alias("keywords"),
    )


def build_chunks(rows: DataFrame, rules: ChunkRules = ChunkRules()) -> DataFrame:
    """Chunk rows from ``document_id, elements``."""
    found = unnest(rows, ["document_id"], chunk_elements(F.col("elements"), rules))
    return found.withColumn("id", X.chunk_id(F.col("document_id"), F.col("chunk_index")))


def ingest_files(
    kb: KnowledgeBase,
    files: DataFrame,
    category: str = DEFAULT_CATEGORY,
    with_chunks: bool = True,
    force: bool = False,
    embedder: Embedder | None = None,
    analyzer: Chat | None = None,
    describer: Describer | None = None,
    rules: ChunkRules = ChunkRules(),
    frequencies: DocumentFrequencies | None = None,
) -> DataFrame:
    """Ingest ``path, content`` rows; returns one outcome row per file.

    Files are hashed and classified first, on their paths and hashes only.
    Contents of unchanged files are not extracted, described, analysed or
    embedded. Everything new, all replacements and the removal of old versions
    become visible in one commit; a failed file keeps its old version.
    """
    keep = partial(materialize, fallback=f"{kb.root}/_staging")
    hashed = files.select("path", X.content_hash(F.col("content")).alias("id"))
    state = keep(classify_files(keep(hashed), kb.documents, force))
    wanted = state.where(F.col("status").isin("new", "updated"))

    chosen, _ = broadcast_if_small(wanted.select("path", "id", "status", "old_id"))
    fresh = files.select("path", "content").join(chosen, "path")
    found = extract_elements(fresh, describer, kb.settings.vision_dpi).drop("content")
    found = keep(found.withColumn("raw_text", elements_to_text(F.col("elements"))))

    failure = F.when(F.col("extract_error").isNotNull(), "parse_error").when(
        X.strip(F.col("raw_text")) == "", "empty"
    )
    found = found.withColumn("failure", failure)
    good = found.where(F.col("failure").isNull()).withColumn("document_id", F.col("id"))

    dim = kb.settings.embed_dim
    chunks = build_chunks(good, rules) if with_chunks else None
    counts = None
    inserts = {
        "documents": good.select(
            "id", X.basename(F.col("path")).alias("file_name"), F.col("path").alias("file_path"),
            F.lit(category).alias("category"), F.current_timestamp().alias("indexed_at"),
        ),
        "document_content": good.select(
            "document_id", "raw_text", _vector(embedder, dim, F.col("raw_text")).alias("embedding")
        ),
        "document_ai_metadata": analyze(good, analyzer, frequencies=frequencies),
    }
    if chunks is not None:
        inserts["chunks"] = chunks.withColumn("embedding", _vector(embedder, dim, F.col("text")))
    replaced = good.where(F.col("old_id").isNotNull()).select(F.col("old_id").alias("id"))
    if force:
        replaced = replaced.unionByName(good.select("id"))
    if not good.isEmpty():
        removed = {} if replaced.isEmpty() else kb.keys_of_documents(replaced)
        batch = kb.commit(inserts=inserts, removed=removed)
        if chunks is not None:
            # Counted where they were committed, so that chunks are written once.
            counts = kb.rows_of(batch, "chunks").groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("n_chunks"))

    result = state.join(found.select("path", "failure", "extract_error"), "path", "left")
    if counts is not None:
        result = result.join(counts, "id", "left")
    else:
        result = result.withColumn("n_chunks", F.lit(None).cast("long"))
    done = F.when(F.col("status") == "new", "ok").otherwise(F.col("status"))
    status = F.coalesce("failure", done)
    return result.select(
        "path", "id", status.alias("status"),
        F.when(status.isin("ok", "updated"), F.coalesce("n_chunks", F.lit(0))).otherwise(0).alias("n_chunks"),
        F.col("extract_error").alias("detail"),
    )


class KeysRefused(ValueError):
    """Rows were not inserted, as their keys are repeated, NULL or in use."""


def insert_rows(kb: KnowledgeBase, tables: dict[str, DataFrame]) -> int:
    """Insert rows of any number of tables in one commit, or none if any key is refused.

    The rows are written once before the check, so that what is checked is what is inserted. Writers that
    insert the same key at the same time are not told from each other.
    """
    written = {n: materialize(rows, f"{kb.root}/_staging") for n, rows in tables.items()}
    for name, rows in written.items():
        refused = refused_keys(rows, kb.table(name), PRIMARY_KEY[name]).limit(10).collect()
        if refused:
            told = ", ".join(f"{r[0]} ({'known' if r['known'] else 'NULL' if r[0] is None else 'repeated'})" for r in refused)
            raise KeysRefused(f"{name}: {told}")
    return kb.commit(inserts=written)


def sync_directory(kb: KnowledgeBase, present: DataFrame, directory: str) -> int:
    """Delete stored documents below ``directory`` whose file is gone; how many."""
    gone = materialize(
        missing_documents(kb.documents, present.select("path"), directory).select("id"),
        f"{kb.root}/_staging",
    )
    n = gone.count()
    if n:
        kb.purge(gone)
    return n


def ingest_directory(
    kb: KnowledgeBase,
    directory: str,
    extensions: list[str] | None = None,
    sync: bool = True,
    **options,
) -> DataFrame:
    """Ingest a folder tree, hidden and empty files included, then remove what no longer exists in it."""
    directory = kb.qualified(directory)
    listed = materialize(list_files(kb.spark, directory), f"{kb.root}/_staging")
    chosen = has_extension(F.col("path"), extensions) if extensions else has_extension(F.col("path"))
    wanted = listed.where(not_excluded(F.col("path")) & chosen)
    outcome = ingest_files(kb, with_contents(wanted).drop("length"), **options)
    if sync:
        sync_directory(kb, list_files(kb.spark, directory).select("path"), directory)
    return outcome


def _narrative(raw_text: Column) -> Column:
    found = F.transform(X.lines(raw_text), lambda line: typed(line, "NarrativeText"))
    return attach_sections(found).cast(ELEMENTS)


def rechunk(
    kb: KnowledgeBase,
    files: DataFrame | None = None,
    embedder: Embedder | None = None,
    rules: ChunkRules = ChunkRules(),
) -> int:
    """Rebuild all chunks: from the files where given, else from the stored text."""
    rows = kb.documents.select(F.col("id").alias("document_id"), F.col("file_path").alias("path"))
    rows = rows.join(kb.content.select("document_id", "raw_text"), "document_id")
    if files is None:
        rows = rows.withColumn("elements", _narrative(F.col("raw_text")))
    else:
        read = extract_elements(files).select("path", F.col("elements").alias("_read"))
        rows = rows.join(read, "path", "left").withColumn(
            "elements",
            F.when(F.size("_read") > 0, F.col("_read")).otherwise(_narrative(F.col("raw_text"))),
        )
    chunks = build_chunks(rows, rules)
    vector = _vector(embedder, kb.settings.embed_dim, F.col("text"))
    return kb.commit(
        inserts={"chunks": chunks.withColumn("embedding", vector)},
        removed={"chunks": kb.chunks.select("id")},
    )
