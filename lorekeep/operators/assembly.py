"""Context assembly: budgets, numbering, labels and prompts per query."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import bind, citation, rag_prompt, source_label, xml_document
from lorekeep.functions.tokens import Tokenizer

# Fixed values.
CONTEXT_CHARS = 6000
DOCUMENT_CHARS = 2000
WEB_DOCUMENT_CHARS = 3000
NO_DOCUMENT = "(aucun document trouvé)"
NO_DOCUMENT_WEB = "Aucun document trouvé."
NO_ANSWER = (
    "Je n'ai trouvé aucun document pertinent dans la base de connaissances pour cette question."
)


def _before(order: str = "rank"):
    """Rows ahead of the current one; groups are the few hits of a single query."""
    return Window.partitionBy("query_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def within_budget(
    hits: DataFrame, text: Column, total: int = CONTEXT_CHARS, each: int | None = None
) -> DataFrame:
    """Add ``snippet``; the hit that crosses the budget is cut, later ones go."""
    cut = F.coalesce(text, F.lit(""))
    if each is not None:
        cut = F.substring(cut, 1, each)
    used = F.coalesce(F.sum(F.length("_cut")).over(_before()), F.lit(0)).cast("int")
    return (
        hits.withColumn("_cut", cut)
        .withColumn("_used", used)
        .where(F.col("_used") < total)
        .withColumn("snippet", F.substring(F.col("_cut"), F.lit(1), F.lit(total) - F.col("_used")))
        .drop("_cut", "_used")
    )


def best_window(text: Column, query: Column, size: int, tokenizer: Tokenizer = Tokenizer()) -> Column:
    """The ``size`` characters of ``text`` that hold most different words of ``query``; of equals the first.

    Windows start every ``size // 2`` characters (``size`` must be even) and each is tokenised as it is cut, without stemming.
    The text is cut once, so the cost is linear in its length. NULL counts as empty; a query without words gives the head.
    """
    if size < 2 or size % 2:
        raise ValueError("size must be even")
    plain = replace(tokenizer, stem=False)
    wanted = F.array_distinct(plain.tokens(F.coalesce(query, F.lit(""))))
    halves = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?s).{{1,{size // 2}}}"), F.lit(0))

    def best(found: Column, words: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(found) - 2, F.lit(0)))
        windows = F.transform(starts, lambda i: F.concat(F.coalesce(F.get(found, i), F.lit("")), F.coalesce(F.get(found, i + 1), F.lit(""))))
        rated = F.transform(
            windows, lambda w, i: F.struct(F.size(F.array_intersect(words, plain.tokens(w))).alias("n"), (-i).alias("first"), w.alias("window"))
        )
        return F.array_max(rated)["window"]

    return bind(halves, lambda found: bind(wanted, lambda words: best(found, words)))


def with_passages(hits: DataFrame, queries: DataFrame, size: int, tokenizer: Tokenizer = Tokenizer()) -> DataFrame:
    """Document hits whose ``raw_text`` is the passage of ``size`` characters that matches their query best."""
    asked = queries.select("query_id", F.col("query").alias("_asked"))
    rows = hits.join(asked, "query_id", "left")
    return rows.withColumn("raw_text", best_window(F.col("raw_text"), F.col("_asked"), size, tokenizer)).drop("_asked")


def file_index(hits: DataFrame) -> DataFrame:
    """Add ``doc_index``: one more than the number of distinct files before the row."""
    earlier = F.size(F.collect_set("file_name").over(_before()))
    return hits.withColumn("doc_index", earlier + 1)


def ordered(column: Column | str, order: str = "rank") -> Column:
    """Aggregate of a query's few hits as an array in rank order."""
    value = F.col(column) if isinstance(column, str) else column
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), value.alias("_v"))))
    return F.transform(pairs, lambda p: p["_v"])


def distinct_in_order(column: Column | str) -> Column:
    return F.array_distinct(F.filter(ordered(column), lambda v: v.isNotNull()))


def document_context(hits: DataFrame) -> DataFrame:
    """``query_id, context, sources`` from document hits within the budget."""
    kept = within_budget(hits, F.col("raw_text"), each=DOCUMENT_CHARS)
    block = F.concat(
        F.lit("--- Document : "), F.col("file_name"), F.lit(" ---\n"), F.col("snippet")
    )
    return kept.groupBy("query_id").agg(
        F.array_join(ordered(block), "\n\n").alias("context"),
        ordered("file_name").alias("sources"),
    )


def chunk_context(hits: DataFrame) -> DataFrame:
    """``query_id, context, sources`` from chunk hits, cited and numbered by file."""
    kept = file_index(within_budget(hits, F.col("text")))
    cited = citation(F.col("section"), F.col("page_number"), keep_page_zero=False)
    source = F.concat(
        F.col("file_name"), F.when(cited != "", F.concat(F.lit(" ("), cited, F.lit(")"))).otherwise("")
    )
    block = xml_document(F.col("doc_index"), source, F.col("snippet"))
    return kept.groupBy("query_id").agg(
        F.array_join(ordered(block), "\n\n").alias("context"),
        distinct_in_order("file_name").alias("sources"),
    )


def web_context(hits: DataFrame) -> DataFrame:
    """``query_id, context, sources`` for the chat page: all hits, page in the source."""
    position = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    source = F.concat(
        F.col("file_name"),
        F.when(F.col("page_number") != 0, F.concat(F.lit(" - Page "), F.col("page_number"))).otherwise(""),
    )
    block = F.concat(xml_document(F.col("_n"), source, F.col("text")), F.lit("\n"))
    label = source_label(F.col("file_name"), F.col("page_number"), F.col("section"))
    return (
        hits.withColumn("_n", position)
        .groupBy("query_id")
        .agg(
            F.array_join(ordered(block), "\n").alias("context"),
            distinct_in_order(label).alias("sources"),
        )
    )


def web_document_context(hits: DataFrame, each: int = WEB_DOCUMENT_CHARS) -> DataFrame:
    block = F.concat(
        F.lit("--- Document: "), F.col("file_name"), F.lit(" ---\n"),
        F.substring(F.coalesce(F.col("raw_text"), F.lit("")), 1, each), F.lit("\n\n"),
    )
    return hits.groupBy("query_id").agg(
        F.array_join(ordered(block), "").alias("context"),
        ordered("file_name").alias("sources"),
    )


def with_prompts(queries: DataFrame, contexts: DataFrame, missing: str = NO_DOCUMENT) -> DataFrame:
    """Every query with its context and prompt, also those without any hit."""
    rows = queries.join(contexts, "query_id", "left")
    no_sources = F.array().cast("array<string>")
    return (
        rows.withColumn("context", F.coalesce("context", F.lit(missing)))
        .withColumn("sources", F.coalesce("sources", no_sources))
        .withColumn("prompt", rag_prompt(F.col("query"), F.col("context")))
    )
