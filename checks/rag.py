"""Context assembly, answer clean-up and benchmark reports over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sqlparts as S
from checks import views as V
from checks.retrieval import CHUNK_BODY, DOC_BODY
from lorekeep.functions import text as X
from lorekeep.operators import assembly as A
from lorekeep.plans import evaluate as E
from lorekeep.plans import search as P

LONG = "long"


def _document_hits(spark, d, k=5):
    return P.hybrid_search(V.corpus(spark, d, False), V.questions(spark, d), k=k, mode="fts")


def _chunk_hits(spark, d, k=8):
    """Chunk hits; the chunk number stands for a page and the language for a section."""
    hits = P.hybrid_search_chunks(V.corpus(spark, d), V.questions(spark, d), k=k, mode="fts", per_document=3)
    langs = V.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "lang")
    return hits.join(langs, "document_id").withColumns(
        {"page_number": F.col("chunk_index"), "section": F.when(F.col("lang") != "en", F.col("lang"))}
    )


def context_budget(spark, d):
    found = A.document_context(_document_hits(spark, d))
    return found.select("query_id", "context", F.array_join("sources", "|").alias("sources"))


def context_passage(spark, d):
    """Contexts of the passages that match the questions best, not of the documents' heads."""
    hits = A.with_passages(_document_hits(spark, d), V.questions(spark, d), A.DOCUMENT_CHARS)
    found = A.document_context(hits)
    return found.select("query_id", "context", F.array_join("sources", "|").alias("sources"))


def context_index(spark, d):
    found = A.chunk_context(_chunk_hits(spark, d))
    return found.select("query_id", "context", F.array_join("sources", "|").alias("sources"))


def xml_context(spark, d):
    return A.web_context(_chunk_hits(spark, d)).select("query_id", "context")


def source_labels(spark, d):
    return A.web_context(_chunk_hits(spark, d)).select("query_id", F.array_join("sources", "|").alias("labels"))


def prompts(spark, d):
    """Prompts of all questions; those of a rare language have no hits and keep the fixed text."""
    hits = _document_hits(spark, d).where("rank < 3 and score > 20")
    found = A.with_prompts(V.questions(spark, d), A.document_context(hits))
    return found.select("query_id", "prompt", F.size("sources").cast(LONG).alias("n_sources"))


def sse_frames(spark, d):
    found = A.web_context(_chunk_hits(spark, d)).select("query_id", "sources")
    frame = X.sse_frame(F.to_json(F.struct("sources", F.lit("").alias("chunk"))))
    return found.select("query_id", frame.alias("frame"))


_CHUNK_HITS = f"""WITH RECURSIVE {S.chunks()}, {S.bm25(CHUNK_BODY, S.QUESTIONS, 20, "document_id")},
cap AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY rank) AS nth FROM bm),
hp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS pos FROM cap WHERE nth <= 3),
h AS (SELECT query_id, pos AS rank, 'doc_' || hp.document_id || '.txt' AS file_name, parent_text AS text,
  CASE WHEN lang <> 'en' THEN lang END AS section, chunk_index AS page FROM hp JOIN ch ON ch.id = hp.id
  JOIN documents ON CAST(doc_id AS VARCHAR) = hp.document_id WHERE pos < 8)"""
_BUDGET = """b AS (SELECT *, coalesce(sum(length({text})) OVER (PARTITION BY query_id ORDER BY rank
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM h),
k AS (SELECT *, substr({text}, 1, CAST(6000 - used AS BIGINT)) AS snip FROM b WHERE used < 6000)"""
_CITE = """CASE WHEN section IS NULL AND page = 0 THEN '' ELSE ' (' || concat_ws(', ', section,
  CASE WHEN page <> 0 THEN 'p.' || page END) || ')' END"""
_DOC_HITS = f"""WITH {S.bm25(DOC_BODY, S.QUESTIONS, 20)}, h AS (SELECT query_id, rank, score,
 'doc_' || id || '.txt' AS file_name, substr(text, 1, 2000) AS text FROM bm JOIN documents ON CAST(doc_id AS VARCHAR) = id
 WHERE rank < 5)"""
_PASSAGES = f"""WITH {S.bm25(DOC_BODY, S.QUESTIONS, 20)}, h0 AS (SELECT bm.query_id, rank, 'doc_' || id || '.txt' AS file_name, text AS whole,
 (SELECT list_distinct({S.tokens("q.text")}) FROM benchmark q WHERE q.item_id = bm.query_id) AS words
 FROM bm JOIN documents ON CAST(doc_id AS VARCHAR) = id WHERE rank < 5),
w AS (SELECT query_id, rank, file_name, words, i, substr(whole, i * 1000 + 1, 2000) AS text FROM
 (SELECT *, unnest(range(greatest(1, CAST(ceil(length(whole) / 1000.0) AS BIGINT) - 1))) AS i FROM h0)),
h AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY query_id, rank
 ORDER BY len(list_intersect(words, {S.tokens("text")})) DESC, i) = 1)"""
_PROMPT_SQL = f"""{_DOC_HITS.replace("rank < 5", "rank < 3 AND score > 20")}, {_BUDGET.format(text="text")},
c AS (SELECT query_id, string_agg('--- Document : ' || file_name || ' ---' || chr(10) || snip, chr(10) || chr(10)
  ORDER BY rank) AS context, count(*) AS n FROM k GROUP BY query_id)
SELECT item_id AS query_id, 'Sources:' || chr(10) || coalesce(context, '(aucun document trouvé)') || chr(10) || chr(10)
 || 'Question, to be answered from these sources: ' || text || chr(10) AS prompt,
 coalesce(n, 0) AS n_sources FROM benchmark LEFT JOIN c ON query_id = item_id"""
_LABEL = """concat_ws(' - ', file_name, CASE WHEN page <> 0 THEN 'p.' || page END, section)"""
_LABELS = f"""{_CHUNK_HITS}, l AS (SELECT query_id, {_LABEL} AS label, min(rank) AS r FROM h GROUP BY 1, 2)"""


def citation_string(spark, d):
    rows = V.read(spark, d, "conversations")
    section = F.when(F.col("role") == "user", F.substring("text", 1, 20))
    page = F.when(F.col("turn") != 2, F.col("turn"))
    return rows.select(
        "conv_id", "turn", X.citation(section, page).alias("with_zero"), X.citation(section, page, False).alias("without_zero")
    )


def strip_thinking(spark, d):
    """Answers with reasoning blocks made from what users and assistants said."""
    t = F.col("text")
    mark = X.CHANNEL_MARK
    raw = (
        F.when(F.col("role") == "user", F.concat(F.lit("<think>"), t, F.lit("</think>\n a "), t, F.lit("<THINK>b</THINK>")))
        .when(F.col("turn") == 1, F.concat(F.lit(f"{mark} thought "), t, F.lit(f"{mark}final\n"), t))
        .when(F.col("turn") == 3, F.concat(t, F.lit(f"{mark}Thought"), t))
        .otherwise(F.concat(F.lit(f"x{mark}y "), t, F.lit(" ")))
    )
    return V.read(spark, d, "conversations").select("conv_id", "turn", X.strip_thinking(raw).alias("answer"))


def llm_json_parse(spark, d):
    """Model answers: complete, without keywords, or no JSON at all."""
    whole = F.to_json(
        F.struct(F.concat(F.lit(" "), F.col("text"), F.lit("\n")).alias("summary"), F.array(F.col("role"), F.lit("  "), F.lit(" k ")).alias("keywords"))
    )
    answer = (
        F.when(F.col("turn") == 0, whole)
        .when(F.col("turn") == 1, F.to_json(F.struct(F.col("text").alias("summary"), F.array(F.lit(" ")).alias("keywords"))))
        .when(F.col("turn") == 2, F.col("text"))
        .otherwise(whole)
    )
    rows = V.read(spark, d, "conversations").select("conv_id", "turn", X.parse_analysis(answer).alias("a"))
    return rows.select("conv_id", "turn", "a.summary", F.array_join("a.keywords", "|").alias("keywords"))


def _points(spark, d):
    """Labels as judged answers: one model per language, four criteria."""
    rows = V.read(spark, d, "labels").join(V.read(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("criterion"), p.cast(LONG).alias("points"))
            for c, p in (("F", F.col("quality") * 2), ("P", 2 - F.col("toxic")), ("C", F.col("quality")), ("H", F.lit(2)))
        ]
    )
    return rows.select(F.col("doc_id").alias("id"), F.col("lang").alias("model"), F.inline(entries))


def report_scores(spark, d):
    runs = V.read(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("model"), (F.col("n_chars") / 10).alias("elapsed_s")
    )
    found = E.score_report(_points(spark, d), runs)
    return found.withColumns({"score10": F.round("score10", 6), "mean_latency": F.round("mean_latency", 6)})


def unpivot_scores(spark, d):
    """Nested judge scores, one struct per model, to one row per point."""
    rows = V.read(spark, d, "labels").select(
        F.col("doc_id").alias("id"),
        *[
            F.struct((F.col(a) * 2).alias("F"), F.col(a).alias("P"), F.col(b).alias("C"), F.lit(1).alias("H")).alias(m)
            for m, a, b in (("model_a", "quality", "toxic"), ("model_b", "toxic", "quality"))
        ],
    )
    return E.unpivot_scores(rows, ["model_a", "model_b"])


def _arm(spark, d, kind):
    rows = V.read(spark, d, "events").where(F.col("event_type") == kind)
    return rows.select(
        F.col("user_id").alias("id"), F.array(F.get_json_object("props", "$.k").substr(1, 1)).alias("context_sources"),
        F.col("value").alias("elapsed_s"), F.col("event_id").alias("position"),
    )


def _compared(spark, d):
    return E.compare_arms(_arm(spark, d, "click"), _arm(spark, d, "view"))


def compare_arms(spark, d):
    rows = _compared(spark, d)
    return rows.select(
        "id", F.array_join("base_sources", "|").alias("base_sources"), F.array_join("chunk_sources", "|").alias("chunk_sources"),
        "base_latency", "chunk_latency", "same_sources",
    )


def comparison_summary(spark, d):
    found = E.comparison_summary(_compared(spark, d))
    return found.select(
        "questions", "same_sources", *[F.round(c, 6).alias(c) for c in ("base_mean", "chunk_mean", "delta_percent")]
    )


def differing_sources(spark, d):
    return E.differing_sources(_compared(spark, d)).select("id")


def first_last_dedup(spark, d):
    rows = V.read(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    first = E.first_per_key(rows, "conv_id", "turn").select("conv_id", F.col("text").alias("first_text"))
    last = E.first_per_key(rows, "conv_id", "turn", last=True)
    return last.select("conv_id", F.col("turn").alias("last_turn"), F.col("text").alias("last_text")).join(first, "conv_id")


def markdown_rows(spark, d):
    runs = V.read(spark, d, "conversations").select(
        F.col("conv_id").alias("id"), F.col("role").alias("theme"), F.concat(F.lit("hub/org/m"), F.col("turn")).alias("model"),
        F.col("turn").alias("elapsed_s"), F.concat(F.col("text"), F.lit(" | end")).alias("answer"),
        F.array(F.lit("a/b/one.txt"), F.col("role")).alias("context_sources"),
    )
    return E.markdown_rows(runs, 150, with_sources=True)


def distinct_sources(spark, d):
    """Sources of the events of each user in order of first appearance (event types)."""
    rows = V.read(spark, d, "conversations").withColumnsRenamed({"conv_id": "query_id", "turn": "rank"})
    first = rows.groupBy("query_id").agg(A.distinct_in_order("role").alias("roles"))
    return first.select("query_id", F.array_join("roles", "|").alias("roles"))


_JSON = """SELECT conv_id, turn, CASE WHEN turn IN (1, 2) THEN 'No summary available (LLM failed)' ELSE trim(text, {ws}) END AS summary,
 CASE WHEN turn IN (1, 2) THEN 'error|fallback' ELSE role || '|k' END AS keywords FROM conversations"""
_POINTS = """p AS (SELECT doc_id AS id, lang AS model, quality * 2 AS f, 2 - toxic AS p, quality AS c, 2 AS h, n_chars
 FROM labels JOIN documents USING (doc_id))"""
_ARMS = """a AS (SELECT user_id AS id, substr(json_extract_string(props, '$.k'), 1, 1) AS src, value, event_id, event_type FROM events),
l AS (SELECT id, arg_min(src, event_id) AS base_sources, arg_min(value, event_id) AS base_latency FROM a WHERE event_type = 'click' GROUP BY id),
r AS (SELECT id, arg_max(src, event_id) AS chunk_sources, arg_max(value, event_id) AS chunk_latency FROM a WHERE event_type = 'view' GROUP BY id),
x AS (SELECT id, base_sources, chunk_sources, base_latency, chunk_latency, coalesce(base_sources = chunk_sources, false) AS same_sources
 FROM r LEFT JOIN l USING (id))"""

CHECKS = {
    "context_budget": (
        context_budget,
        f"""{_DOC_HITS}, {_BUDGET.format(text="text")} SELECT query_id, string_agg('--- Document : ' || file_name || ' ---'
 || chr(10) || snip, chr(10) || chr(10) ORDER BY rank) AS context, string_agg(file_name, '|' ORDER BY rank) AS sources FROM k GROUP BY query_id""",
    ),
    "context_passage": (
        context_passage,
        f"""{_PASSAGES}, {_BUDGET.format(text="text")} SELECT query_id, string_agg('--- Document : ' || file_name || ' ---'
 || chr(10) || snip, chr(10) || chr(10) ORDER BY rank) AS context, string_agg(file_name, '|' ORDER BY rank) AS sources FROM k GROUP BY query_id""",
    ),
    "context_index": (
        context_index,
        f"""{_CHUNK_HITS}, {_BUDGET.format(text="text")},
x AS (SELECT *, (SELECT count(DISTINCT o.file_name) FROM k o WHERE o.query_id = k.query_id AND o.rank < k.rank) + 1 AS n FROM k),
f AS (SELECT query_id, file_name, min(rank) AS r FROM k GROUP BY ALL)
SELECT query_id, string_agg('<document index="' || n || '">' || chr(10) || '  <source>' || file_name || {_CITE} || '</source>'
 || chr(10) || '  <content>' || snip || '</content>' || chr(10) || '</document>', chr(10) || chr(10) ORDER BY rank) AS context,
 (SELECT string_agg(file_name, '|' ORDER BY r) FROM f WHERE f.query_id = x.query_id) AS sources FROM x GROUP BY query_id""",
    ),
    "xml_context": (
        xml_context,
        f"""{_CHUNK_HITS} SELECT query_id, string_agg('<document index="' || (rank + 1) || '">' || chr(10) || '  <source>' || file_name
 || CASE WHEN page <> 0 THEN ' - Page ' || page ELSE '' END || '</source>' || chr(10) || '  <content>' || text || '</content>'
 || chr(10) || '</document>' || chr(10), chr(10) ORDER BY rank) AS context FROM h GROUP BY query_id""",
    ),
    "source_labels": (
        source_labels,
        f"{_LABELS} SELECT query_id, string_agg(label, '|' ORDER BY r) AS labels FROM l GROUP BY query_id",
    ),
    "rag_prompts": (prompts, _PROMPT_SQL),
    "sse_frames": (
        sse_frames,
        f"""{_LABELS} SELECT query_id, 'data: {{"sources":[' || string_agg('"' || label || '"', ',' ORDER BY r)
 || '],"chunk":""}}' || chr(10) || chr(10) AS frame FROM l GROUP BY query_id""",
    ),
    "citation_string": (
        citation_string,
        """SELECT conv_id, turn, concat_ws(', ', CASE WHEN role = 'user' THEN substr(text, 1, 20) END, CASE WHEN turn <> 2 THEN 'p.' || turn END)
 AS with_zero, concat_ws(', ', CASE WHEN role = 'user' THEN substr(text, 1, 20) END, CASE WHEN turn NOT IN (0, 2) THEN 'p.' || turn END)
 AS without_zero FROM conversations""",
    ),
    "strip_thinking": (
        strip_thinking,
        f"""SELECT conv_id, turn, CASE WHEN role = 'user' THEN trim('a ' || text, {S.WS}) WHEN turn = 1 THEN trim('final' || chr(10) || text, {S.WS})
 WHEN turn = 3 THEN trim(text, {S.WS}) ELSE trim('y ' || text, {S.WS}) END AS answer FROM conversations""",
    ),
    "llm_json_parse": (llm_json_parse, _JSON.format(ws=S.WS)),
    "report_scores": (
        report_scores,
        f"""WITH {_POINTS} SELECT model, CAST(sum(f) AS BIGINT) AS "points_F", CAST(sum(p) AS BIGINT) AS "points_P",
 CAST(sum(c) AS BIGINT) AS "points_C", CAST(sum(h) AS BIGINT) AS "points_H", CAST(sum(f + p + c + h) AS BIGINT) AS total,
 count(*) * 8 AS maximum, round(avg(n_chars / 10), 6) AS mean_latency,
 round(sum(f + p + c + h) / (count(*) * 8) * 10, 6) AS score10 FROM p GROUP BY model""",
    ),
    "unpivot_scores": (
        unpivot_scores,
        """SELECT doc_id AS id, model, criterion, CAST(points AS BIGINT) AS points FROM labels, LATERAL (VALUES
 ('model_a', 'F', quality * 2), ('model_a', 'P', quality), ('model_a', 'C', toxic), ('model_a', 'H', 1),
 ('model_b', 'F', toxic * 2), ('model_b', 'P', toxic), ('model_b', 'C', quality), ('model_b', 'H', 1)) v(model, criterion, points)""",
    ),
    "compare_arms": (compare_arms, f"WITH {_ARMS} SELECT * FROM x"),
    "comparison_summary": (
        comparison_summary,
        f"""WITH {_ARMS} SELECT count(*) AS questions, count(*) FILTER (same_sources) AS same_sources, round(avg(base_latency), 6) AS base_mean,
 round(avg(chunk_latency), 6) AS chunk_mean, round((avg(chunk_latency) - avg(base_latency)) / avg(base_latency) * 100, 6) AS delta_percent FROM x""",
    ),
    "differing_sources": (
        differing_sources,
        f"WITH {_ARMS} SELECT id FROM x WHERE base_sources IS DISTINCT FROM chunk_sources",
    ),
    "first_last_dedup": (
        first_last_dedup,
        """SELECT conv_id, max(turn) AS last_turn, arg_max(text, turn) AS last_text, arg_min(text, turn) AS first_text
 FROM conversations GROUP BY conv_id""",
    ),
    "markdown_rows": (
        markdown_rows,
        """SELECT conv_id AS id, 'hub/org/m' || turn AS model, '| ' || conv_id || ' | ' || role || ' | m' || turn || ' | ' || turn || ' | one.txt, '
 || role || ' | ' || substr(replace(replace(text || ' | end', '|', '/'), chr(10), ' '), 1, 150) || ' |' AS line FROM conversations""",
    ),
    "distinct_sources": (
        distinct_sources,
        """SELECT conv_id AS query_id, string_agg(role, '|' ORDER BY t) AS roles FROM
 (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY ALL) GROUP BY conv_id""",
    ),
}
