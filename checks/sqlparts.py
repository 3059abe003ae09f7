"""Pieces of plain SQL that several checks share."""

from __future__ import annotations

from lorekeep.functions.text import WHITESPACE

WS = "'" + WHITESPACE + "'"

DOCUMENTS = """(SELECT CAST(doc_id AS VARCHAR) AS id, 'doc_' || doc_id || '.txt' AS file_name,
 source || '/doc_' || doc_id || '.txt' AS file_path, lang AS category FROM documents)"""

CONTENT = """(SELECT CAST(doc_id AS VARCHAR) AS document_id, text AS raw_text, embedding
 FROM documents LEFT JOIN embeddings ON vec_id = doc_id)"""

METADATA = """(SELECT CAST(doc_id AS VARCHAR) AS document_id, CASE WHEN toxic = 1
 THEN 'No summary available (LLM failed)' ELSE 'quality ' || quality || ', toxic ' || toxic END
 AS summary FROM labels)"""

CONTENT_TEXTS = "(SELECT CAST(doc_id AS VARCHAR) AS id, text AS body FROM documents)"

SPACES = "'[' || " + WS + " || ']+'"

QUESTIONS = """(SELECT item_id AS query_id, text AS query, embedding AS vector
 FROM benchmark LEFT JOIN embeddings ON vec_id = item_id)"""


def tokens(text: str, stop: tuple = ()) -> str:
    left_out = ", ".join(f"'{w}'" for w in ("", *stop))
    return (
        f"list_filter(string_split_regex(strip_accents(lower({text})), '[^a-z]+'), "
        f"lambda t: t NOT IN ({left_out}))"
    )


def lines(text: str) -> str:
    """Stripped, non-blank lines as a list."""
    breaks = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"
    return (
        f"list_filter(list_transform(string_split_regex({text}, '{breaks}'), "
        f"lambda l: trim(l, {WS})), lambda l: l <> '')"
    )


def bm25(texts: str, queries: str, pool: int, carry: str = "", stop: tuple = ()) -> str:
    """CTEs up to ``bm``: query_id, id, score, rank. ``texts``: id, body[, carry]."""
    more = f", {carry}" if carry else ""
    return f"""
bm_src AS (SELECT id{more}, {tokens("body", stop)} AS toks FROM {texts}),
bm_len AS (SELECT id{more}, len(toks) AS dl FROM bm_src),
bm_tf AS (SELECT id, term, count(*) AS tf
          FROM (SELECT id, unnest(toks) AS term FROM bm_src) GROUP BY id, term),
bm_df AS (SELECT term, count(*) AS df FROM bm_tf GROUP BY term),
bm_st AS (SELECT count(*) AS n, avg(dl) AS a FROM bm_len),
bm_q AS (SELECT DISTINCT query_id, unnest({tokens("query", stop)}) AS term FROM {queries}),
bm_sc AS (SELECT query_id, id{more}, round(sum(log10((n - df + 0.5) / (df + 0.5) + 1)
            * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score
          FROM bm_q JOIN bm_tf USING (term) JOIN bm_df USING (term) JOIN bm_len USING (id), bm_st
          GROUP BY query_id, id{more}),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
          ORDER BY score DESC, id) - 1 AS rank FROM bm_sc) WHERE rank < {pool})"""


def knn(vectors: str, queries: str, pool: int, carry: str = "") -> str:
    """CTEs up to ``nn``: query_id, id, score, rank. ``vectors``: id, embedding[, carry]."""
    more = f", {carry}" if carry else ""
    return f"""
nn_v AS (SELECT id{more}, CAST(embedding AS DOUBLE[]) AS e FROM {vectors}
         WHERE embedding IS NOT NULL),
nn_q AS (SELECT query_id, CAST(vector AS DOUBLE[]) AS v FROM {queries} WHERE vector IS NOT NULL),
nn_sc AS (SELECT query_id, id{more}, round(list_cosine_similarity(e, v), 8) AS score
          FROM nn_v, nn_q),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
          ORDER BY score DESC, id) - 1 AS rank FROM nn_sc) WHERE rank < {pool})"""


def rrf(carry: str = "") -> str:
    """CTEs up to ``fu`` (ranked by ``pos``) from ``bm`` and ``nn``."""
    more = f", coalesce(bm.{carry}, nn.{carry}) AS {carry}" if carry else ""
    return f"""
fu_j AS (SELECT coalesce(bm.query_id, nn.query_id) AS query_id, coalesce(bm.id, nn.id) AS id{more},
           bm.rank AS fr, nn.rank AS vr
         FROM bm FULL JOIN nn ON bm.query_id = nn.query_id AND bm.id = nn.id),
fu_s AS (SELECT *, coalesce((CASE WHEN vr < 8 AND fr = 0 THEN 3.0 WHEN vr < 8 AND fr = 1 THEN 2.0
             ELSE 1.0 END)::DOUBLE / (60 + fr + 1), 0) + coalesce(1.5::DOUBLE / (60 + vr + 1), 0)
             AS score,
           CASE WHEN fr IS NOT NULL AND vr IS NOT NULL THEN 'both' WHEN fr IS NOT NULL THEN 'fts'
             ELSE 'vector' END AS source FROM fu_j),
fu AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fr NULLS LAST,
           vr NULLS LAST, id) - 1 AS pos FROM fu_s)"""


def split(name: str, source: str, size: int, overlap: int) -> str:
    """Recursive CTE ``name``: key, part (0-based), piece. ``source``: key, body."""
    step = f"""
 (SELECT key, body, n, part, st, raw, lo, regexp_extract(substr(body, lo + 1, raw - lo),
     '(?s)^.*(?:[.!?] |\\n)') AS m
  FROM (SELECT *, greatest(st, raw - {size // 4}) AS lo
        FROM (SELECT *, least(st + {size}, n) AS raw FROM {{0}})))"""
    stop = f"""CASE WHEN raw < n AND m <> ''
      AND lo + length(m) - (CASE WHEN m LIKE '% ' THEN 1 ELSE 0 END) - 1 > st + {size // 2}
      THEN lo + length(m) - (CASE WHEN m LIKE '% ' THEN 1 ELSE 0 END) ELSE raw END"""
    first = f"(SELECT key, body, length(body) AS n, 0 AS part, 0 AS st FROM {source})"
    after = (
        f"(SELECT key, body, n, part + 1 AS part, greatest(0, en - {overlap}) AS st "
        f"FROM {name}_r WHERE en < n)"
    )
    return f"""
{name}_r AS (SELECT key, body, n, part, st, {stop} AS en FROM {step.format(first)}
 UNION ALL SELECT key, body, n, part, st, {stop} AS en FROM {step.format(after)}),
{name} AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY part) - 1 AS part, piece
 FROM (SELECT key, part, CASE WHEN n <= {size} THEN body
         ELSE trim(substr(body, st + 1, en - st), {WS}) END AS piece FROM {name}_r)
 WHERE piece <> '')"""


def chunks(cap: int | None = None) -> str:
    """CTEs up to ``ch``: document_id, chunk_index, id, text, parent_text.

    Written for documents whose lines are all narrative, as in the given data.
    """
    limit = f"WHERE chunk_index < {cap}" if cap else ""
    return f"""
ch_l AS (SELECT document_id, i, ls[i] AS line, length(ls[i]) AS n FROM
  (SELECT document_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM
    (SELECT CAST(doc_id AS VARCHAR) AS document_id, {lines("text")} AS ls FROM documents))),
ch_g AS (SELECT document_id, i, line, n, 0 AS grp, CASE WHEN n > 1200 THEN 0 ELSE n END AS held
    FROM ch_l WHERE i = 1
  UNION ALL SELECT l.document_id, l.i, l.line, l.n,
      CASE WHEN l.n <= 1200 AND g.held > 0 AND g.held + 1 + l.n <= 1200 THEN g.grp
        ELSE g.grp + 1 END,
      CASE WHEN l.n > 1200 THEN 0 WHEN g.held > 0 AND g.held + 1 + l.n <= 1200
        THEN g.held + 1 + l.n ELSE l.n END
    FROM ch_g g JOIN ch_l l ON l.document_id = g.document_id AND l.i = g.i + 1),
ch_b AS (SELECT {{'d': document_id, 'g': grp}} AS key, string_agg(line, chr(10) ORDER BY i) AS body
  FROM ch_g GROUP BY document_id, grp),
{split("ch_p", "ch_b", 1200, 150)},
ch_c AS (SELECT {{'d': key.d, 'g': key.g, 'p': part}} AS key, piece AS body FROM ch_p),
{split("ch_s", "ch_c", 300, 50)},
ch_n AS (SELECT s.key.d AS document_id, row_number() OVER (PARTITION BY s.key.d
    ORDER BY s.key.g, s.key.p, s.part) - 1 AS chunk_index, s.piece AS text, c.body AS parent_text
  FROM ch_s s JOIN ch_c c ON s.key = c.key),
ch AS (SELECT *, sha256(document_id || ':' || chunk_index) AS id FROM ch_n {limit})"""


CHUNK_VECTORS = """(SELECT ch.id, ch.document_id, embedding FROM ch
 LEFT JOIN embeddings ON CAST(vec_id AS VARCHAR) = ch.document_id)"""
