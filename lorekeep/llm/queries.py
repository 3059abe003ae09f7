"""The registered query of every operator, over its whole table, and its SQL where there is any."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import collocations, divergence, fingerprint, html_extract, mixing, neardup, packing, quality, sentencepiece, sharding, tokencounts, toxicity, warc
from lorekeep.llm.common import read_table, small_batches

SHARDS = 24


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_jump_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    body = F.coalesce("text", F.lit(""))
    narrow = docs.select(
        "doc_id",
        (F.octet_length(body).cast("long") + 8).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    placed = sharding.assign_shards(narrow, SHARDS, "doc_id", ("size", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: The hash step by step in wide integers, and the check sum byte by byte with its table.
OP1_SQL = """
WITH RECURSIVE
bits(n, c, k) AS (SELECT n, CAST(n AS UBIGINT), 0 FROM range(256) t(n)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
steps AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
jumps(doc_id, s, b, j) AS (SELECT DISTINCT doc_id, CAST(coalesce(doc_id, 0) AS HUGEINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM documents
  UNION ALL SELECT doc_id, n, j, CAST(floor(CAST(j + 1 AS DOUBLE) * (2147483648.0::DOUBLE / CAST(n // 8589934592 + 1 AS DOUBLE))) AS BIGINT)
    FROM (SELECT *, (s * 2862933555777941757 + 1) % 18446744073709551616 AS n FROM jumps WHERE j < 24)),
placed AS (SELECT doc_id, max(b) AS shard, max(j) AS ahead FROM jumps GROUP BY doc_id),
sized AS (SELECT doc_id, encode(coalesce(text, '')) AS body FROM documents)
SELECT doc_id, CAST(octet_length(body) + 8 AS BIGINT) AS size,
  CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(regexp_extract_all(hex(body), '..'), lambda h: CAST('0x' || h AS UBIGINT))),
    lambda c, x: xor(c >> 8, steps.t[CAST(xor(c, x) & 255 AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) AS BIGINT) AS text_crc32,
  'key' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot,
  CAST(CASE WHEN ahead = 24 THEN 24 ELSE shard END AS INTEGER) AS grown_shard
FROM sized JOIN placed USING (doc_id), steps
"""


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokencounts.count_tokens(read_table(spark, folder, "documents"), _vocabulary("byte_bpe_50k.json"))


def op3_unigram_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece.encode_and_decode(read_table(spark, folder, "documents"), _vocabulary("piece_bpe_32k.model"))


def op4_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extract(read_table(spark, folder, "pages"), html_extract.fit(spark))


#: The pages of the tables have one article element each; this SQL reads just that.
OP4_SQL = r"""
WITH inside AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1) AS h FROM pages),
spaced AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '<[^>]*$', ''), '</?(p|br|h1)>', ' ', 'g') AS t FROM inside),
bare AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '<[^>]*>', '', 'g'), '&amp$', '&amp;') AS t FROM spaced),
plain AS (SELECT page_id, url, replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS t FROM bare),
folded AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM plain)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM folded
"""


def op5_quality_outliers(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(read_table(spark, folder, "documents"))


def op6_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.classes(read_table(spark, folder, "documents"))


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read_table(spark, folder, "documents"), _vocabulary("word_bpe_49k.json"))


def op8_parsing_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.fingerprints(read_table(spark, folder, "documents"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read_table(spark, folder, "labels")))


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_table(spark, folder, "pages")
    return warc.read_archive(warc.write_archive(pages, "page_id", "url", "html"), "page_id")


#: Base32 of a hexadecimal SHA-1 by five bits at a time, since this SQL has no such function.
OP10_SQL = """
WITH hashed AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
marked AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS response FROM hashed)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((((strpos('0123456789abcdef', substr(h, CAST((i * 5) // 4 + 1 AS BIGINT), 1)) - 1) * 16
      + greatest(strpos('0123456789abcdef', substr(h || '0', CAST((i * 5) // 4 + 2 AS BIGINT), 1)) - 1, 0))
      >> CAST(3 - (i * 5) % 4 AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to
FROM marked
"""


def op11_fair_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(read_table(spark, folder, "documents")).taken()


#: Targets by filling the sources with the least room first; then one queue per source, one order of finish times.
OP11_SQL = r"""
WITH sized AS (SELECT row_number() OVER () AS tie, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS k FROM documents),
per AS (SELECT source, sum(size) AS s FROM sized GROUP BY source),
ranked AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w FROM per),
sums AS (SELECT *, sum(w) OVER () AS ws, sum(s) OVER () AS budget,
    sum(w) OVER o - w AS wb, sum(3 * s) OVER o - 3 * s AS mb FROM ranked WINDOW o AS (ORDER BY 3 * s / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
filled AS (SELECT *, 3 * s * (ws - wb) <= w * (budget - mb) AS f FROM sums),
level AS (SELECT (any_value(budget) - coalesce(sum(3 * s) FILTER (f), 0)) / (any_value(ws) - coalesce(sum(w) FILTER (f), 0)) AS level FROM filled),
targets AS (SELECT source, s, budget, CASE WHEN f THEN CAST(3 * s AS DOUBLE) ELSE level * w END AS target FROM filled, level),
queue AS (SELECT tie, doc_id, size, CAST(s AS BIGINT) AS source_size, budget, target, sum(size) OVER q AS within, sum(size) OVER t AS through
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
  WINDOW q AS (PARTITION BY sized.source ORDER BY k, doc_id, size, tie ROWS UNBOUNDED PRECEDING), t AS (ORDER BY sized.source NULLS LAST, k, doc_id, size, tie ROWS UNBOUNDED PRECEDING)),
items AS (SELECT tie, size, budget, through, CAST(e * source_size + within AS DOUBLE) / target AS finish FROM queue, range(3) t(e) WHERE size > 0 AND target > 0),
mixed AS (SELECT tie, size, budget, sum(size) OVER (ORDER BY finish, through ROWS UNBOUNDED PRECEDING) AS mixed FROM items),
took AS (SELECT tie, sum(size) AS taken FROM mixed WHERE mixed <= budget GROUP BY tie)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM queue LEFT JOIN took USING (tie)
"""

def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(read_table(spark, folder, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS ln FROM kept GROUP BY lang),
g AS (SELECT DISTINCT d.lang, source, coalesce(v, 0) AS v, coalesce(ln, 0) AS ln FROM d LEFT JOIN v USING (lang)),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
gn AS (SELECT lang, source, sum(n) AS gn FROM c GROUP BY lang, source),
s AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1) // (coalesce(gn, 0) + g.v) AS p, 1 + CAST(1000000000 AS HUGEINT) * (k.n + 1) // (g.ln + g.v) AS q
  FROM g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source),
pairs AS (SELECT g.lang, g.source, o.source AS item, 0 AS value FROM g JOIN g o ON g.lang = o.lang AND g.source <> o.source WHERE g.v = 0
  UNION ALL SELECT a.lang, a.source, b.source, sum((a.p - b.p) * (a.p - b.p) // b.p) FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM s WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 200
"""

def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(read_table(spark, folder, "documents"))


OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
f AS (SELECT lang, k, list_slice(w, i, i + k - 1) AS x, count(*) AS a FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 4) t(k)) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND a >= 10),
cuts AS (SELECT c.*, cut, u.a AS l, v.a AS r, CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(u.a AS HUGEINT) * v.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c JOIN f u ON u.lang = c.lang AND u.x = list_slice(c.x, 1, cut) JOIN f v ON v.lang = c.lang AND v.x = list_slice(c.x, cut + 1, c.k)),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, x ORDER BY score, cut) = 1),
longer AS (SELECT lang, list_slice(x, i, i + 1) AS x, max(a) AS a FROM (SELECT lang, x, a, unnest([1, 2]) AS i FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN longer USING (lang, x) WHERE k = 3 OR longer.a IS NULL OR 100 * longer.a < 50 * best.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(x, ' ')) AS rank, array_to_string(x, ' ') AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""


def _in_small_batches(query):
    @wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        small_batches(spark)
        return query(spark, folder)

    return run


_QUERIES = {
    "op1_jump_sharding": (op1_jump_sharding, OP1_SQL),
    "op2_token_counts": (op2_token_counts, None),
    "op3_unigram_pieces": (op3_unigram_pieces, None),
    "op4_html_extraction": (op4_html_extraction, OP4_SQL),
    "op5_quality_outliers": (op5_quality_outliers, None),
    "op6_near_duplicates": (op6_near_duplicates, None),
    "op7_packing": (op7_packing, None),
    "op8_parsing_fingerprints": (op8_parsing_fingerprints, None),
    "op9_toxicity": (op9_toxicity, None),
    "op10_warc": (op10_warc, OP10_SQL),
    "op11_fair_mixing": (op11_fair_mixing, OP11_SQL),
    "op12_source_divergence": (op12_source_divergence, OP12_SQL),
    "op13_collocations": (op13_collocations, OP13_SQL),
}

REGISTERED = {name: (_in_small_batches(query), sql) for name, (query, sql) in _QUERIES.items()}
