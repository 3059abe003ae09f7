"""Extraction, splitting and chunking over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sqlparts as S
from checks import views as V
from lorekeep.functions import elements as E
from lorekeep.functions import text as X
from lorekeep.functions.chunks import ChunkRules, split_long_text
from lorekeep.functions.lines import group_words
from lorekeep.operators.common import unnest
from lorekeep.sources import files as L
from lorekeep.sources.html import html_elements, html_matches
from lorekeep.sources.rows import with_element_rows

LONG = "long"
# Fixed values of these checks: the extension that stands for a language.
EXTENSION = {"en": ".md", "fr": ".TXT", "de": ".exe", "es": ".html"}


def _paths(spark, d):
    table = F.create_map(*[F.lit(x) for pair in EXTENSION.items() for x in pair])
    rows = V.read(spark, d, "documents")
    folder = F.when(F.col("toxic") == 1, F.lit("_Archives/")).otherwise(F.lit(""))
    return rows.join(V.read(spark, d, "labels"), "doc_id", "left").select(
        "doc_id",
        F.concat(F.lit("/data/"), F.col("source"), F.lit("/"), folder, F.lit("doc_"), F.col("doc_id"),
                 F.coalesce(F.try_element_at(table, F.col("lang")), F.lit(".csv"))).alias("path"),
    )


PATHS = """(SELECT doc_id, '/data/' || source || '/' || CASE WHEN toxic = 1 THEN '_Archives/' ELSE '' END
 || 'doc_' || doc_id || CASE lang WHEN 'en' THEN '.md' WHEN 'fr' THEN '.TXT' WHEN 'de' THEN '.exe'
 WHEN 'es' THEN '.html' ELSE '.csv' END AS path FROM documents LEFT JOIN labels USING (doc_id))"""


def extension_filter(spark, d):
    return _paths(spark, d).where(L.has_extension(F.col("path"), ["md", ".txt", ".csv"])).select("path")


def exclude_dirs(spark, d):
    return _paths(spark, d).where(L.not_excluded(F.col("path"))).select("path")


def textual_status(spark, d):
    status = F.when(L.is_textual(F.col("path")), "read").otherwise("skip_binary")
    return _paths(spark, d).groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def path_parts(spark, d):
    p = F.col("path")
    return _paths(spark, d).select("path", X.basename(p).alias("name"), X.suffix(p).alias("suffix"))


def markdown(text):
    """Documents turned into Markdown: capitalised articles open titles, sentences list items."""
    headed = F.regexp_replace(text, r"(?m)^(The|Of|Le|De|Der|El) ", "## $1 ")
    return F.regexp_replace(headed, r"\. ([A-M])", "\n- $1")


MARKDOWN = r"""regexp_replace(regexp_replace(text, '(?m)^(The|Of|Le|De|Der|El) ', '## \1 ', 'g'), '\. ([A-M])', chr(10) || '- \1', 'g')"""


def elements_markdown(spark, d):
    rows = V.texts(spark, d).select("doc_id", F.posexplode_outer(E.text_elements(markdown(F.col("text")))).alias("pos", "e"))
    return rows.where("e is not null").select(
        "doc_id", F.col("pos").cast("long").alias("pos"), "e.element_type", "e.text", "e.section"
    )


MD_ELEMENTS = f"""WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM
 (SELECT doc_id, {S.lines(MARKDOWN)} AS ls FROM documents)),
e AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, element_type, text FROM (
 SELECT doc_id, i, CASE WHEN line LIKE '#%' THEN 'Title' WHEN substr(line, 1, 2) IN ('- ', '* ', '+ ') THEN 'ListItem'
   ELSE 'NarrativeText' END AS element_type,
  CASE WHEN line LIKE '#%' THEN trim(ltrim(line, '#'), {S.WS}) WHEN substr(line, 1, 2) IN ('- ', '* ', '+ ')
   THEN trim(substr(line, 3), {S.WS}) ELSE line END AS text FROM l) WHERE text <> ''),
s AS (SELECT *, last_value(CASE WHEN element_type = 'Title' THEN substr(text, 1, 200) END IGNORE NULLS)
  OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
el AS (SELECT doc_id, pos, element_type, text, coalesce(before, CASE WHEN element_type = 'Title'
  THEN substr(text, 1, 200) END) AS section FROM s)"""


def elements_rows(spark, d):
    """The same elements from a table function, one row as soon as its line is read."""
    rows = V.texts(spark, d).select("doc_id", markdown(F.col("text")).alias("content"))
    return with_element_rows(rows, "content").select("doc_id", F.col("position").alias("pos"), "element_type", "text", "section")


def section_lookback(spark, d):
    return elements_markdown(spark, d).groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("n"))


def elements_to_text(spark, d):
    joined = E.elements_to_text(E.text_elements(markdown(F.col("text"))))
    return V.texts(spark, d).select("doc_id", joined.alias("text"))


def _words(text):
    """Words with made-up positions: one line per text line, the first line bold, some large."""
    def of_line(line, y):
        words = F.filter(F.split(line, " +"), lambda w: w != "")
        return F.transform(
            words,
            lambda w, x: F.struct(
                w.alias("text"), (x * 40.0 + 10).alias("x0"), (y * 12.0 + F.pmod(x, F.lit(3)) * 0.5).alias("top"),
                F.when(F.pmod(y, F.lit(4)) == 1, 14.0).otherwise(10.0).alias("size"),
                F.when(y == 0, "Arial-Bold").otherwise("Arial").alias("fontname"),
            ),
        )
    return F.flatten(F.transform(X.lines(text), of_line))


def line_grouping(spark, d):
    box = F.array(F.struct(F.lit(40.0).alias("x0"), F.lit(23.0).alias("top"), F.lit(200.0).alias("x1"), F.lit(26.0).alias("bottom")))
    rows = V.texts(spark, d).select(
        "doc_id", F.posexplode_outer(group_words(_words(F.col("text")), box)).alias("line", "g")
    )
    return rows.where("g is not null").select("doc_id", F.col("line").cast("long").alias("line"), "g.text", "g.is_title")


_LINES = f"""WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS y FROM
 (SELECT doc_id, {S.lines("text")} AS ls FROM documents)),
w AS (SELECT doc_id, y, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS x FROM
 (SELECT doc_id, y, list_filter(string_split_regex(line, ' +'), lambda w: w <> '') AS ws FROM l)),
p AS (SELECT doc_id, word, x * 40.0 + 10 AS x0, y * 12.0 + (x % 3) * 0.5 AS top, y, x,
  CASE WHEN y % 4 = 1 THEN 14.0 ELSE 10.0 END AS size, CASE WHEN y = 0 THEN 'Arial-Bold' ELSE 'Arial' END AS font FROM w),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(top, 1), x0, y, x) AS n FROM p
  WHERE NOT (x0 BETWEEN 40 AND 200 AND top BETWEEN 23 AND 26)),
b AS (SELECT *, abs(top - lag(top) OVER (PARTITION BY doc_id ORDER BY n)) > 3 AS jump FROM f),
g AS (SELECT *, sum(CASE WHEN jump THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS grp FROM b)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1 AS line, text, is_title FROM (
 SELECT doc_id, grp, string_agg(word, ' ' ORDER BY x0, n) AS text,
  avg(size) >= 13 OR bool_or(lower(font) LIKE '%bold%') AS is_title FROM g GROUP BY doc_id, grp)"""


def html_structural_subset(spark, d):
    rows = V.read(spark, d, "pages").select("page_id", F.posexplode_outer(html_elements(F.col("html"))).alias("pos", "e"))
    return rows.where("e is not null").select(
        "page_id", F.col("pos").cast("long").alias("pos"), "e.element_type", "e.text", "e.section"
    )


_DROP = "html"
for _tag in ("script", "style", "nav", "footer", "header"):
    _DROP = f"regexp_replace({_DROP}, '(?is)<{_tag}\\b.*?(</{_tag}\\s*>|$)', '', 'g')"
_UNESCAPE = "x"
for _entity, _char in (
    ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
):
    _UNESCAPE = f"replace({_UNESCAPE}, '{_entity}', '{_char}')"
_UNESCAPE = f"regexp_replace({_UNESCAPE}, '&amp$', '&')"
_HTML = f"""WITH c AS (SELECT page_id, regexp_replace(regexp_replace({_DROP}, '(?s)<!--.*?-->', '<i>', 'g'),
   '<[a-zA-Z/][^>]*$', '') AS body FROM pages),
m AS (SELECT page_id, unnest(ms) AS part, generate_subscripts(ms, 1) AS i FROM
  (SELECT page_id, regexp_extract_all(body,
    '(?is)<(?:h[1-6]|p|li|div)(?:\\s[^>]*)?>.*?(?:</(?:h[1-6]|p|li|article|div)\\s*>|<br><p>|$)') AS ms FROM (
    SELECT page_id, replace(body, '<br><p>', '<br></p><p>') AS body FROM c))),
t AS (SELECT page_id, i, CASE WHEN part ILIKE '<h%' THEN 'Title' WHEN part ILIKE '<li%' THEN 'ListItem'
   ELSE 'NarrativeText' END AS element_type,
  list_aggregate(list_transform(list_transform(string_split_regex(part, '<[^>]*>'),
    lambda x: {_UNESCAPE}), lambda s: trim(s, {S.WS})), 'string_agg', '') AS text FROM m),
e AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, element_type, text
  FROM t WHERE text <> '')
SELECT *, last_value(CASE WHEN element_type = 'Title' THEN substr(text, 1, 200) END IGNORE NULLS) OVER
 (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS section FROM e"""


def html_table_text(spark, d):
    """One HTML table per order, built from its lines, read back as tabulated text."""
    lines = V.read(spark, d, "lineitem").select(
        "l_orderkey",
        F.struct(
            F.col("l_linenumber").alias("n"),
            F.concat(F.lit("<tr><td> "), F.col("l_linenumber"), F.lit("</td><td><b>"), F.col("l_returnflag"),
                     F.lit("</b> &amp; "), F.col("l_linestatus"), F.lit("</td></tr>")).alias("row"),
        ).alias("cell"),
    )
    pages = lines.groupBy("l_orderkey").agg(
        F.concat(
            F.lit("<table><tr><th>line</th><th>flags</th></tr><tr></tr>"),
            F.array_join(F.transform(F.array_sort(F.collect_list("cell")), lambda c: c["row"]), ""),
            F.lit("</table>"),
        ).alias("html")
    )
    found = pages.select("l_orderkey", F.element_at(html_matches(F.col("html")), 1).alias("e"))
    return found.select("l_orderkey", "e.element_type", "e.text")


def split_parts(spark, d):
    parts = split_long_text(F.col("text"), 300, 50)
    rows = V.texts(spark, d).select("doc_id", F.posexplode_outer(parts).alias("part", "piece"))
    return rows.where("piece is not null").select("doc_id", F.col("part").cast("long").alias("part"), "piece")


def chunk_elements(spark, d):
    return V.plain_chunks(spark, d).select(
        "document_id", F.col("chunk_index").cast("long").alias("chunk_index"), "id", "text", "parent_text"
    )


def chunk_cap(spark, d):
    """Chunks per document without a cap, with the usual one and with a small one."""
    def count(cap, name):
        rules = ChunkRules(max_chunks=cap)
        return V.plain_chunks(spark, d, rules).groupBy("document_id").agg(F.count(F.lit(1)).alias(name))
    return count(None, "all_chunks").join(count(100, "kept"), "document_id").join(count(5, "kept_5"), "document_id")


def chunk_id_hash(spark, d):
    rows = V.read(spark, d, "conversations")
    return rows.select("conv_id", "turn", X.chunk_id(F.col("conv_id"), F.col("turn")).alias("chunk_id"))


def content_hash(spark, d):
    return V.read(spark, d, "documents").select("doc_id", X.content_hash(F.encode("text", "UTF-8")).alias("id"))


def encoding_cascade(spark, d):
    """Texts that Latin-1 can hold are stored in Windows-1252 with a sign that only it has, the others in UTF-8; and texts with a broken byte."""
    narrow = ~F.col("text").rlike("[^\\x00-\\x7F\\xA0-\\xFF]")
    euro, broken = F.unhex(F.lit("80")), F.unhex(F.lit("81"))
    stored = F.when(narrow, F.concat(F.encode("text", "ISO-8859-1"), euro)).otherwise(F.encode("text", "UTF-8"))
    damaged = F.concat(F.encode("text", "UTF-8"), broken)
    return V.read(spark, d, "documents").select("doc_id", L.decode_text(stored).alias("text"), L.decode_text(damaged).alias("damaged"))


def truncate_text(spark, d):
    return V.read(spark, d, "documents").select("doc_id", X.truncate(F.col("text")).alias("text"))


def snippets(spark, d):
    return V.read(spark, d, "documents").select(
        "doc_id", X.snippet(F.col("text"), 200).alias("short"), X.snippet(F.col("text"), 300).alias("long")
    )


def head_tail_sample(spark, d):
    return V.texts(spark, d).select("doc_id", X.head_and_tail(F.col("text")).alias("sample"))


def llm_input_cut(spark, d):
    return V.read(spark, d, "documents").select("doc_id", X.llm_input(F.col("text")).alias("sample"))


def mime_lookup(spark, d):
    extension = F.create_map(*[F.lit(x) for x in ("click", ".JPG", "view", ".png", "error", ".tif", "purchase", ".webp")])
    path = F.concat(F.lit("shots/img_"), F.col("event_id"), F.coalesce(F.try_element_at(extension, F.col("event_type")), F.lit("")))
    return V.read(spark, d, "events").select("event_id", X.image_mime(path).alias("mime"))


_WORDS = f"list_filter(string_split_regex(text, '[' || {S.WS} || ']+'), lambda w: w <> '')"

CHECKS = {
    "extension_filter": (
        extension_filter,
        f"SELECT path FROM {PATHS} WHERE lower(path) LIKE '%.md' OR lower(path) LIKE '%.txt' OR lower(path) LIKE '%.csv'",
    ),
    "exclude_dirs": (exclude_dirs, f"SELECT path FROM {PATHS} WHERE path NOT LIKE '%/\\_Archives/%' ESCAPE '\\'"),
    "textual_status": (
        textual_status,
        f"SELECT CASE WHEN path LIKE '%.exe' THEN 'skip_binary' ELSE 'read' END AS status, count(*) AS n FROM {PATHS} GROUP BY 1",
    ),
    "path_parts": (
        path_parts,
        f"SELECT path, string_split(path, '/')[-1] AS name, '.' || string_split(path, '.')[-1] AS suffix FROM {PATHS}",
    ),
    "elements_markdown": (elements_markdown, f"{MD_ELEMENTS} SELECT * FROM el"),
    "elements_rows": (elements_rows, f"{MD_ELEMENTS} SELECT * FROM el"),
    "section_lookback": (section_lookback, f"{MD_ELEMENTS} SELECT doc_id, section, count(*) AS n FROM el GROUP BY ALL"),
    "elements_to_text": (
        elements_to_text,
        f"{MD_ELEMENTS} SELECT doc_id, coalesce(string_agg(text, chr(10) ORDER BY pos), '') AS text FROM documents LEFT JOIN el USING (doc_id) GROUP BY doc_id".replace(
            "string_agg(text", "string_agg(el.text"
        ),
    ),
    "line_grouping": (line_grouping, _LINES),
    "html_structural_subset": (html_structural_subset, _HTML),
    "html_table_text": (
        html_table_text,
        """SELECT l_orderkey, 'Table' AS element_type, 'line' || chr(9) || 'flags' || chr(10) || string_agg(l_linenumber
 || chr(9) || l_returnflag || '& ' || l_linestatus, chr(10) ORDER BY l_linenumber,
 l_returnflag, l_linestatus) AS text FROM lineitem GROUP BY l_orderkey""",
    ),
    "split_long_text": (
        split_parts,
        f"WITH RECURSIVE src AS (SELECT doc_id AS key, text AS body FROM documents), {S.split('sp', 'src', 300, 50)} SELECT key AS doc_id, part, piece FROM sp",
    ),
    "chunk_elements": (
        chunk_elements,
        f"WITH RECURSIVE {S.chunks()} SELECT document_id, chunk_index, id, text, parent_text FROM ch",
    ),
    "chunk_cap": (
        chunk_cap,
        f"WITH RECURSIVE {S.chunks(None)} SELECT document_id, count(*) AS all_chunks, least(count(*), 100) AS kept, least(count(*), 5) AS kept_5 FROM ch GROUP BY document_id",
    ),
    "chunk_id_hash": (chunk_id_hash, "SELECT conv_id, turn, sha256(conv_id || ':' || turn) AS chunk_id FROM conversations"),
    "content_hash": (content_hash, "SELECT doc_id, sha256(text) AS id FROM documents"),
    "encoding_cascade": (
        encoding_cascade,
        """SELECT doc_id, CASE WHEN regexp_matches(text, '[^\\x00-\\x7F\\x{A0}-\\x{FF}]') THEN text ELSE text || '€' END AS text,
 text || chr(65533) AS damaged FROM documents""",
    ),
    "truncate_text": (truncate_text, "SELECT doc_id, substr(coalesce(text, ''), 1, 8000) AS text FROM documents"),
    "snippet": (
        snippets,
        f"""SELECT doc_id, trim(replace(substr(text, 1, 200), chr(10), ' '), {S.WS}) || '...' AS short,
 trim(replace(substr(text, 1, 300), chr(10), ' '), {S.WS}) || '...' AS long FROM documents""",
    ),
    "head_tail_sample": (
        head_tail_sample,
        f"""SELECT doc_id, CASE WHEN len(w) > 5000 THEN 'Tête du document:' || chr(10) || array_to_string(w[:2500], ' ')
 || chr(10) || '...' || chr(10) || 'Queue du document:' || chr(10) || array_to_string(w[-2500:], ' ') ELSE text END AS sample
 FROM (SELECT doc_id, text, {_WORDS} AS w FROM documents)""",
    ),
    "llm_input_cut": (
        llm_input_cut,
        "SELECT doc_id, CASE WHEN length(text) > 6000 THEN substr(text, 1, 6000) || chr(10) || '...' ELSE text END AS sample FROM documents",
    ),
    "mime_lookup": (
        mime_lookup,
        """SELECT event_id, CASE event_type WHEN 'click' THEN 'image/jpeg' WHEN 'error' THEN 'image/tiff'
 ELSE 'image/png' END AS mime FROM events""",
    ),
}
