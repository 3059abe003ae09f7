"""BM25 ranking over any table that has an id and a text column.

There are two ways to score. Counted texts (one row per text) are scored where
they are read: every task keeps the best rows per query and nothing else is
shuffled. A stored index (one row per term and text, sorted by term) is read
for the terms of the queries only, and its few rows are joined and summed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lorekeep.functions.text import bind
from lorekeep.functions.tokens import Tokenizer, term_counts
from lorekeep.operators.common import (
    BROADCAST_ROWS,
    broadcast_if_small,
    dealt,
    has_at_most,
    is_one_of,
    materialize,
    tasks_for,
    top_per_group,
    unnest,
    unnest_values,
)
from lorekeep.operators.runs import by_text, only_blocks, over_runs, small_batches
from lorekeep.operators.topk import BestPerQuery, hit_schema, query_key

# Default parameters of the ranking function.
K1 = 1.2
B = 0.75
SCORE_DIGITS = 6
SALTS = 64
# What a task holds at a time: texts, and weights (one per text, query and term that both have).
SCORE_TEXTS = 1_000
SCORE_WEIGHTS = 500_000


def term_table(df: DataFrame, ids: list[str], text: str, tokenizer: Tokenizer) -> DataFrame:
    """``ids, doc_len, terms``: one row per text, counted without a shuffle."""
    counted = bind(
        tokenizer.tokens(F.coalesce(F.col(text), F.lit(""))),
        lambda tokens: F.struct(
            F.size(tokens).alias("doc_len"), term_counts(tokens).alias("terms")
        ),
    )
    return df.select(*ids, counted.alias("_counted")).select(*ids, "_counted.*")


def postings(terms: DataFrame, ids: list[str]) -> DataFrame:
    """``ids, doc_len, term, tf``."""
    return unnest(terms, [*ids, "doc_len"], F.col("terms"))


def corpus_stats(terms: DataFrame) -> DataFrame:
    """One row: number of texts and their mean length in terms."""
    return terms.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.coalesce(F.avg("doc_len"), F.lit(0.0)).alias("avg_len"),
    )


def document_frequency(posted: DataFrame) -> DataFrame:
    """``term, df``; each (text, term) pair occurs once, so a count is enough."""
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log10((n_docs - df + 0.5) / (df + 0.5) + 1)


def term_weight(tf, doc_len, avg_len, idf):
    """Weight of one term in one text; for Spark columns and for arrays alike."""
    return idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * doc_len / avg_len))


@dataclass(frozen=True)
class Packed:
    """Postings in runs (see ``runs``) with ``segment``, their live texts, and ``segment, run, gone``, places of texts that are not live."""

    rows: DataFrame
    texts: DataFrame
    gone: DataFrame | None


@dataclass(frozen=True)
class LexicalIndex:
    """Postings with the two tables of statistics that BM25 needs."""

    posted: DataFrame
    frequencies: DataFrame
    stats: DataFrame
    ids: tuple[str, ...]
    tokenizer: Tokenizer
    terms: DataFrame | None = None
    #: Of a segmented index: ``segment, block, term, max_tf, min_len, n``; its postings have ``segment`` and ``block``, too,
    #: and are unpacked from ``packed`` where they are read.
    blocks: DataFrame | None = None
    packed: Packed | None = None

    @staticmethod
    def of(
        df: DataFrame,
        ids: list[str],
        text: str,
        tokenizer: Tokenizer = Tokenizer(),
        keep: bool = False,
        staging: str | None = None,
    ) -> LexicalIndex:
        """Derive everything from the table at query time (no stored index).

        Statistics, frequencies and scores each read the counted terms. With
        ``keep`` the texts are tokenised once and the counts written, which pays
        as soon as more than one of the three is used.
        """
        terms = term_table(df, ids, text, tokenizer)
        terms = materialize(terms, staging) if keep else terms
        posted = postings(terms, ids)
        return LexicalIndex(
            posted, document_frequency(posted), corpus_stats(terms), tuple(ids), tokenizer, terms
        )

    def save(self, path: str) -> None:
        """Store postings sorted by term so that a query reads only its terms.

        Ranges over (term, id) split a frequent term over several files; the
        two-letter prefix directory prunes whole directories, the sorted terms
        prune row groups.
        """
        key, spark = self.ids[0], self.posted.sparkSession
        self.frequencies.write.mode("overwrite").parquet(f"{path}/frequencies")
        n = spark.read.parquet(f"{path}/frequencies").agg(F.sum("df")).first()[0] or 0
        (
            self.posted.withColumn("prefix", F.substring("term", 1, 2))
            .repartitionByRange(tasks_for(spark, n), "prefix", "term", key)
            .sortWithinPartitions("prefix", "term", key)
            .write.mode("overwrite")
            .partitionBy("prefix")
            .parquet(f"{path}/postings")
        )
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")

        self.posted.limit(0).write.mode("overwrite").parquet(f"{path}/schema")

    @staticmethod
    def load(spark, path: str, ids: list[str], tokenizer: Tokenizer) -> LexicalIndex:
        """A stored index; one of no texts has no postings file, so the schema is stored beside it."""
        schema = spark.read.parquet(f"{path}/schema").schema
        prefixed = StructType([*schema.fields, StructField("prefix", StringType())])
        return LexicalIndex(
            spark.read.schema(prefixed).parquet(f"{path}/postings"),
            spark.read.parquet(f"{path}/frequencies"),
            spark.read.parquet(f"{path}/stats"),
            tuple(ids),
            tokenizer,
        )


def half_up(values: np.ndarray) -> np.ndarray:
    """Rounded as the other plan rounds: halves go up."""
    scale = 10.0**SCORE_DIGITS
    return np.floor(values * scale + 0.5) / scale


def query_terms(queries: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """Distinct terms of every query: ``query_id, term``."""
    tokens = F.array_distinct(tokenizer.tokens(F.col("query")))
    return unnest_values(queries, ["query_id"], tokens, "term")


def bm25_scores(index: LexicalIndex, queries: DataFrame, staging: str | None = None) -> DataFrame:
    """``query_id, ids, score`` of every text that shares a term with the query."""
    asked = _Asked.of(index, queries, staging)
    return asked.scores(asked.postings())


@dataclass(frozen=True)
class _Asked:
    """An index and the terms of some queries with their weights."""

    index: LexicalIndex
    wanted: DataFrame  # query_id, term
    weighted: DataFrame  # query_id, term, df, avg_len, idf
    vocabulary: DataFrame
    words: list[str] | None  # of a bounded vocabulary

    @staticmethod
    def of(index: LexicalIndex, queries: DataFrame, staging: str | None = None) -> _Asked:
        wanted = query_terms(queries.select("query_id", "query"), index.tokenizer)
        vocabulary = wanted.select("term").distinct()
        small, bounded = broadcast_if_small(vocabulary)
        words = [r.term for r in vocabulary.collect()] if bounded else None
        weighted = (
            wanted.join(index.frequencies.join(small, "term", "left_semi"), "term")
            .withColumn("_stats", index.stats.select(F.struct("n_docs", "avg_len")).scalar())
            .select(
                "query_id",
                "term",
                "df",
                F.col("_stats.avg_len").alias("avg_len"),
                idf(F.col("_stats.n_docs"), F.col("df")).alias("idf"),
            )
        )
        # Written, as several plans read it and each would count the frequencies again.
        return _Asked(index, wanted, materialize(weighted, staging), small, words)

    def of_terms(self, rows: DataFrame) -> DataFrame:
        """Rows of the queries' terms; literal terms reach the scan and prune files."""
        if self.words is None:
            return rows.join(self.vocabulary, "term", "left_semi")
        if "prefix" in rows.columns:
            rows = rows.where(is_one_of("prefix", sorted({w[:2] for w in self.words})))
        return rows.where(is_one_of("term", self.words))

    def postings(self) -> DataFrame:
        return self.of_terms(self.index.posted)

    @cached_property
    def n_weights(self) -> int:
        """How many pairs of query and posting have a term in common."""
        return self.weighted.agg(F.sum("df")).first()[0] or 0

    def scores(self, posted: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
        """Sums of weights; ``chosen`` restricts them to pairs of query and block."""
        ids = list(self.index.ids)
        blocks = ["segment", "block"] if chosen is not None else []
        # Partitioned by text id once, the sums below need no further exchange. A task sums about as many weights, whatever the number of texts.
        n = self.n_weights if chosen is None else chosen.agg(F.sum("n")).first()[0] or 0
        posted = dealt(posted.select(*ids, "doc_len", "term", "tf", *blocks), n, ids[0])
        if self.words is not None and broadcast_if_small(self.wanted)[1]:
            matched = posted.join(F.broadcast(self.weighted), "term")
        else:
            matched = _salted_join(posted, self.weighted, ids[0])
        if chosen is not None:
            matched = matched.join(broadcast_if_small(chosen)[0], ["query_id", *blocks], "left_semi")
        weight = term_weight(F.col("tf"), F.col("doc_len"), F.col("avg_len"), F.col("idf"))
        return matched.groupBy("query_id", *ids).agg(F.round(F.sum(weight), SCORE_DIGITS).alias("score"))


# So many times the pool of postings are scored first, to learn a score that the other blocks have to reach.
FIRST_POSTINGS = 4


def block_bounds(asked: _Asked) -> DataFrame:
    """``query_id, segment, block, bound, n``: no text of the block scores above the bound; ``n`` postings."""
    at_most = term_weight(F.col("max_tf"), F.col("min_len"), F.col("avg_len"), F.col("idf"))
    matched = asked.of_terms(asked.index.blocks).join(broadcast_if_small(asked.weighted)[0], "term")
    return matched.groupBy("query_id", "segment", "block").agg(F.sum(at_most).alias("bound"), F.sum("n").alias("n"))


def _in_blocks(posted: DataFrame, chosen: DataFrame) -> DataFrame:
    """Postings of some blocks; few blocks are literals, which skip pages of the files sorted by term and block."""
    keys = chosen.select("segment", "block").distinct()
    if not has_at_most(keys, 1000):
        return posted.join(broadcast_if_small(keys)[0], ["segment", "block"], "left_semi")
    by_segment: dict[int, list[int]] = {}
    for r in keys.collect():
        by_segment.setdefault(r["segment"], []).append(r["block"])
    held = F.lit(False)
    for segment, blocks in sorted(by_segment.items()):
        held = held | ((F.col("segment") == segment) & F.col("block").isin(sorted(blocks)))
    return posted.where(held)


def bm25_pruned(index: LexicalIndex, queries: DataFrame, pool: int, staging: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Best ``pool`` texts per query of a segmented index, reading only blocks that can hold one, and the blocks read.

    The blocks with the highest bounds are scored first. A block whose bound is below the ``pool``-th score found there holds none of the
    best texts and is not read. Returns ``query_id, ids, score`` and ``query_id, segment, block, bound, n, is_read``.
    """
    asked = _Asked.of(index, queries, staging)
    bounds = block_bounds(asked)
    before = Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "block").rowsBetween(Window.unboundedPreceding, -1)
    alone = _names_one_text(index)
    # Texts of one id count together, whatever their blocks: the bound of one block says nothing about them.
    is_first = F.coalesce(F.sum("n").over(before), F.lit(0)) < FIRST_POSTINGS * pool if alone else F.lit(True)
    bounds = materialize(bounds.withColumn("is_first", is_first), staging)
    first = bounds.where("is_first")
    order = [F.desc("score"), F.asc(index.ids[0])]
    runs = _run_scorer(asked, pool) if alone else None
    if runs is None:
        posted = asked.postings()
        firsts = asked.scores(_in_blocks(posted, first), first)
    else:
        firsts = runs(first)
    with small_batches(queries.sparkSession):
        found = materialize(top_per_group(firsts, ["query_id"], order, pool).drop("rank"), staging)
    # With fewer than ``pool`` texts there is no score to reach. Scores are rounded, so bounds get that much room.
    reached = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= pool, F.min("score")).alias("least"))
    open_ = F.col("least").isNull() | (F.col("bound") + 10.0**-SCORE_DIGITS >= F.col("least"))
    bounds = bounds.join(reached, "query_id", "left").withColumn("is_read", F.col("is_first") | open_).drop("least")
    bounds = materialize(bounds, staging)
    rest = bounds.where("is_read AND NOT is_first")
    if runs is not None:  # texts of the first blocks were scored for all queries
        rest = rest.join(broadcast_if_small(bounds.where("is_first").select("segment", "block").distinct())[0], ["segment", "block"], "left_anti")
    scored = found
    if not rest.isEmpty():
        if runs is None:
            scored = found.unionByName(asked.scores(_in_blocks(posted, rest), rest))
        else:  # the best rows of each task only
            with small_batches(queries.sparkSession):
                scored = found.unionByName(materialize(runs(rest), staging))
    return scored, bounds.drop("is_first")


def _names_one_text(index: LexicalIndex) -> bool:
    if index.packed is None:
        return True
    return index.packed.texts.groupBy(*index.ids).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def _run_scorer(asked: _Asked, pool: int) -> Callable[[DataFrame], DataFrame] | None:
    """Scores all queries on the texts of some blocks, run by run; None if there are too many queries. Ids must name one text each.

    Postings stay packed until the task that has all those of a run; it turns them into counted texts, and the best rows leave it.
    """
    index = asked.index
    if index.packed is None or asked.words is None or not has_at_most(asked.wanted, BROADCAST_ROWS):
        return None
    ids = list(index.ids)
    spark = asked.wanted.sparkSession
    spark_key, arrow_key = query_key(asked.weighted.schema["query_id"].dataType)
    schema = hit_schema(index.packed.texts, ids, spark_key)
    pairs = asked.weighted.collect()
    weights = {r["term"]: r["idf"] for r in pairs}
    names, table = _query_table(pairs, lambda words: np.array([weights[w] for w in words]))
    shared = spark.sparkContext.broadcast(table)
    avg_len = pairs[0]["avg_len"] if pairs else 0.0
    scan = _scorer(shared, names, ids, pool, avg_len, arrow_key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return scan(b.select([*ids, "doc_len", "terms"]) for b in by_text(batches, ids, False))

    def score(chosen: DataFrame) -> DataFrame:
        if not pairs:
            return spark.createDataFrame([], schema)
        rows = index.packed.rows
        rows = only_blocks(asked.of_terms(rows).unionByName(rows.where("term = ''")), chosen)
        if index.packed.gone is None:
            rows = rows.withColumn("gone", F.lit(None).cast("array<smallint>"))
        else:
            heads = rows.where("term = ''").join(index.packed.gone, ["segment", "run"], "left")
            rows = rows.where("term <> ''").unionByName(heads, allowMissingColumns=True)
        n = chosen.agg(F.sum("n")).first()[0] or 0
        return over_runs(rows.select("segment", "run", "term", "at", "tf", "texts", "gone"), n, run, schema)

    return score


def _salted_join(posted: DataFrame, weighted: DataFrame, key: str) -> DataFrame:
    """Join on term with every term spread over ``SALTS`` tasks."""
    salt = F.pmod(F.xxhash64(F.col(key)), F.lit(SALTS)).cast("int")
    copies = weighted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return posted.withColumn("salt", salt).join(copies, ["term", "salt"]).drop("salt")


def bm25_search(index: LexicalIndex, queries: DataFrame, pool: int, staging: str | None = None) -> DataFrame:
    """Best ``pool`` texts per query with a 0-based rank; ties go to the lower id."""
    order = [F.desc("score"), F.asc(index.ids[0])]
    scored = None
    if index.terms is not None:
        scored = _score_in_place(index, queries, pool)
    elif index.blocks is not None:
        scored = bm25_pruned(index, queries, pool, staging)[0]
    if scored is None:
        scored = bm25_scores(index, queries, staging)
    return top_per_group(scored, ["query_id"], order, pool)


def _some_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, SCORE_TEXTS):
            yield whole.slice(at, SCORE_TEXTS)


def _runs_of_texts(text: np.ndarray, copies: np.ndarray) -> Iterator[slice]:
    """Entries (ordered by text) in runs of at most ``SCORE_WEIGHTS`` copies or of one text; no text is in two runs."""
    sofar, at = np.cumsum(copies), 0
    while at < len(text):
        before = sofar[at] - copies[at]
        end = int(np.searchsorted(sofar, before + SCORE_WEIGHTS, side="right"))
        if end < len(text):
            end = int(np.searchsorted(text, text[end]))
        if end <= at:
            end = int(np.searchsorted(text, text[at], side="right"))
        yield slice(at, end)
        at = end


def _count_words(terms: DataFrame, words: list[str]) -> tuple[int, float, np.ndarray]:
    """Number of texts, their mean length and how many hold each word, in one pass.

    A task emits one row per word plus one with its totals.
    """
    shared = terms.sparkSession.sparkContext.broadcast(words)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = pa.array(shared.value, pa.string())
        held = np.zeros(len(lookup), dtype=np.int64)
        texts = length = 0
        for batch in _some_texts(batches):
            word = pc.index_in(batch.column(1).flatten(), lookup).drop_null().to_numpy()
            held += np.bincount(word, minlength=len(lookup))
            texts += batch.num_rows
            length += pc.sum(batch.column(0)).as_py() or 0
        seen = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict(
            {
                "slot": pa.array([-1, *seen], pa.int64()),
                "n": pa.array([texts, *held[seen]], pa.int64()),
                "length": pa.array([length, *[0] * len(seen)], pa.int64()),
            }
        )

    parts = terms.select("doc_len", F.col("terms.term")).mapInArrow(
        scan, "slot long, n long, length long"
    )
    totals = parts.groupBy("slot").agg(F.sum("n").alias("n"), F.sum("length").alias("length"))
    frequency, n_docs, length = np.zeros(len(words)), 0, 0
    for row in totals.collect():  # at most one row per word of the queries
        if row["slot"] < 0:
            n_docs, length = row["n"], row["length"]
        else:
            frequency[row["slot"]] = row["n"]
    return n_docs, (length / n_docs if n_docs else 0.0), frequency


def _score_in_place(index: LexicalIndex, queries: DataFrame, pool: int) -> DataFrame | None:
    """Best rows of every partition of the counted texts; None if there are too many queries.

    Every task holds the queries as a sparse term-by-query table. The terms of
    a batch are looked up in it, and the weights of all matches are summed into
    one score per text and query that have a term in common.
    """
    wanted = query_terms(queries.select("query_id", "query"), index.tokenizer)
    if not has_at_most(wanted, BROADCAST_ROWS):
        return None
    pairs = wanted.collect()
    ids = list(index.ids)
    spark = queries.sparkSession
    spark_key, arrow_key = query_key(queries.schema["query_id"].dataType)
    schema = hit_schema(index.terms, ids, spark_key)
    if not pairs:
        return spark.createDataFrame([], schema)

    n_docs, avg_len = 0, 0.0

    def weigh(words: list[str]) -> np.ndarray:
        nonlocal n_docs, avg_len
        n_docs, avg_len, frequency = _count_words(index.terms, words)
        return np.log10((n_docs - frequency + 0.5) / (frequency + 0.5) + 1)

    names, table = _query_table(pairs, weigh)
    scan = _scorer(spark.sparkContext.broadcast(table), names, ids, pool, avg_len, arrow_key)
    return index.terms.select(*ids, "doc_len", "terms").mapInArrow(scan, schema)


def _query_table(pairs: list, weigh: Callable[[list[str]], np.ndarray]) -> tuple[list, dict]:
    """Names of the queries, and a sparse term-by-query table of rows ``query_id, term``; ``weigh``: the idf of words."""
    names = sorted({p["query_id"] for p in pairs})
    slot = {name: n for n, name in enumerate(names)}
    asked: dict[str, list[int]] = {}
    for p in pairs:
        asked.setdefault(p["term"], []).append(slot[p["query_id"]])
    words = sorted(asked)
    table = {
        "words": words,
        "idf": weigh(words),
        "first": np.cumsum([0, *[len(asked[w]) for w in words]]),
        "queries": np.array([q for w in words for q in asked[w]], dtype=np.int64),
    }
    return names, table


def _scorer(table: Broadcast, names: list, ids: list[str], pool: int, avg_len: float, arrow_key: pa.DataType):
    """From batches of ``ids, doc_len, terms`` to the best rows of every query."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        lookup, first = pa.array(known["words"], pa.string()), known["first"]
        best = BestPerQuery(names, ids, pool)
        for batch in _some_texts(batches):
            lists = batch.column(len(ids) + 1)
            entries = lists.flatten()
            word = pc.index_in(entries.field("term"), lookup)
            hit = word.is_valid().to_numpy(zero_copy_only=False)
            word = word.drop_null().to_numpy()
            text = pc.list_parent_indices(lists).to_numpy()[hit]
            tf = entries.field("tf").to_numpy(zero_copy_only=False)[hit].astype(np.float64)
            length = batch.column(len(ids)).to_numpy(zero_copy_only=False)[text]
            weight = term_weight(tf, length, avg_len, known["idf"][word])
            copies = first[word + 1] - first[word]
            rows = pa.table({i: batch.column(n) for n, i in enumerate(ids)})
            for run in _runs_of_texts(text, copies):
                # One entry per (text, term) becomes one per query that has the term.
                n = copies[run]
                source = np.repeat(np.arange(run.start, run.stop), n)
                nth = np.arange(len(source)) - np.repeat(np.cumsum(n) - n, n)
                query = known["queries"][first[word[source]] + nth]
                # Sums over the pairs that occur, ordered by query and text.
                pair = query * batch.num_rows + text[source]
                order = np.argsort(pair, kind="stable")
                starts = np.flatnonzero(np.append(True, np.diff(pair[order]) > 0))
                scores = half_up(np.add.reduceat(weight[source][order], starts))
                pair = pair[order][starts]
                # Of many pairs few can still be among the best.
                able = scores >= best.floors[pair // batch.num_rows]
                pair, scores = pair[able], scores[able]
                if not len(pair):
                    continue
                ends = np.flatnonzero(np.diff(pair // batch.num_rows, append=-1)) + 1
                for low, high in zip(np.append(0, ends[:-1]), ends, strict=True):
                    matched = pair[low:high] % batch.num_rows
                    best.offer(int(pair[low] // batch.num_rows), scores[low:high], rows.take(pa.array(matched)))
        yield from best.batches(arrow_key)

    return scan
