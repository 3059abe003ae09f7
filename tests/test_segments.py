"""A lexical index in segments against one built anew, and how much of it a query reads."""

import random

import pytest
from pyspark.sql import functions as F

from lorekeep.functions.tokens import Tokenizer
from lorekeep.operators import segments
from lorekeep.operators.lexical import LexicalIndex, bm25_pruned, bm25_scores, bm25_search

SCHEMA = "id string, body string, batch int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, b) for (i, b), t in rows.items()], SCHEMA)


def text(r):
    return " ".join(r.choices(["red", "pump", "valve", "the", "rice", "oven"] + [f"w{chr(97 + i)}" for i in range(26)], k=r.randint(0, 15)))


def anew(spark, rows):
    return LexicalIndex.of(frame(spark, rows).select("id", "body"), ["id"], "body")


def questions(spark):
    return spark.createDataFrame([(1, "red pump"), (2, "the"), (3, "wa wb wc"), (4, "unknown"), (5, "")], "query_id long, query string")


def hits(df):
    return sorted((r.query_id, r.id, r.score) for r in df.collect())


@pytest.fixture
def store(spark, tmp_path):
    return segments.SegmentStore(spark, str(tmp_path / "index"), ["id"], Tokenizer())


def test_index_after_every_commit(spark, store, monkeypatch):
    monkeypatch.setattr(segments, "FAN_OUT", 3)
    tokenised = []
    plain = segments.term_table
    monkeypatch.setattr(segments, "term_table", lambda df, *a: tokenised.append(df.count()) or plain(df, *a))
    r = random.Random(4)
    rows, want = {}, []
    for batch in range(1, 7):
        gone = r.sample(sorted(rows), min(len(rows), 2)) if batch > 1 else []
        for key in gone:
            del rows[key]
        # An id that was removed may come back with another text.
        added = {(f"d{batch}-{n}", batch): text(r) for n in range(5)} | {(i, batch): text(r) for i, _ in gone[:1]}
        rows |= added
        store.refresh(frame(spark, rows), "body", set(range(1, batch + 1)), str(batch))
        want.append(len(added))
        index, fresh = store.index(str(batch)), anew(spark, rows)
        assert index.stats.first() == fresh.stats.first()
        assert {tuple(x) for x in index.frequencies.collect()} == {tuple(x) for x in fresh.frequencies.collect()}
        assert hits(bm25_scores(index, questions(spark))) == hits(bm25_scores(fresh, questions(spark)))
    assert tokenised == want  # new rows only
    assert len(store.segments()) < 6 and store.is_at("6") and not store.is_at("7")
    assert store.sweep("6") > 0
    assert hits(bm25_search(store.index("6"), questions(spark), 3)) == hits(bm25_search(anew(spark, rows), questions(spark), 3))


def test_an_index_of_nothing(spark, store):
    store.refresh(spark.createDataFrame([], SCHEMA), "body", set(), "1")
    assert store.index("1").stats.first()["n_docs"] == 0
    assert bm25_search(store.index("1"), questions(spark), 3).collect() == []
    rows = {("a", 1): "red"}
    store.refresh(frame(spark, rows), "body", {1}, "2")
    assert [x.id for x in bm25_search(store.index("2"), questions(spark), 3).collect()] == ["a"]
    store.refresh(spark.createDataFrame([], SCHEMA), "body", {1}, "3")
    assert tuple(store.index("3").stats.first()) == (0, 0.0)
    assert bm25_search(store.index("3"), questions(spark), 3).collect() == []


def test_pruned_ranking_reads_part_of_the_postings(spark, store, monkeypatch):
    monkeypatch.setattr(segments, "BLOCK_TEXTS", 8)
    r = random.Random(5)
    # Lengths differ much, so bounds do, too.
    rows = {(f"d{n}", 1 + n % 2): " ".join(["red"] * r.choice([0, 0, 1, 1, 4]) + ["the"] * r.randint(0, 2) + ["filler"] * r.randint(0, 300)) for n in range(900)}
    rows |= {("tie-a", 1): "red red red", ("tie-b", 2): "red red red"}
    store.refresh(frame(spark, rows), "body", {1, 2}, "1")
    removed = next(k for k, t in rows.items() if "red" in t)
    del rows[removed]
    store.refresh(frame(spark, rows), "body", {1, 2}, "2")
    index = store.index("2")
    q = spark.createDataFrame([(1, "red"), (2, "the red"), (3, "nothing"), (4, "filler")], "query_id long, query string")
    for pool in (1, 2, 7, 5000):
        want = bm25_search(anew(spark, rows), q, pool)
        assert hits(bm25_search(index, q, pool)) == hits(want)
    scored, blocks = bm25_pruned(index, q, 5)
    share = {x.query_id: x.share for x in blocks.groupBy("query_id").agg((F.sum(F.when(F.col("is_read"), F.col("n")).otherwise(0)) / F.sum("n")).alias("share")).collect()}
    assert share[1] < 0.35 and share[2] < 0.6 and share[4] < 0.6 and 3 not in share, share
    every = {x.query_id: x.n for x in blocks.groupBy("query_id").agg(F.sum("n").alias("n")).collect()}
    assert every[1] == sum("red" in t for t in rows.values()) + 1  # with the posting of the removed text
