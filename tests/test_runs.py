"""Postings packed in runs: stored without an exchange, read back whole, small on disk."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lorekeep.functions.tokens import Tokenizer
from lorekeep.operators import lexical, runs, segments
from lorekeep.operators.lexical import LexicalIndex, bm25_pruned, bm25_search, term_table

SCHEMA = "id string, body string, batch int"


def words(n, at_most=25):
    draw = random.Random(7)
    known = [a + b + c for a in "abcdefgh" for b in "uvwxyz" for c in "klm"]
    return [" ".join(draw.choices(known, k=draw.randint(0, at_most))) for _ in range(n)]


def hits(df):
    return sorted((r.query_id, r.id, r.score) for r in df.collect())


def questions(spark):
    return spark.createDataFrame([(1, "auk bvl cwm"), (2, "hzm"), (3, "duk dul dum evk fwl"), (4, "none")], "query_id long, query string")


@pytest.fixture
def small_runs(monkeypatch):
    monkeypatch.setattr(runs, "RUN_TEXTS", 50)
    monkeypatch.setattr(runs, "PIECE_TEXTS", 7)
    monkeypatch.setattr(segments, "BLOCK_TEXTS", 8)


def test_runs_hold_all_postings(spark, small_runs):
    rows = [(f"t{i}" if i % 50 else None, t, 1) for i, t in enumerate(words(300))]
    terms = term_table(spark.createDataFrame(rows, SCHEMA).repartition(3), ["id", "batch"], "body", Tokenizer())
    packed = runs.packed(terms, ["id"], 8).withColumn("segment", F.lit(1).cast("long")).localCheckpoint()
    plain = lambda df: sorted((str(r.id), r.batch, r.doc_len, tuple(map(tuple, r.terms))) for r in df.collect())
    assert plain(runs.texts_with_terms(packed, 10, ["id"])) == plain(terms)
    # Each block of a term is in one row, its bounds are those of its texts, and texts of a run are ordered by length.
    texts = runs.texts_in(packed)
    each = packed.where("term <> ''").select("run", "term", F.explode(F.arrays_zip("at", "tf")).alias("p")).select("run", "term", "p.*").join(texts, ["run", "at"])
    wanted = each.groupBy("term", "block").agg(F.max("tf").alias("max_tf"), F.min("doc_len").alias("min_len"), F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, runs.blocks_of(packed).collect())) == sorted(map(tuple, wanted.collect()))
    assert max(r["count"] for r in texts.groupBy("block").count().collect()) == 8
    lengths = {}
    for r in texts.orderBy("run", "at").collect():
        lengths.setdefault(r.run, []).append(r.doc_len)
    assert all(x == sorted(x) for x in lengths.values()) and max(map(len, lengths.values())) == 50


def test_an_index_is_stored_without_sending_texts_or_postings(spark, small_runs, tmp_path, monkeypatch):
    plans = []
    plain = segments.packed
    monkeypatch.setattr(segments, "packed", lambda *a: (plans.append(plain(*a)), plans[-1])[1])
    store = segments.SegmentStore(spark, str(tmp_path / "index"), ["id"], Tokenizer())
    texts = words(2000, 120)
    df = spark.createDataFrame([(f"t{i:05d}", t, 1) for i, t in enumerate(texts)], SCHEMA)
    monkeypatch.setattr(runs, "RUN_TEXTS", 2048)
    store.refresh(df, "body", {1}, "1")
    assert "Exchange" not in plans[0]._jdf.queryExecution().executedPlan().toString()
    held = {p: sum(f.stat().st_size for f in Path(store.path, p).rglob("*.parquet")) for p in ("postings", "texts", "blocks")}
    # A posting takes a few bytes; before, texts with their terms and every posting with its id were stored.
    n = store.index("1").posted.count()
    assert (held["postings"] + held["texts"]) / n < 5 and not Path(store.path, "_staging").exists()


def test_ranking_from_runs_with_gone_and_repeated_texts(spark, small_runs, tmp_path, monkeypatch):
    store = segments.SegmentStore(spark, str(tmp_path / "index"), ["id"], Tokenizer())
    rows = [(f"t{i:03d}", t, 1 + i % 2) for i, t in enumerate(words(400))]
    store.refresh(spark.createDataFrame(rows, SCHEMA), "body", {1, 2}, "1")
    rows = [r for i, r in enumerate(rows) if i % 9]
    store.refresh(spark.createDataFrame(rows, SCHEMA), "body", {1, 2}, "2")
    used = []
    plain = lexical.only_blocks
    monkeypatch.setattr(lexical, "only_blocks", lambda *a: (used.append(1), plain(*a))[1])
    for pool in (1, 5, 1000):
        anew = LexicalIndex.of(spark.createDataFrame(rows, SCHEMA).select("id", "body"), ["id"], "body")
        assert hits(bm25_search(store.index("2"), questions(spark), pool)) == hits(bm25_search(anew, questions(spark), pool))
    assert used
    # More chosen blocks than are broadcast, and more places that are gone.
    monkeypatch.setattr(runs, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(segments, "GONE_ROWS", 0)
    store.refresh(spark.createDataFrame(rows[5:], SCHEMA), "body", {1, 2}, "3")
    anew = LexicalIndex.of(spark.createDataFrame(rows[5:], SCHEMA).select("id", "body"), ["id"], "body")
    assert hits(bm25_search(store.index("3"), questions(spark), 5)) == hits(bm25_search(anew, questions(spark), 5))
    assert {tuple(x) for x in store.index("3").frequencies.collect()} == {tuple(x) for x in anew.frequencies.collect()}
    # Texts of one id count together, as they did before.
    used.clear()
    twice = segments.SegmentStore(spark, str(tmp_path / "twice"), ["id"], Tokenizer())
    twice.refresh(spark.createDataFrame(rows + rows[:9], SCHEMA), "body", {1, 2}, "1")
    every = hits(lexical.bm25_scores(twice.index("1"), questions(spark)))
    assert hits(bm25_pruned(twice.index("1"), questions(spark), 1000)[0]) == every and not used
    best = sorted(-score for query, _, score in every if query == 3)[:3]
    assert sorted(-score for query, _, score in hits(bm25_search(twice.index("1"), questions(spark), 3)) if query == 3) == best


def test_an_index_of_the_former_layout_is_built_anew(spark, small_runs, tmp_path):
    store = segments.SegmentStore(spark, str(tmp_path / "index"), ["id"], Tokenizer())
    log = tmp_path / "index" / "_log"
    log.mkdir(parents=True)
    (log / "00000001").write_text('{"number": 1, "batches": [1], "texts": 2, "replaces": []}')
    old = [tmp_path / "index" / "postings" / "segment=1", tmp_path / "index" / "gone" / "version=1" / "segments"]
    for folder in old:
        folder.mkdir(parents=True)
        (folder / "_SUCCESS").touch()
    assert store.exists() and not store.is_at("1")
    store.refresh(spark.createDataFrame([("a", "auk", 1), ("b", "hzm hzm", 1)], SCHEMA), "body", {1}, "1")
    assert store.is_at("1") and [(r.query_id, r.id) for r in bm25_search(store.index("1"), questions(spark), 3).orderBy("query_id").collect()] == [(1, "a"), (2, "b")]
    assert store.sweep("1") == 2 and not old[0].exists() and store.is_at("1")


def test_session_keeps_its_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    with runs.small_batches(spark):
        assert spark.conf.get(name) == str(runs.BATCH_ROWS)
    assert spark.conf.get(name, None) == before
