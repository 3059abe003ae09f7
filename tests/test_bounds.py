"""What a task or a worker holds does not grow with the table."""

import random
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lorekeep import KnowledgeBase, Settings
from lorekeep.functions.tokens import Tokenizer
from lorekeep.operators import common, lexical
from lorekeep.operators.lexical import LexicalIndex
from lorekeep.operators.segments import SegmentStore
from lorekeep.operators.topk import BestPerQuery
from lorekeep.plans.ingest import ingest_files
from lorekeep.sources import html


def _rows(spark, n):
    draw = random.Random(3)
    words = [a + b for a in "abcdef" for b in "uvwxyz"]
    return spark.createDataFrame([(f"{i:05d}", " ".join(draw.choices(words, k=12))) for i in range(n)], "id string, body string")


def _questions(spark):
    return spark.createDataFrame([(1, "au bv cw"), (2, "bv dx ey fz"), (3, "none")], "query_id long, query string")


def test_weights_are_summed_in_bounded_runs(monkeypatch):
    monkeypatch.setattr(lexical, "SCORE_WEIGHTS", 10)
    draw = random.Random(1)
    text = np.sort(np.array([draw.randrange(40) for _ in range(200)]))
    copies = np.array([draw.randrange(4) for _ in range(200)])
    runs = list(lexical._runs_of_texts(text, copies))
    assert [i for r in runs for i in range(r.start, r.stop)] == list(range(200))
    for r in runs:
        assert copies[r].sum() <= 10 or len(set(text[r])) == 1
    for one, two in zip(runs, runs[1:]):
        assert text[one.stop - 1] < text[two.start]


def test_runs_of_many_batches_rank_as_the_stored_index(spark, tmp_path):
    rows, questions = _rows(spark, 3 * lexical.SCORE_TEXTS + 7), _questions(spark)
    index = LexicalIndex.of(rows.coalesce(1), ["id"], "body", keep=True)
    index.save(str(tmp_path / "index"))
    stored = LexicalIndex.load(spark, str(tmp_path / "index"), ["id"], Tokenizer())
    found, wanted = (sorted(map(tuple, lexical.bm25_search(i, questions, 20).collect())) for i in (index, stored))
    assert found == wanted and len(found) == 40


def test_floor_of_a_full_list_keeps_ties():
    best = BestPerQuery([1], ["id"], 2)
    best.offer(0, np.array([1.0, 3.0, 2.0]), pa.table({"id": ["a", "b", "c"]}))
    assert best.floors[0] == 2.0
    best.offer(0, np.array([2.0]), pa.table({"id": ["aa"]}))
    assert best.best[0]["id"].to_pylist() == ["b", "aa"]


def test_more_postings_make_more_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "TASK_ROWS", 50)
    rows, cores = _rows(spark, 200), spark.sparkContext.defaultParallelism
    index = LexicalIndex.of(rows, ["id"], "body")
    index.save(str(tmp_path / "index"))
    files = spark.read.parquet(str(tmp_path / "index" / "postings")).select(F.input_file_name().alias("f"))
    part = F.regexp_extract("f", r"part-(\d+)", 1)
    assert files.select(part).distinct().count() > max(cores, 2000 // 50 // 2)
    asked = lexical._Asked.of(index, _questions(spark))
    assert asked.n_weights > 50 * cores or asked.n_weights > 100
    assert asked.scores(asked.postings()).rdd.getNumPartitions() >= asked.n_weights // 50
    store = SegmentStore(spark, str(tmp_path / f"segments-{uuid.uuid4().hex}"), ["id"], Tokenizer())
    store.refresh(rows.withColumn("batch", F.lit(1)), "body", {1}, "1")
    found, wanted = (sorted(map(tuple, lexical.bm25_search(i, _questions(spark), 20).collect())) for i in (store.index("1"), index))
    assert found == wanted
    blocks = spark.read.parquet(f"{store.path}/blocks").groupBy("term", "block").count()
    assert blocks.where("count > 1").isEmpty()


def test_pages_leave_in_slices():
    pages = pa.array([f"<p>page {i}</p>" if i % 7 else None for i in range(2 * html.SLICE_PAGES + 5)])
    parts = list(html._matches(iter([pages])))
    assert max(map(len, parts)) <= html.SLICE_PAGES and sum(map(len, parts)) == len(pages)
    found = pa.concat_arrays(parts).to_pylist()
    assert found[0] is None and found[-1][0]["text"] == f"page {len(pages) - 1}"


def test_ingestion_writes_chunks_once(spark, tmp_path, monkeypatch):
    from lorekeep.plans import ingest

    kb = KnowledgeBase(spark, str(tmp_path / "kb"), Settings(embed_dim=4))
    kb.initialize()
    written = []
    monkeypatch.setattr(ingest, "materialize", lambda df, fallback=None: (written.append(df.columns), common.materialize(df, fallback))[1])
    files = spark.createDataFrame([("/a/one.txt", b"# T\n\nsome text here"), ("/a/two.txt", b"more of it")], "path string, content binary")
    outcome = {r["path"]: r["n_chunks"] for r in ingest_files(kb, files).collect()}
    assert sum(outcome.values()) == kb.chunks.count() > 0 and min(outcome.values()) > 0
    assert not any("chunk_index" in columns for columns in written)
