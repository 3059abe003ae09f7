import hashlib

import pytest
from pyspark.sql import functions as F

from lorekeep.backends import ContextTooLong, HashingEmbedder, describe_image, embed_text
from lorekeep.plans import backfill, evaluate, migrate
from lorekeep.plans.ask import answer_frames, as_queries, benchmark_prompts, web_prompts
from lorekeep.plans.ingest import ingest_directory, ingest_files, rechunk
from lorekeep.plans.search import search
from lorekeep.operators import upkeep
from lorekeep.session import KnowledgeBase, Settings
from lorekeep.streaming.ingest import stream_ingest, watch_directory

EMBED = HashingEmbedder(4)


def files(spark, *rows):
    data = [(p, c if isinstance(c, bytes) else c.encode()) for p, c in rows]
    return spark.createDataFrame(data, "path string, content binary")


def statuses(outcome):
    return {r["path"]: r["status"] for r in outcome.collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows(kb):
    return {n: kb.table(n).count() for n in ("documents", "document_content", "document_ai_metadata", "chunks")}


def test_initialize_twice_keeps_data(kb, spark):
    ingest_files(kb, files(spark, ("/d/a.txt", "alpha")))
    kb.initialize()
    assert rows(kb) == {"documents": 1, "document_content": 1, "document_ai_metadata": 1, "chunks": 1}
    types = {f.name: f.dataType.simpleString() for f in kb.chunks.schema}
    assert types["embedding"] == "array<float>" and types["chunk_index"] == "int"


def test_state_machine(kb, spark):
    first = files(
        spark,
        ("/d/a.md", "# Head\nalpha text"), ("/d/b.txt", "beta"), ("/d/copy.txt", "beta"),
        ("/d/x.exe", "beta"), ("/d/empty.txt", "  \n "), ("/d/bad.docx", "zip?"),
    )
    got = ingest_files(kb, first, category="C", embedder=EMBED)
    assert statuses(got) == {
        "/d/a.md": "ok", "/d/b.txt": "ok", "/d/copy.txt": "dup", "/d/x.exe": "skip_binary",
        "/d/empty.txt": "empty", "/d/bad.docx": "parse_error",
    }
    assert rows(kb)["documents"] == 2
    doc = kb.documents.where("file_name = 'a.md'").first()
    assert doc["id"] == sha("# Head\nalpha text") and doc["category"] == "C" and doc["indexed_at"]
    chunk = kb.chunks.where(F.col("document_id") == doc["id"]).first()
    assert chunk["id"] == sha(f"{doc['id']}:0") and chunk["section"] == "Head" and len(chunk["embedding"]) == 4
    assert kb.content.where(F.col("document_id") == doc["id"]).first()["raw_text"] == "Head\nalpha text"

    again = ingest_files(kb, files(spark, ("/d/a.md", "# Head\nalpha text"), ("/d/b.txt", "beta 2"), ("/d/x.exe", "beta")))
    assert statuses(again) == {"/d/a.md": "dup", "/d/b.txt": "updated", "/d/x.exe": "dup"}
    assert {r["id"] for r in kb.documents.collect()} == {doc["id"], sha("beta 2")}
    assert rows(kb) == {"documents": 2, "document_content": 2, "document_ai_metadata": 2, "chunks": 2}


def test_failed_update_keeps_the_old_version(kb, spark):
    ingest_files(kb, files(spark, ("/d/a.txt", "good")))
    got = ingest_files(kb, files(spark, ("/d/a.txt", "   ")))
    assert statuses(got) == {"/d/a.txt": "empty"}
    assert [r["id"] for r in kb.documents.collect()] == [sha("good")]


def test_force_replaces_and_no_chunks_skips(kb, spark):
    ingest_files(kb, files(spark, ("/d/a.txt", "one")), with_chunks=False)
    assert rows(kb)["chunks"] == 0
    got = ingest_files(kb, files(spark, ("/e/a.txt", "one")), force=True, category="New")
    assert statuses(got) == {"/e/a.txt": "ok"}
    assert rows(kb) == {"documents": 1, "document_content": 1, "document_ai_metadata": 1, "chunks": 1}
    assert kb.documents.first()["file_path"] == "/e/a.txt"


def test_purge_compact_and_versions(kb, spark):
    ingest_files(kb, files(spark, ("/d/a.txt", "one"), ("/d/b.txt", "two")))
    kb.purge(kb.documents.where("file_name = 'a.txt'").select("id"))
    assert set(rows(kb).values()) == {1}
    before = kb.version
    kb.compact()
    assert kb.version != before and set(rows(kb).values()) == {1}
    ingest_files(kb, files(spark, ("/d/a.txt", "one")))  # deleted content may come back
    assert set(rows(kb).values()) == {2}
    assert kb.vacuum() > 0 and set(rows(kb).values()) == {2} and kb.vacuum() == 0


def test_a_commit_beside_a_compaction_is_kept(kb, spark):
    ingest_files(kb, files(spark, ("/d/a.txt", "one"), ("/d/b.txt", "two")))
    log = kb._log()
    number = kb._reserve()  # an ingestion that began before the compaction and ends after it
    kb.compact()
    assert [e["batch"] for e in kb._log()] != [e["batch"] for e in log]
    other = KnowledgeBase(spark, kb.root, kb.settings)
    other._reserve = lambda: number
    removed = kb.documents.where("file_name = 'a.txt'").select("id")
    rows_of_c = spark.createDataFrame([("c", "c.txt")], "id string, file_name string")
    other.commit(upserts={"documents": rows_of_c}, removed={"documents": removed})
    assert {r.file_name for r in kb.documents.collect()} == {"b.txt", "c.txt"}
    kb.compact()
    assert {r.file_name for r in kb.documents.collect()} == {"b.txt", "c.txt"}


def test_a_removal_beside_a_compaction_is_kept(kb, spark):
    """An ingestion reserves its number, another commits a later one, both are compacted, then the first ends."""
    ingest_files(kb, files(spark, ("/d/a.txt", "one"), ("/d/b.txt", "two")))
    number = kb._reserve()
    ingest_files(kb, files(spark, ("/d/c.txt", "three")))
    removed = kb.documents.where("file_name IN ('a.txt', 'c.txt')").select("id")
    kb.compact()
    other = KnowledgeBase(spark, kb.root, kb.settings)
    other._reserve = lambda: number
    other.commit(removed={"documents": removed})
    # It removes what is older than its number: c.txt came later.
    assert {r.file_name for r in kb.documents.collect()} == {"b.txt", "c.txt"}
    kb.compact()
    assert {r.file_name for r in kb.documents.collect()} == {"b.txt", "c.txt"}


def test_an_index_follows_every_commit(kb, spark):
    ingest_files(kb, files(spark, ("/d/a.txt", "pump")))
    number = kb._reserve()
    ingest_files(kb, files(spark, ("/d/b.txt", "valve")))
    backfill.build_indexes(kb)
    other = KnowledgeBase(spark, kb.root, kb.settings)
    other._reserve = lambda: number
    ingest_files(other, files(spark, ("/d/c.txt", "late pump")))
    corpus = backfill.corpus_of(kb)
    assert corpus.document_index is not None
    hits = search(corpus, as_queries(spark, "late"), k=3, mode="fts").collect()
    assert [r["file_name"] for r in hits] == ["c.txt"]


def test_an_index_of_no_chunks_loads(kb, spark):
    ingest_files(kb, files(spark, ("/d/a.txt", "pump")), with_chunks=False)
    backfill.build_indexes(kb)
    hits = search(backfill.corpus_of(kb), as_queries(spark, "pump"), k=3, mode="fts").collect()
    assert [(r["file_name"], r["level"]) for r in hits] == [("a.txt", "document")]


def test_uncommitted_rows_are_invisible(kb, spark):
    ingest_files(kb, files(spark, ("/d/a.txt", "one")))
    dead = kb._reserve()  # a job that wrote rows and died
    kb.documents.write.parquet(f"{kb.root}/documents/batch={dead}")
    assert kb.documents.count() == 1
    ingest_files(kb, files(spark, ("/d/b.txt", "two")))
    assert kb.documents.count() == 2


def test_directory_sync(kb, spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "_Archives").mkdir(parents=True)
    for name, text in (("a.txt", "one"), ("b.md", "two"), ("c.py", "three"), ("_Archives/d.txt", "four")):
        (folder / name).write_text(text)
    got = ingest_directory(kb, str(folder))
    assert {p.rsplit("/", 1)[1]: s for p, s in statuses(got).items()} == {"a.txt": "ok", "b.md": "ok"}
    ingest_files(kb, files(spark, ("/elsewhere/z.txt", "zzz")))
    (folder / "a.txt").unlink()
    ingest_directory(kb, str(folder), extensions=["md"])
    assert {r["file_name"] for r in kb.documents.collect()} == {"b.md", "z.txt"}


def test_stream_equals_batch(kb, spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for n in range(7):
        (folder / f"f{n}.txt").write_text(f"text number {n % 5}")
    watch_directory(kb, str(folder), str(tmp_path / "cp"), max_files=4).awaitTermination()
    assert rows(kb)["documents"] == 5
    (folder / "new.txt").write_text("later")
    watch_directory(kb, str(folder), str(tmp_path / "cp"), max_files=4).awaitTermination()
    whole = KnowledgeBase(spark, str(tmp_path / "kb2"), Settings(embed_dim=4))
    whole.initialize()
    ingest_directory(whole, str(folder), sync=False)
    key = lambda b: {(r["id"], r["text"]) for r in b.chunks.collect()}
    assert key(kb) == key(whole) and len(key(kb)) == 6


def test_replayed_batch_changes_nothing(kb, spark, tmp_path):
    batch = files(spark, ("/d/a.txt", "one"))
    batch.write.parquet(str(tmp_path / "src"))
    for name in ("cp1", "cp2"):  # a lost checkpoint replays everything
        source = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "src"))
        stream_ingest(kb, source, str(tmp_path / name)).awaitTermination()
    assert set(rows(kb).values()) == {1}


def test_rechunk_restores_missing_chunks(kb, spark):
    ingest_files(kb, files(spark, ("/d/a.md", "# Head\nbody"), ("/d/b.txt", "plain")), with_chunks=False)
    rechunk(kb)
    assert {(r["text"], r["section"]) for r in kb.chunks.collect()} == {("Head\nbody", None), ("plain", None)}
    rechunk(kb, files(spark, ("/d/a.md", "# Head\nbody")))
    assert {(r["text"], r["section"]) for r in kb.chunks.collect()} == {("Head\nbody", "Head"), ("plain", None)}


# --------------------------------------------------------------------- vectors


def test_backfill_is_idempotent(kb, spark):
    ingest_files(kb, files(spark, ("/d/a.txt", "one two"), ("/d/b.txt", "three")))
    assert backfill.embed_pending(kb, EMBED, limit=1) == {"embedded": 1, "failed": 0}
    assert backfill.embed_pending(kb, EMBED, filter_sql="file_name = 'none'") == {"embedded": 0, "failed": 0}
    assert backfill.embed_pending(kb, EMBED) == {"embedded": 1, "failed": 0}
    assert backfill.embed_pending(kb, EMBED) == {"embedded": 0, "failed": 0}
    assert backfill.embed_pending(kb, EMBED, rebuild=True) == {"embedded": 2, "failed": 0}
    assert backfill.embed_pending(kb, EMBED, "chunks") == {"embedded": 2, "failed": 0}
    assert kb.content.where("embedding is null").count() == 0 and kb.content.count() == 2


def test_failed_vectors_stay_pending(kb, spark):
    ingest_files(kb, files(spark, ("/d/a.txt", "good"), ("/d/b.txt", "bad")))
    fails = lambda text: None if "bad" in text else [1.0, 0.0, 0.0, 0.0]
    assert backfill.embed_pending(kb, fails) == {"embedded": 1, "failed": 1}
    assert upkeep.pending(kb.content, kb.documents, "raw_text", ["document_id"]).count() == 1


def test_filter_is_one_expression(kb, spark):
    ingest_files(kb, files(spark, ("/d/a.txt", "good")))
    with pytest.raises(Exception, match="PARSE|parse"):
        upkeep.pending(kb.content, kb.documents, "raw_text", [], filter_sql="true; DROP TABLE x")


def test_whole_texts_are_embedded_in_windows():
    seen = []

    def model(text):
        seen.append(len(text))
        if len(text) > 3000:
            raise ContextTooLong
        return [1.0, float("end" in text)]

    assert embed_text("x" * 4997 + "end", model, 2) == pytest.approx([2 / 5**0.5, 1 / 5**0.5])
    assert seen == [5000, 4000, 2000, 1000, 2000, 2000, 1000][: len(seen)] or sum(n for n in seen if n <= 3000) == 5000
    assert embed_text("y" * 8000, lambda t: [3.0], 1) == [3.0]
    assert embed_text("y" * 20_000, lambda t: None, 1) is None
    assert embed_text("y", lambda t: (_ for _ in ()).throw(ContextTooLong), 1) is None
    assert embed_text("x", lambda t: [1.0, 2.0], 1) is None
    assert embed_text("x", lambda t: 1 / 0, 1) is None


def test_describe_image_never_raises(monkeypatch):
    monkeypatch.setattr("lorekeep.backends.VISION_BACKOFF_SECONDS", 0)
    calls = []

    def flaky(image, mime):
        calls.append(mime)
        if len(calls) == 1:
            raise OSError
        return " text "

    assert describe_image(b"x", "application/pdf", flaky) == "text" and calls == ["image/png"] * 2
    assert describe_image(b"x", "image/gif", lambda i, m: 1 / 0) is None
    assert describe_image(b"", "image/png", flaky) is None
    assert describe_image(b"x", "image/png", None) is None


def test_settings():
    env = {"KB_VISION_ENABLED": "Yes", "KB_EMBED_MODEL": "m", "KB_VISION_DPI": "100"}
    found = Settings.from_env(env)
    assert found.vision_on() and found.vision_on(False) and found.vision_dpi == 100 and found.embed_model == "m"
    assert not Settings.from_env({}).vision_on() and Settings.from_env({}).vision_on(True)


# ---------------------------------------------------------------------- asking


@pytest.fixture
def filled(kb, spark):
    ingest_files(
        kb, files(spark, ("/d/pump.md", "# Pump\nInstall the red pump."), ("/d/rice.txt", "Cook the rice.")), embedder=EMBED
    )
    return kb


def test_search_with_stored_indexes(filled, spark):
    q = as_queries(spark, ["red pump", "rice"], EMBED, 4)
    derived = {(r["query_id"], r["chunk_id"], round(r["score"], 8)) for r in search(backfill.corpus_of(filled), q).collect()}
    backfill.build_indexes(filled)
    corpus = backfill.corpus_of(filled)
    assert corpus.document_index is not None and corpus.chunk_index is not None
    stored = {(r["query_id"], r["chunk_id"], round(r["score"], 8)) for r in search(corpus, q).collect()}
    assert stored == derived and stored
    ingest_files(filled, files(spark, ("/d/new.txt", "another pump")))
    fresh = backfill.corpus_of(filled)
    assert fresh.document_index.stats.first()["n_docs"] == filled.content.count()
    found = search(fresh, as_queries(spark, "another"), mode="fts").collect()
    assert [r["file_name"] for r in found] == ["new.txt"]


def test_prompts_and_frames(filled, spark):
    q = as_queries(spark, ["red pump", "unknownword"])
    got = {r["query_id"]: r for r in web_prompts(backfill.corpus_of(filled), q, mode="fts").collect()}
    assert got[0]["sources"] == ["pump.md - Pump"]
    assert '<document index="1">\n  <source>pump.md</source>\n  <content>Pump\nInstall' in got[0]["context"]
    assert got[1]["sources"] == [] and got[1]["context"] == "Aucun document trouvé."
    frames = list(answer_frames(got[0]["sources"], ["a", "", "b"]))
    assert frames[0].startswith('data: {"sources": ["pump.md') and frames[-1] == "data: [DONE]\n\n" and len(frames) == 4
    assert len(list(answer_frames([], []))) == 2

    def broken():
        yield "a"
        raise OSError("down")

    assert "down" in list(answer_frames(["s"], broken()))[2]


def test_benchmark_run_and_report(filled, spark):
    q = as_queries(spark, ["red pump", "rice"], EMBED, 4)
    prompts = benchmark_prompts(backfill.corpus_of(filled), q, "chunk")
    runs = evaluate.run_models(prompts, {"org/m1": lambda p: "<think>x</think> ok | yes", "m2": lambda p: 1 / 0})
    got = {(r["id"], r["model"]): r for r in runs.collect()}
    assert len(got) == 4 and got[(0, "org/m1")]["answer"] == "ok | yes"
    assert got[(1, "m2")]["answer"].startswith("[ERREUR: ")
    line = evaluate.markdown_rows(runs.where("id = 0 and model = 'org/m1'")).first()["line"]
    assert line.startswith("| 0 |  | m1 | ") and line.endswith("| ok / yes |")


def test_score_report(spark):
    scores = spark.createDataFrame(
        [(1, (2, 2, 1, 2), (2, 0, 0, 1)), (2, (1, 1, 1, 1), (2, 2, 2, 2))],
        "id long, m1 struct<F:int,P:int,C:int,H:int>, m2 struct<F:int,P:int,C:int,H:int>",
    )
    runs = spark.createDataFrame([(1, "m1", 10.0), (2, "m1", 20.0), (1, "m2", 5.0), (2, "m2", 5.0), (9, "m2", 500.0)], "id long, model string, elapsed_s double")
    got = {r["model"]: r for r in evaluate.score_report(evaluate.unpivot_scores(scores, ["m1", "m2"]), runs).collect()}
    assert (got["m1"]["total"], got["m1"]["maximum"], got["m1"]["mean_latency"]) == (11, 16, 15.0)
    assert got["m1"]["score10"] == pytest.approx(11 / 16 * 10) and got["m2"]["points_P"] == 2 and got["m2"]["mean_latency"] == 5.0


def test_compare_arms(spark):
    schema = "id long, context_sources array<string>, elapsed_s double, position long"
    base = spark.createDataFrame([(1, ["a"], 10.0, 0), (1, ["z"], 99.0, 1), (2, [], 20.0, 2), (3, ["q"], 1.0, 3)], schema)
    new = spark.createDataFrame([(1, ["x"], 1.0, 0), (1, ["a"], 5.0, 1), (2, [], 10.0, 2), (4, ["n"], 15.0, 3)], schema)
    rows = evaluate.compare_arms(base, new)
    got = {r["id"]: r for r in rows.collect()}
    assert got[1]["same_sources"] and not got[2]["same_sources"] and set(got) == {1, 2, 4}
    total = evaluate.comparison_summary(rows).first()
    assert (total["questions"], total["same_sources"], total["base_mean"], total["chunk_mean"]) == (3, 1, 15.0, 10.0)
    assert total["delta_percent"] == pytest.approx(-100 / 3)
    assert {r["id"] for r in evaluate.differing_sources(rows).collect()} == {4}


# ------------------------------------------------------------------- migration


def test_migration(spark):
    legacy = {
        "documents": spark.createDataFrame([("a",), ("b",)], "id string"),
        "document_content": spark.createDataFrame([("a", "t"), ("b", "u")], "document_id string, raw_text string"),
        "document_ai_metadata": spark.createDataFrame(
            [("a", '["x", "y"]'), ("b", None), ("c", "oops"), ("d", "[]")], "document_id string, keywords string"
        ),
    }
    plan = {r["step"]: (r["target"], r["action"], r["detail"]) for r in migrate.migration_plan(spark, legacy).collect()}
    assert [plan[n][1] for n in range(1, 7)] == ["skip", "skip", "change", "change", "change", "skip"]
    assert "1 unreadable" in plan[3][2]
    new = migrate.migrated_tables(spark, legacy)
    words = {r["document_id"]: r["keywords"] for r in new["document_ai_metadata"].collect()}
    assert words == {"a": ["x", "y"], "b": None, "c": [], "d": []}
    assert "embedding" in new["document_content"].columns and new["chunks"].count() == 0
    again = migrate.migration_plan(spark, new)
    assert {r["action"] for r in again.collect()} == {"skip"} and not migrate.is_blocked(again)


def test_migration_is_blocked_by_duplicates(spark):
    tables = {
        "document_content": spark.createDataFrame([("a", "t"), ("a", "u")], "document_id string, raw_text string"),
        "document_ai_metadata": spark.createDataFrame([("a", ["x"])], "document_id string, keywords array<string>"),
    }
    plan = migrate.migration_plan(spark, tables)
    assert migrate.is_blocked(plan) and plan.where("step = 1").first()["detail"] == "a occurs 2 times"
