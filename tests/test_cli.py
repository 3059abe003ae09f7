import json

from lorekeep.cli import main


def run(spark, capsys, root, *args):
    code = main(["--root", str(root), "--embed-dim", "8", *args], spark)
    return code, capsys.readouterr().out


def test_commands(spark, capsys, tmp_path):
    root, folder = tmp_path / "kb", tmp_path / "in"
    folder.mkdir()
    (folder / "pump.md").write_text("# Pump\nInstall the red pump.")
    (folder / "rice.txt").write_text("Cook the rice.")
    assert run(spark, capsys, root, "init")[0] == 0
    _, out = run(spark, capsys, root, "batch-ingest", str(folder))
    assert json.loads(out)["files"] == 2
    _, out = run(spark, capsys, root, "status", "--total", "4")
    assert json.loads(out)["percent"] == 50
    assert run(spark, capsys, root, "reindex")[0] == 0
    _, out = run(spark, capsys, root, "search", "red pump", "--mode", "fts", "--limit", "1")
    assert out.startswith("1. pump.md - Pump (score ") and "Install the red pump" in out
    assert run(spark, capsys, root, "search", "zzz", "--mode", "fts")[1] == "No results found.\n"
    _, out = run(spark, capsys, root, "ask", "red pump")
    assert out.startswith('data: {"sources": ["pump.md - Pump"') and out.endswith("data: [DONE]\n\n")
    _, out = run(spark, capsys, root, "ask", "red pump", "--passages", "match")
    assert "Install the red pump" in out
    assert run(spark, capsys, root, "rechunk", "--files", str(folder))[0] == 0
    _, out = run(spark, capsys, root, "search", "red pump", "--mode", "fts", "--limit", "1")
    assert out.startswith("1. pump.md - Pump (score ")  # sections come from the file, not from the stored text
    _, out = run(spark, capsys, root, "embed", "--rebuild", "--chunks-only")
    assert out.strip() == 'chunks {"embedded": 2, "failed": 0}'


def test_migrate_command(spark, capsys, tmp_path):
    source = tmp_path / "old"
    assert run(spark, capsys, tmp_path / "kb", "migrate", "--source", str(source))[0] == 1
    spark.createDataFrame([("a", "f", "/f", "c")], "id string, file_name string, file_path string, category string").write.parquet(str(source / "documents"))
    spark.createDataFrame([("a", "text")], "document_id string, raw_text string").write.parquet(str(source / "document_content"))
    spark.createDataFrame([("a", '["k"]')], "document_id string, keywords string").write.parquet(str(source / "document_ai_metadata"))
    code, out = run(spark, capsys, tmp_path / "kb", "migrate", "--source", str(source))
    assert code == 0 and out.count("change") == 3 and not (tmp_path / "kb").exists()
    assert run(spark, capsys, tmp_path / "kb", "migrate", "--source", str(source), "--apply")[0] == 0
    from lorekeep import KnowledgeBase

    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    assert kb.metadata.first()["keywords"] == ["k"] and kb.chunks.count() == 0


def test_vision_reindex_resumes(spark, capsys, tmp_path, monkeypatch):
    from lorekeep import cli
    from lorekeep.session import KnowledgeBase

    root, folder = tmp_path / "kb", tmp_path / "in"
    folder.mkdir()
    for name in "abc":
        (folder / f"{name}.txt").write_text(f"text {name}")
    run(spark, capsys, root, "batch-ingest", str(folder))
    monkeypatch.setattr(cli, "VISION_SLICE", 2)
    run(spark, capsys, root, "reindex-vision", "--limit", "1", "--category", "Seen")
    kb = KnowledgeBase(spark, str(root))
    seen = lambda: sorted(r["file_name"] for r in kb.documents.where("category = 'Seen'").collect())
    assert seen() == ["a.txt"] and kb.documents.count() == 3
    run(spark, capsys, root, "reindex-vision", "--category", "Seen")
    assert seen() == ["a.txt", "b.txt", "c.txt"] and kb.documents.count() == 3
