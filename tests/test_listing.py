import hashlib
import os
import time

import pytest

from lorekeep.plans.ingest import KeysRefused, ingest_directory, insert_rows
from lorekeep.sources import listing
from lorekeep.streaming.ingest import watch_all_files

NAMES = ("a.txt", "empty.txt", ".hidden.md", "_deep/_x.txt", "_deep/.more/b.txt", "_Archives/old.txt", "c.bin")


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    for name in NAMES:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("" if name == "empty.txt" else f"text of {name}")
    (root / "no files").mkdir()
    return root


def plain(root):
    return {os.path.join(at, n): os.path.getsize(os.path.join(at, n)) for at, _, names in os.walk(root) for n in names}


@pytest.mark.parametrize("folders", [1, 3, 64])
def test_every_file_is_listed_once(spark, folder, monkeypatch, folders):
    monkeypatch.setattr(listing, "FOLDERS", folders)
    parts = [listing._Folder(*f) for f in listing._folders(str(folder))]
    found = [r for p in parts for b in listing._listed(str(folder), p) for r in b.to_pylist()]
    assert {r["path"]: r["length"] for r in found} == plain(folder) and len(found) == len(NAMES)
    rows = listing.read_all_files(spark, f"file:{folder}").collect()
    assert {r.path: r.length for r in rows} == plain(folder) and len(rows) == len(NAMES)
    assert all(bytes(r.content) == open(r.path, "rb").read() for r in rows)


def test_listing_of_odd_folders(spark, tmp_path):
    assert listing.read_all_files(spark, str(tmp_path)).collect() == []
    with pytest.raises(Exception, match="absent"):
        listing.list_files(spark, str(tmp_path / "absent")).collect()


WANTED = {"a.txt": "ok", "empty.txt": "empty", ".hidden.md": "ok", "_x.txt": "ok", "b.txt": "ok"}


def test_hidden_and_empty_files_are_ingested(kb, folder):
    got = ingest_directory(kb, str(folder)).collect()
    assert {r.path.rsplit("/", 1)[1]: r.status for r in got} == WANTED
    (folder / ".hidden.md").unlink()
    ingest_directory(kb, str(folder))
    assert {r.file_name for r in kb.documents.collect()} == {"a.txt", "_x.txt", "b.txt"}


def test_stream_of_all_files(kb, folder, tmp_path):
    def run():
        query = watch_all_files(kb, str(folder), str(tmp_path / "cp"), settled=0.0)
        query.awaitTermination()
        return sum(p["numInputRows"] for p in query.recentProgress)

    run()
    assert {r.file_name for r in kb.documents.collect()} == {n for n, s in WANTED.items() if s == "ok"}
    time.sleep(0.1)
    (folder / "_later.txt").write_text("came later")
    time.sleep(0.1)
    assert run() == 1
    assert kb.documents.where("file_name = '_later.txt'").first().id == hashlib.sha256(b"came later").hexdigest()


def test_keys_in_use_are_refused(kb, spark):
    def documents(*ids):
        return spark.createDataFrame([(i, f"{i}.txt") for i in ids], "id string, file_name string")

    insert_rows(kb, {"documents": documents("a", "b")})
    for ids, told in ((("c", "b"), r"b \(known\)"), (("c", "c"), r"c \(repeated\)"), (("c", None), "NULL")):
        with pytest.raises(KeysRefused, match=told):
            insert_rows(kb, {"documents": documents(*ids)})
    insert_rows(kb, {"documents": documents("c")})
    assert sorted(r.id for r in kb.documents.collect()) == ["a", "b", "c"]
