"""What tasks of the collocations hold does not grow with the table."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from lorekeep.llm import collocations
from test_corpus import SCHEMA, rows_of, slow_collocations, wordy_documents


def _texts(n):
    draw = random.Random(5)
    return [". ".join(" ".join(draw.choices("abcdefgh", k=20)) for _ in range(30)) for _ in range(n)]


def test_encoded_rows_are_short_and_whole(monkeypatch):
    monkeypatch.setattr(collocations, "ROW_IDS", 500)
    texts = _texts(200)
    known = pa.table({"lang": ["en"] * 6, "phrase": list("abcdef"), "n": [9, 8, 7, 6, 5, 4]})
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * len(texts), "text": texts})
    for whole in (True, False):
        head = collocations.Head.of(known, whole)
        found = pa.Table.from_batches(collocations._encode(SimpleNamespace(value=head))(iter([batch])))
        rows = [np.frombuffer(x, np.int32) for x in found["ids"].to_pylist()]
        assert len(rows) > 200 and max(map(len, rows)) < 500 + 22
        assert all(x[-1] == collocations.BREAK for x in rows[:-1])
        words = collocations.words_of(texts)
        ids = {w: i for i, w in enumerate([b"a", b"b", b"c", b"d", b"e", b"f"])} | {b"\n": collocations.BREAK}
        assert np.concatenate(rows).tolist() == [ids.get(w, collocations.BREAK if whole else collocations.BEYOND) for w in words]
        beyond = [w for x in found["beyond"].to_pylist() for w in x]
        assert beyond == ([] if whole else [w.decode() for w in words if w not in ids])


def test_more_words_make_more_tiles_with_the_same_result(spark, monkeypatch):
    monkeypatch.setattr(collocations, "ROW_IDS", 16)
    monkeypatch.setattr(collocations, "LOOKUP_IDS", 50)
    parts = []
    plain = collocations._count_pairs
    monkeypatch.setattr(collocations, "_count_pairs", lambda head, n, limits: (parts.append(n), plain(head, n, limits))[1])
    rows = wordy_documents(random.Random(9))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    small = collocations.Limits(dense=0, pairs=300, per_tile=50)
    assert rows_of(collocations.collocations(df, limits=small)) == slow_collocations(rows)
    assert min(parts) > 50
