"""Sharding, token counts, unigram pieces and packing."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from lorekeep.llm import packing, sentencepiece, sharding, tokencounts
from tests.llm.conftest import LONG, TEXTS, prose


def slow_jump(key: int, shards: int) -> int:
    key, b, j = key % 2**64, -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_is_the_published_one_and_moves_only_to_the_new_shard():
    keys = np.array([*range(-50, 2000), 2**62, -(2**63)])
    for shards in (1, 2, 7, 24):
        now, grown = sharding.jump(keys, shards)
        assert now.tolist() == [slow_jump(int(k), shards) for k in keys]
        assert grown.tolist() == [slow_jump(int(k), shards + 1) for k in keys]
        assert set(grown[grown != now]) <= {shards}


def test_slots_are_gapless_whatever_repeats(spark, odd_documents, no_documents):
    many = spark.range(3000).selectExpr("id % 1000 AS doc_id", "id AS shard", "'a' AS text").unionByName(
        spark.range(2000).selectExpr("cast(null AS long) AS doc_id", "id AS shard", "'b' AS text")
    )
    rows = sharding.assign_shards(many, 24, "doc_id", ("text",)).collect()
    assert len(rows) == 5000
    by = {}
    for row in rows:
        by.setdefault(row.shard, []).append(row.slot)
        assert row.shard == slow_jump(row.doc_id or 0, 24)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert Counter(r.doc_id for r in sharding.assign_shards(odd_documents, 5).collect()) == Counter(r.doc_id for r in odd_documents.collect())
    assert sharding.assign_shards(no_documents, 5).collect() == []
    names = {r.text: r.shard for r in sharding.assign_shards(odd_documents, 5, "text").collect()}
    assert len(names) == len(set(TEXTS)) + 2 and names[None] == slow_jump(0, 5)


@pytest.fixture(scope="module")
def strange():
    r = random.Random(3)
    points = [*range(0x20, 0x3000, 7), *range(0xA000, 0x10FFFF, 1999), 0x88F, 0x558, 0x1C, 0x85, 0xA0, 0x3000, 0x200B, 0x180E, 0x3A3, 0x130]
    points = [c for c in points if not 0xD800 <= c <= 0xDFFF]
    out = ["a" + chr(c) + "b 1" + chr(c) + "2 !" + chr(c) + "? " + chr(c) + " x" for c in points]
    alphabet = "ab 'sSΣσİ́\t\n\r  12.,!<|>é endoftext"
    out += ["".join(r.choices(alphabet, k=r.randint(0, 30))) for _ in range(1500)]
    return out + ["don't we'll  \n\n x's", "a<|endoftext|>b <|endoftext|><|endoftext", "ends \n ", LONG + "  \n" + LONG]


def test_token_counts_are_the_library_s(strange, vocabulary):
    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for frequent in ({}, {" x": 1, "a": 1}):
        got = tokencounts.Counts(path, frequent).of([*strange, None, ""])
        assert got == [len(library.encode(t, add_special_tokens=False).ids) for t in strange] + [0, 0]


def test_token_counts_of_odd_documents(odd_documents, no_documents, vocabulary, monkeypatch):
    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = tokencounts.count_tokens(odd_documents, path, limit=2).collect()
    assert len(rows) == odd_documents.count()
    texts = [(r.doc_id, r.text or "") for r in odd_documents.collect()]
    want = Counter((d, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 2) for d, t in texts)
    assert Counter(map(tuple, rows)) == want
    assert tokencounts.count_tokens(no_documents, path).collect() == []
    assert Counter(map(tuple, tokencounts.count_tokens(odd_documents, path, limit=2, sample_rows=1, table_rows=3).collect())) == want
    monkeypatch.setattr(tokencounts, "CACHE_ROWS", 3)
    assert tokencounts.Counts(path, {}).of([t for _, t in texts]) == [len(library.encode(t, add_special_tokens=False).ids) for _, t in texts]


@pytest.fixture(scope="module")
def unigram(vocabulary):
    return sentencepiece.Unigram(sentencepiece.Vocabulary.read(vocabulary("piece_bpe_32k.model")))


def slow_best(text: str, pieces: dict[str, tuple[int, float]], unknown: float) -> float:
    best = [0.0] + [float("-inf")] * len(text)
    for i in range(len(text)):
        for j in range(i + 1, min(len(text), i + 20) + 1):
            if text[i:j] in pieces:
                best[j] = max(best[j], best[i] + pieces[text[i:j]][1])
        if text[i] not in pieces:
            best[i + 1] = max(best[i + 1], best[i] + unknown)
    return best[-1]


def test_segmentation_has_the_highest_score(unigram, vocabulary, strange):
    v = sentencepiece.Vocabulary.read(vocabulary("piece_bpe_32k.model"))
    pieces = {v.pieces[i]: (i, v.scores[i]) for i in range(len(v.pieces)) if v.kinds[i] == 1}
    r = random.Random(5)
    texts = [*strange[:3000:5], *(prose(r, 6) for _ in range(50)), "thestion, theatiin the"]
    for text in texts:
        ids = unigram.encode(text)
        assert unigram.decode(ids) == text
        marked = sentencepiece.MARK + text.replace(" ", sentencepiece.MARK) if text else ""
        score, at = 0.0, 0
        data = marked.encode()
        k = 0
        while k < len(ids):
            if unigram.is_byte[ids[k]]:
                width = sentencepiece._width(data[at])
                assert [int(x) for x in unigram.byte_ids[list(data[at : at + width])]] == ids[k : k + width].tolist()
                score, at, k = score + unigram.unknown, at + width, k + width
            else:
                piece = v.pieces[ids[k]].encode()
                assert data[at : at + len(piece)] == piece
                score, at, k = score + v.scores[ids[k]], at + len(piece), k + 1
        assert at == len(data)
        assert score == pytest.approx(slow_best(marked, pieces, unigram.unknown), rel=1e-12)


def test_the_library_finds_no_better_segmentation(unigram, vocabulary):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece as library

    model = pb.ModelProto()
    with open(vocabulary("piece_bpe_32k.model"), "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1
    theirs = library.SentencePieceProcessor(model_proto=model.SerializeToString())
    words = ["hello", "Segmentierung", "thereaou", "l'épreuve", "12345", "worthless,", "мир"]
    for word in words:
        ours, other = unigram.encode(word), theirs.encode(word)
        assert unigram.scores[ours].sum() >= unigram.scores[other].sum()
        assert theirs.decode(ours.tolist()) == word


def test_batches_and_single_parts_agree(unigram):
    parts = [p for t in TEXTS if t for p in sentencepiece._PART.findall(sentencepiece.MARK + t.replace(" ", sentencepiece.MARK))]
    parts = sorted({p.encode() for p in parts if len(p.encode()) <= sentencepiece.WIDE}, key=len)
    assert [unigram.segmented(p).astype("<u4").tobytes() for p in parts] == unigram.together(parts)
    one = "x" * 5000 + "é" * 3000
    assert unigram.decode(unigram.encode(one)) == one


def test_pieces_of_odd_documents(odd_documents, no_documents, vocabulary):
    path = vocabulary("piece_bpe_32k.model")
    rows = sentencepiece.encode_and_decode(odd_documents, path, ids=True).collect()
    assert Counter((r.doc_id, r.decoded) for r in rows) == Counter((r.doc_id, r.text or "") for r in odd_documents.collect())
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in rows)
    assert {r.n_pieces for r in rows if r.decoded == ""} == {0}
    assert sentencepiece.encode_and_decode(no_documents, path).collect() == []


def check_packing(rows, documents, path, length):
    library = Tokenizer.from_file(path)
    want = Counter()
    for d, t in documents:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want[d, len(ids)] += 1
    whole = Counter()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
        whole[r.doc_id, r.doc_tokens] += r.length
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    assert whole == Counter({k: k[1] * n for k, n in want.items()})
    assert sorted(by) == list(range(len(by)))
    for i, some in by.items():
        some.sort(key=lambda r: r.offset)
        assert [r.offset for r in some] == [sum(x.length for x in some[:k]) for k in range(len(some))]
        assert sum(r.length for r in some) == length or i == len(by) - 1


def test_packing(odd_documents, no_documents, spark, vocabulary):
    path = vocabulary("word_bpe_49k.json")
    documents = [(r.doc_id, r.text) for r in odd_documents.collect()]
    check_packing(packing.pack(odd_documents, path, length=64, ids=True).collect(), documents, path, 64)
    parted = odd_documents.repartition(7)
    check_packing(packing.pack(parted, path, length=4096, ids=True).collect(), documents, path, 4096)
    assert packing.pack(no_documents, path).collect() == []
    ids = packing.pack(spark.createDataFrame([(1, "Hello, World")], "doc_id long, text string"), path, ids=True).first().ids
    assert ids == [*Tokenizer.from_file(path).encode("Hello, World", add_special_tokens=False).ids, 2]


def test_packed_ids_are_the_library_s(strange, vocabulary, monkeypatch):
    path = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    monkeypatch.setattr(packing, "CACHE_BYTES", 5000)
    got = packing.Encoder(path, 2).of(strange)
    for text, held in zip(strange, got, strict=True):
        assert np.frombuffer(held, "<u4").tolist() == [*library.encode(text, add_special_tokens=False).ids, 2], text[:40]
