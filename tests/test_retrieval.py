import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from lorekeep.functions.tokens import Tokenizer
from lorekeep.operators import common, fusion, lexical, nearest
from lorekeep.operators.fusion import FusionRules
from lorekeep.plans.search import Corpus, hybrid_search, hybrid_search_chunks, search

VECTOR = "array<float>"


def hits(spark, rows, score=1.0):
    return spark.createDataFrame([(1, i, score, r) for i, r in rows], "query_id long, id string, score double, rank int")


def fused(spark, fts, vec):
    out = fusion.fuse(hits(spark, fts), hits(spark, vec))
    return {r["id"]: r for r in out.collect()}


def test_worked_rrf_values(spark):
    got = fused(
        spark,
        [("both", 0), ("second", 1), ("only_fts", 2)],
        [("both", 0), ("x1", 1), ("second", 2)] + [(f"v{n}", n) for n in range(3, 8)],
    )
    assert got["both"]["score"] == pytest.approx(4.5 / 61) and got["both"]["source"] == "both"
    assert got["second"]["score"] == pytest.approx(2 / 62 + 1.5 / 63)
    assert got["only_fts"]["score"] == pytest.approx(1 / 63) and got["only_fts"]["source"] == "fts"
    assert got["x1"]["score"] == pytest.approx(1.5 / 62) and got["x1"]["source"] == "vector"
    outside = fused(spark, [("late", 0)], [(f"v{n}", n) for n in range(8)] + [("late", 8)])
    assert outside["late"]["score"] == pytest.approx(1 / 61 + 1.5 / 69)


def test_rrf_matches_brute_force_and_degrades(spark):
    rng = random.Random(3)
    for _ in range(5):
        fts, vec = (rng.sample([f"d{i:02d}" for i in range(30)], 20) for _ in range(2))
        got = fused(spark, [(i, n) for n, i in enumerate(fts)], [(i, n) for n, i in enumerate(vec)])
        want = brute.rrf(fts, vec)
        assert {k: r["score"] for k, r in got.items()} == pytest.approx(want)
    only = fused(spark, [("a", 0), ("b", 1)], [])
    assert [only[k]["score"] for k in "ab"] == pytest.approx([1 / 61, 1 / 62])


def test_equal_scores_keep_lexical_order(spark):
    rules = FusionRules(vector_weight=1.0)
    out = fusion.fuse(hits(spark, [("z", 0)]), hits(spark, [("a", 0)]), rules)
    assert [r["id"] for r in fusion.best(out, 2).orderBy("rank").collect()] == ["z", "a"]


def test_diversify_is_the_greedy_walk(spark):
    docs = ["A", "A", "A", "B", "A", "B", None, "C"]
    rows = [(1, f"c{n}", d, 1.0 - n / 10, "fts", n, None) for n, d in enumerate(docs)]
    df = spark.createDataFrame(
        rows, "query_id long, id string, document_id string, score double, source string, fts_rank int, vec_rank int"
    )
    got = fusion.diversify(df, 2, 4).orderBy("rank")
    assert [(r["id"], r["rank"]) for r in got.collect()] == [("c0", 0), ("c1", 1), ("c3", 2), ("c5", 3)]


def bm25_brute(docs, query):
    toks = {i: t.lower().split() for i, t in docs.items()}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    scores = {}
    for term in set(query.lower().split()):
        df = sum(term in t for t in toks.values())
        for i, t in toks.items():
            tf = t.count(term)
            if tf:
                idf = math.log10((n - df + 0.5) / (df + 0.5) + 1)
                scores[i] = scores.get(i, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg))
    return scores


DOCS = {f"d{n}": t for n, t in enumerate(["red fox runs", "red red fox", "blue sky", "", "fox fox sky blue red"])}


def test_bm25_against_brute_force(spark, tmp_path):
    df = spark.createDataFrame(list(DOCS.items()), "id string, body string")
    queries = spark.createDataFrame([(1, "red fox fox"), (2, "sky"), (3, "nothing here")], "query_id long, query string")
    derived = lexical.LexicalIndex.of(df, ["id"], "body")
    derived.save(str(tmp_path / "index"))
    stored = lexical.LexicalIndex.load(spark, str(tmp_path / "index"), ["id"], Tokenizer())
    for index in (derived, stored):
        got = {}
        for r in lexical.bm25_scores(index, queries).collect():
            got.setdefault(r["query_id"], {})[r["id"]] = r["score"]
        assert set(got) == {1, 2}
        for q, text in ((1, "red fox fox"), (2, "sky")):
            assert got[q] == pytest.approx(bm25_brute(DOCS, text), abs=1e-6)
        top = lexical.bm25_search(index, queries, 2).where("query_id = 1").orderBy("rank").collect()
        want = sorted(got[1].items(), key=lambda kv: (-kv[1], kv[0]))[:2]
        assert [(r["id"], r["rank"]) for r in top] == [(want[0][0], 0), (want[1][0], 1)]


def test_unbounded_queries_take_the_salted_join(spark, monkeypatch):
    df = spark.createDataFrame(list(DOCS.items()), "id string, body string")
    queries = spark.createDataFrame([(1, "red fox"), (2, "sky blue")], "query_id long, query string")
    index = lexical.LexicalIndex.of(df, ["id"], "body")
    want = {tuple(r) for r in lexical.bm25_scores(index, queries).collect()}
    monkeypatch.setattr(lexical, "broadcast_if_small", lambda frame: (frame, False))
    salted = lexical.bm25_scores(index, queries)
    assert {tuple(r) for r in salted.collect()} == want and want


def test_knn_is_exact_with_ties_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(300, 8))
    vectors[100:220] = vectors[0]  # a large group of equal vectors
    rows = [(f"v{n:03d}", [float(x) for x in v]) for n, v in enumerate(vectors)] + [("none", None), ("odd", [1.0])]
    df = spark.createDataFrame(rows, f"id string, embedding {VECTOR}").repartition(5)
    queries = [(q, [float(x) for x in vectors[q]]) for q in (0, 7, 250)] + [(9, None)]
    q = spark.createDataFrame(queries, f"query_id long, vector {VECTOR}")
    unit = np.float32(vectors).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for block in (nearest.QUERY_BLOCK, 1):
        monkeypatch.setattr(nearest, "QUERY_BLOCK", block)
        got = {}
        for r in nearest.knn_search(df, ["id"], "embedding", q, 10).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
        assert set(got) == {0, 7, 250}
        for key in got:
            scores = np.round(unit @ unit[key], nearest.SCORE_DIGITS)
            order = sorted(range(300), key=lambda i: (-scores[i], f"v{i:03d}"))[:10]
            assert [i for i, _ in got[key]] == [f"v{i:03d}" for i in order]


def test_cosine_expression(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0])], f"a {VECTOR}, b {VECTOR}")
    assert df.select(nearest.cosine("a", "b")).first()[0] == pytest.approx(2**-0.5)


# ---------------------------------------------------------------- whole search


@pytest.fixture(scope="module")
def corpus(spark):
    texts = {"a": "install the red pump", "b": "install a blue pump", "c": "cook some rice", "e": "rice field"}
    unit = {k: [float(i == n) for i in range(4)] for n, k in enumerate("abce")}
    documents = spark.createDataFrame([(k, f"{k}.txt", f"/d/{k}.txt") for k in "abc"], "id string, file_name string, file_path string")
    content = spark.createDataFrame([(k, texts[k], unit[k]) for k in "abce"], f"document_id string, raw_text string, embedding {VECTOR}")
    metadata = spark.createDataFrame([("a", "about a")], "document_id string, summary string")
    rows = [(f"{k}{n}", k, n, f"{texts[k]} {n}", texts[k] if n else "", "Table" if n else "NarrativeText", n + 1, "S", unit[k])
            for k in "abc" for n in range(4)]
    chunks = spark.createDataFrame(
        rows, f"id string, document_id string, chunk_index int, text string, parent_text string, element_type string, page_number int, section string, embedding {VECTOR}"
    )
    return Corpus(documents, content, metadata, chunks)


def ask(spark, text, vector=None):
    return spark.createDataFrame([(0, text, vector)], f"query_id long, query string, vector {VECTOR}")


def test_document_search_modes(spark, corpus):
    q = ask(spark, "install pump", [1.0, 0.0, 0.0, 0.0])
    rows = hybrid_search(corpus, q, k=2).orderBy("rank").collect()
    assert [r["document_id"] for r in rows] == ["a", "b"]
    assert rows[0]["source"] == "both" and rows[0]["summary"] == "about a" and rows[1]["summary"] is None
    assert rows[0]["score"] == pytest.approx(4.5 / 61)
    fts = hybrid_search(corpus, ask(spark, "install pump"), mode="fts").collect()
    assert {r["document_id"] for r in fts} == {"a", "b"} and {r["source"] for r in fts} == {"fts"}
    vec = hybrid_search(corpus, q, k=1, mode="vector").collect()
    assert [(r["document_id"], r["source"]) for r in vec] == [("a", "vector")]
    assert vec[0]["score"] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        hybrid_search(corpus, q, mode="other")


def test_without_query_vector_hybrid_is_lexical(spark, corpus):
    rows = hybrid_search(corpus, ask(spark, "install pump"), k=3).collect()
    assert {r["source"] for r in rows} == {"fts"} and max(r["score"] for r in rows) == pytest.approx(1 / 61)


def test_ids_without_document_row_vanish_after_the_cut(spark, corpus):
    rows = hybrid_search(corpus, ask(spark, "field rice"), k=1, mode="fts").collect()
    assert rows == []  # the best hit has no stored document


def test_chunk_search(spark, corpus):
    q = ask(spark, "install pump", [1.0, 0.0, 0.0, 0.0])
    rows = hybrid_search_chunks(corpus, q, k=5).orderBy("rank").collect()
    assert len(rows) == 5 and [r["rank"] for r in rows] == list(range(5))
    per_document = {k: sum(r["document_id"] == k for r in rows) for k in "abc"}
    assert max(per_document.values()) <= 2 and per_document["a"] == 2
    first = {r["chunk_id"]: r for r in rows}["a0"]
    assert first["text"] == first["search_match"] == "install the red pump 0"  # empty parent
    promoted = [r for r in rows if r["chunk_index"] > 0]
    assert all(r["text"] == r["search_match"][:-2] for r in promoted)
    assert {"page_number", "section", "element_type", "file_name", "file_path"} <= set(rows[0].asDict())


def test_fallback_is_per_query(spark, corpus):
    q = spark.createDataFrame([(1, "install"), (2, "field"), (3, "zzz")], "query_id long, query string")
    q = q.withColumn("vector", F.lit(None).cast(VECTOR))
    names = corpus.documents.unionByName(spark.createDataFrame([("e", "e.txt", "/d/e.txt")], corpus.documents.schema))
    full = Corpus(names, corpus.content, corpus.metadata, corpus.chunks)
    rows = search(full, q, k=3, mode="fts").collect()
    assert {(r["query_id"], r["level"]) for r in rows} == {(1, "chunk"), (2, "document")}


# ----------------------------------------------------------------------- plans


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_cut_before_the_exchange(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
    plan = plan_of(common.top_per_group(df, ["g"], [F.asc("id")], 2))
    assert plan.count("WindowGroupLimit") == 2


def test_search_plan_reads_only_needed_columns(spark, tmp_path, corpus):
    corpus.content.write.parquet(str(tmp_path / "content"))
    stored = spark.read.parquet(str(tmp_path / "content"))
    index = lexical.LexicalIndex.of(stored, ["document_id"], "raw_text")
    plan = plan_of(lexical.bm25_search(index, ask(spark, "install"), 5))
    assert "embedding" not in plan
    vectors = nearest.knn_search(stored, ["document_id"], "embedding", ask(spark, "x", [1.0, 0.0, 0.0, 0.0]), 5)
    plan = plan_of(vectors)
    assert "raw_text" not in plan and "IsNotNull(embedding)" in plan
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_stored_index_prunes_by_term(spark, tmp_path):
    df = spark.createDataFrame(list(DOCS.items()), "id string, body string")
    lexical.LexicalIndex.of(df, ["id"], "body").save(str(tmp_path / "i"))
    stored = lexical.LexicalIndex.load(spark, str(tmp_path / "i"), ["id"], Tokenizer())
    q = spark.createDataFrame([(1, "red")], "query_id long, query string")
    plan = plan_of(lexical.bm25_scores(stored, q))
    assert "PartitionFilters: [" in plan and "prefix" in plan and "EqualTo(term,red)" in plan


def test_hot_keys_are_joined_apart(spark):
    left = spark.createDataFrame([("hot", n) for n in range(50)] + [("a", 1), ("b", 2), (None, 3)], "k string, n int")
    right = spark.createDataFrame([("hot", "H"), ("a", "A")], "k string, v string")
    got = common.join_with_hot_keys(left, right, "k", "left", hot_rows=10)
    want = left.join(right, "k", "left")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 53


def test_literal_lists_are_quoted(spark):
    rows = ["plain", "it's", "back\\slash", "\\'", 'dq"', "é\n"]
    df = spark.createDataFrame([(r,) for r in rows + ["other"]], "id string")
    assert [r[0] for r in df.where(common.is_one_of("id", rows)).collect()] == rows
    assert df.where(common.is_one_of("id", [])).count() == 0


def test_stored_index_sums_without_a_second_exchange(spark, tmp_path):
    df = spark.createDataFrame(list(DOCS.items()), "id string, body string")
    lexical.LexicalIndex.of(df, ["id"], "body").save(str(tmp_path / "i"))
    stored = lexical.LexicalIndex.load(spark, str(tmp_path / "i"), ["id"], Tokenizer())
    q = spark.createDataFrame([(1, "red"), (2, "fox")], "query_id long, query string")
    lines = plan_of(lexical.bm25_scores(stored, q)).splitlines()
    postings_side = [line for line in lines if "Exchange hashpartitioning(id" in line]
    assert len(postings_side) == 1 and "REPARTITION_BY_COL" in postings_side[0]
    assert not any("Exchange hashpartitioning(query_id" in line for line in lines)


def test_extraction_and_chunking_do_not_shuffle(spark, tmp_path):
    from lorekeep.functions.chunks import chunk_elements
    from lorekeep.functions.elements import text_elements

    spark.createDataFrame([("a", "x. y")], "document_id string, text string").write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    plan = plan_of(common.unnest(rows, ["document_id"], chunk_elements(text_elements(F.col("text")))))
    assert "Exchange" not in plan and "Python" not in plan and plan.count("aggregate(") <= 3
