"""Passages that match a question, and analyses with failed parts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lorekeep.functions.tokens import Tokenizer
from lorekeep.operators import assembly as A
from lorekeep.plans.ingest import analyze


def _plain(text, query, size):
    words = lambda t: {w for w in re.split("[^a-z]+", (t or "").lower()) if w}
    text, half = text or "", size // 2
    windows = [text[i : i + size] for i in range(0, max(1, len(text) - half), half)]
    return max(windows, key=lambda w: len(words(query) & words(w)))


def test_best_window_against_a_plain_search(spark):
    rng = random.Random(4)
    vocabulary = ["red", "pump", "blue", "valve", "tea", "\U0001f600", "x" * 9, "\n", "Pump,red"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(120)] + [None, "", "a", "ab" * 4, "abcdefgh" * 2]
    queries = ["red pump", "Valve?", None, "", "tea blue red", "unknown"]
    rows = [(t, q) for t in texts for q in queries]
    df = spark.createDataFrame(rows, "text string, query string").repartition(4)
    for size in (8, 30):
        found = df.select("text", "query", A.best_window(F.col("text"), F.col("query"), size).alias("w")).collect()
        assert len(found) == len(rows)
        assert all(r["w"] == _plain(r["text"], r["query"], size) for r in found)
    with pytest.raises(ValueError):
        A.best_window(F.col("text"), F.col("query"), 7)


def test_a_stemming_tokenizer_is_used_without_its_stemmer(spark):
    df = spark.createDataFrame([("the cat " * 10 + "pumps here", "the pumps")], "text string, query string")
    window = df.select(A.best_window(F.col("text"), F.col("query"), 20, Tokenizer.english())).first()[0]
    assert "pumps" in window


def test_context_holds_the_match(spark):
    long = "filler words " * 400 + "the red pump leaks here " + "more filler " * 400
    hits = spark.createDataFrame([(1, 0, "a.txt", long), (1, 1, "b.txt", None), (2, 0, "a.txt", long)], "query_id long, rank int, file_name string, raw_text string")
    queries = spark.createDataFrame([(1, "where does the red pump leak?"), (3, "no hits")], "query_id long, query string")
    got = {r["query_id"]: r for r in A.document_context(A.with_passages(hits, queries, A.DOCUMENT_CHARS)).collect()}
    assert "red pump leaks" in got[1]["context"] and got[1]["sources"] == ["a.txt", "b.txt"]
    assert got[2]["context"] == "--- Document : a.txt ---\n" + long[:2000]  # a hit without a question shows its head
    assert set(got) == {1, 2}


def test_failed_parts_are_counted_in_the_summary(spark):
    def model(text):
        return "no json" if "bad" in text else '{"summary": "fine", "keywords": ["k"]}'

    whole = "good " * 1200
    rows = spark.createDataFrame([("a", whole + "bad" + " ok" * 3000), ("b", whole * 2), ("c", "bad"), ("d", None)], "document_id string, raw_text string")
    got = {r["document_id"]: r for r in analyze(rows, model).collect()}
    assert re.fullmatch(r"fine fine \[1 of 3 parts without an analysis\]", got["a"]["summary"])
    assert got["b"]["summary"] == "fine fine" and got["d"]["summary"] == "fine"
    assert got["c"]["keywords"] == ["error", "fallback"]
