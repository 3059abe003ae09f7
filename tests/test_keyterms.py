"""Count-min sketch and tf-idf keywords against plain counts."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lorekeep.operators.keyterms import DocumentFrequencies, key_counts
from lorekeep.plans.ingest import analyze


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(600)]
    texts = [" ".join(rng.choices(words, [1 / (n + 1) for n in range(600)], k=rng.randint(1, 80))) for _ in range(300)]
    return [*texts, None, "", "abc", texts[0], texts[0], "hotword " * 500]


def _frame(spark, corpus):
    return spark.createDataFrame([(str(n), t) for n, t in enumerate(corpus)], "document_id string, raw_text string").repartition(5)


def _counts(text):
    return Counter(w for w in (text or "").split() if len(w) >= 4)


def test_estimates_are_never_below_and_rarely_above(spark, corpus):
    df = _frame(spark, corpus)
    true = Counter(w for t in corpus for w in _counts(t))
    for width, depth in ((64, 4), (1024, 2), (1 << 16, 4)):
        sketch = DocumentFrequencies.of(df, "raw_text", width=width, depth=depth)
        assert sketch.documents == len(corpus) and sketch.pairs == sum(true.values())
        terms = spark.createDataFrame([(w,) for w in true], "term string").withColumn("n", sketch.estimate(F.col("term")))
        got = {r["term"]: r["n"] for r in terms.collect()}
        assert all(got[w] >= n for w, n in true.items())
        above = sum(got[w] > n + sketch.error_bound() for w, n in true.items())
        assert above <= max(1, 2 * math.exp(-depth) * len(true))
    assert got == dict(true)


def test_keywords_equal_a_plain_count(spark, corpus):
    df = _frame(spark, corpus)
    sketch = DocumentFrequencies.of(df, "raw_text")
    df_of = Counter(w for t in corpus for w in _counts(t))
    found = {r[0]: r[1] for r in df.select("document_id", sketch.keywords(F.col("raw_text"))).collect()}
    for n, text in enumerate(corpus):
        score = {w: round(c * math.log((1 + len(corpus)) / (1 + df_of[w])), 6) for w, c in _counts(text).items()}
        assert found[str(n)] == sorted(score, key=lambda w: (-score[w], w))[:5]


def test_analysis_with_frequencies(spark, corpus):
    df = _frame(spark, corpus)
    rows = {r["document_id"]: r for r in analyze(df, frequencies=DocumentFrequencies.of(df, "raw_text")).collect()}
    assert len(rows) == len(corpus)
    assert rows[str(len(corpus) - 1)]["keywords"] == ["hotword"]
    assert rows["300"]["keywords"] == ["error", "fallback"] == rows["301"]["keywords"]


def test_empty_corpus_and_unknown_terms(spark):
    empty = spark.createDataFrame([], "raw_text string")
    sketch = DocumentFrequencies.of(empty, "raw_text")
    assert (sketch.documents, sketch.pairs) == (0, 0)
    row = spark.range(1).select(sketch.keywords(F.lit("beta alpha beta"))).first()
    assert row[0] == ["alpha", "beta"]
    with pytest.raises(ValueError):
        DocumentFrequencies.of(empty, "raw_text", depth=5)


def test_nothing_but_cells_is_shuffled(spark, corpus):
    df = _frame(spark, corpus).coalesce(1)
    plan = df.select(DocumentFrequencies.of(df, "raw_text").keywords(F.col("raw_text")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the repartition of the fixture
    counted = df.select(F.size(key_counts(F.col("raw_text"))).alias("n")).agg(F.sum("n")).first()[0]
    assert counted == sum(len(_counts(t)) for t in corpus)
