"""Searches that stop early give what a full search gives."""

import numpy as np
from pyspark.sql import functions as F

from lorekeep.operators.cells import Cells
from lorekeep.operators.fusion import FusionRules
from lorekeep.operators.nearest import knn_search
from lorekeep.plans import search as P

VECTORS = "id string, embedding array<float>"


def vectors(r, n):
    centres = r.normal(size=(12, 6)) * 3
    rows = [(f"v{i}", (centres[i % 12] + r.normal(size=6) * 0.3).tolist()) for i in range(n)]
    rows += [(f"same{i}", [1.0] * 6) for i in range(40)]  # more equal vectors than any pool
    return rows + [("zero", [0.0] * 6), ("none", None), ("short", [1.0, 2.0])]


def test_cells_find_what_a_full_scan_finds(spark, tmp_path):
    r = np.random.default_rng(3)
    df = spark.createDataFrame(vectors(r, 600), VECTORS).repartition(3)
    q = [(i, r.normal(size=6).tolist()) for i in range(8)] + [(8, [1.0] * 6), (9, [0.0] * 6), (10, None), (11, [1.0])]
    queries = spark.createDataFrame(q, "query_id long, vector array<float>")
    cells = Cells.build(df, ["id"], "embedding", 6, str(tmp_path / "cells"))
    fitting = queries.where(F.size("vector") == 6)
    for pool in (1, 10, 700):
        got, share = cells.search(queries, pool)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, knn_search(df, ["id"], "embedding", fitting, pool).select(*got.columns).collect()))
        assert pool > 10 or share["vectors"] < 0.6, share
    nothing = Cells.build(df.limit(0), ["id"], "embedding", 6, str(tmp_path / "nothing"))
    assert nothing.search(queries, 3)[0].collect() == []
    assert cells.search(queries.limit(0), 3)[0].collect() == []


def test_only_queries_short_of_hits_get_longer_lists(spark, monkeypatch):
    body = [(f"long-{n}", "long", "pump pump") for n in range(30)] + [(f"{d}-0", d, "a pump among many other words here") for d in "abc"] + [("e-0", "e", "oven")]
    chunks = spark.createDataFrame([(i, d, 0, t, None, "NarrativeText", None, None, None) for i, d, t in body], "id string, document_id string, chunk_index int, text string, parent_text string, element_type string, page_number int, section string, embedding array<float>")
    names = chunks.select(F.col("document_id").alias("id")).distinct().select("id", F.col("id").alias("file_name"), F.col("id").alias("file_path"))
    texts = names.select(F.col("id").alias("document_id"), F.col("id").alias("raw_text"), F.lit(None).cast("array<float>").alias("embedding"))
    notes = names.select(F.col("id").alias("document_id"), F.lit("s").alias("summary"))
    corpus = P.Corpus(names, texts, notes, chunks)
    queries = spark.createDataFrame([(1, "pump", None), (2, "oven", None), (3, "unknown", None)], "query_id long, query string, vector array<float>")
    asked = []
    plain = P._candidates
    monkeypatch.setattr(P, "_candidates", lambda c, q, m, r, chunks: asked.append((sorted(x.query_id for x in q.collect()), r.pool)) or plain(c, q, m, r, chunks))
    found = lambda **o: sorted((r.query_id, r["rank"], r.document_id) for r in P.hybrid_search_chunks(corpus, queries, k=4, mode="fts", per_document=1, rules=FusionRules(pool=5), **o).collect())
    assert [x[2] for x in found() if x[0] == 1] == ["long", "a", "b", "c"]
    assert asked == [([1, 2, 3], 5), ([1], 20), ([1], 80)]
    assert [x[2] for x in found(widen=False) if x[0] == 1] == ["long"]
