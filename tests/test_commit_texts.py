"""The index that follows commits: texts are not sent across the network to find those that change."""

from checks import retrieval
from lorekeep import KnowledgeBase


def test_changed_texts_are_found_without_a_shuffle(spark, tmp_path, monkeypatch):
    docs = [(i, f"word{chr(97 + i)} pump " * (i + 1), "en" if i % 2 else None, "web") for i in range(12)]
    labels = [(0, 0, 0), (0, 0, 0), (3, 0, 0), (5, 1, 1), (7, 1, 0), (None, 0, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "pump worda"), (2, "web")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, [0.5])], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    plans, changed = [], []
    plain = KnowledgeBase.commit

    def commit(self, upserts=None, **more):
        for df in (upserts or {}).values():
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            changed.extend(sorted(r.document_id for r in df.collect()))
        return plain(self, upserts, **more)

    monkeypatch.setattr(KnowledgeBase, "commit", commit)
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        hits = retrieval.bm25_after_commits(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set(name, before)
    assert changed == ["0", "3"]
    assert len(plans) == 1 and "SortMergeJoin" not in plans[0] and "BroadcastHashJoin" in plans[0]
    found = {q: {r.document_id for r in hits if r.query_id == q} for q in (1, 2)}
    assert found == {1: {str(i) for i in range(12)} - {"5"}, 2: {"0", "3"}}
