"""The stages one after another, each on what the one before kept."""

import random
import zlib

import corpus_pipeline
from lorekeep.llm import neardup, quality, toxicity
from tests.llm.conftest import prose


def documents(r):
    rows = []
    for i in range(240):
        text = prose(r, r.randint(70, 160), 3000)
        if i % 6 == 0:
            text += " grumbox and nastling " + prose(r, 5)
        elif i % 6 == 1:
            text = " ".join(w + "$$$" for w in text.split())
        elif i % 6 == 2:
            text = rows[-2][1].replace(" grumbox and nastling ", " ") if i % 12 == 2 else rows[-12][1] + " end" if i > 12 else text
        rows.append((i, text, "en", "a", len(text), i))
    return [*rows, (240, None, None, None, None, 0), (241, "", "en", "a", 0, 0), (242, "short", "en", "a", 5, 0)]


def test_stages(spark, tmp_path):
    rows = documents(random.Random(1))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept long")
    labels = spark.createDataFrame([(d, int("grumbox" in (t or ""))) for d, t, *_ in rows], "doc_id long, toxic int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["without_toxic", "of_quality", "without_near_copies", "packed"]
    left = docs
    wanted = [
        lambda d: {r.doc_id for r in toxicity.score(d, toxicity.fit(d, labels)).collect() if r.score < toxicity.LIMIT},
        lambda d: {r.doc_id for r in quality.judge(d).collect() if r.kept},
        lambda d: {r.class_id for r in neardup.classes(d).collect()},
    ]
    for (_, stage), want in zip(corpus_pipeline.STAGES, wanted, strict=False):
        kept = stage(spark, left, str(tmp_path))
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(want(left))
        left = kept
    clean = {d for d, t, *_ in rows if d < 240 and d % 6 in (3, 4, 5)}
    assert clean <= {r.doc_id for r in left.collect()}
    assert not any("$$$" in r.text or "grumbox" in r.text for r in left.collect())
    packed = corpus_pipeline.STAGES[3][1](spark, left, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in left.collect()}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    digest = lambda some: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in some)
    assert sum(r.length for r in whole.collect()) == sum(r.length for r in packed)
    assert {d for d, *_ in digest(whole.collect())} == {d for d, *_ in digest(packed)}
    assert corpus_pipeline.ORACLE_SQL is None and zlib.crc32(b"") == 0
