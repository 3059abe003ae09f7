"""Quality rules, near duplicates, fingerprints and toxicity."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from lorekeep.llm import fingerprint, neardup, quality, toxicity
from tests.llm.conftest import LONG, TEXTS, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_statistics(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols if words else 0, len(lines) - len(set(lines)), len(inside)


def test_statistics():
    r = random.Random(1)
    texts = [*TEXTS, "a b c a b c\na b c\n\n \na b c", "a a a a", "#*$%&|<>", "x # y"]
    texts += ["".join(r.choices("ab#\n \t", k=60)) for _ in range(300)]
    for text in texts:
        assert quality.text_statistics(text) == slow_statistics(text), text


def quality_documents(r):
    rows = []
    for i in range(600):
        text = prose(r, r.randint(60, 200))
        if i % 10 == 0:
            text = " ".join(w + "###" for w in text.split())
        rows.append((i, text, "en", "a" if i % 3 else None))
    return [*rows, (600, "too short", "en", "a"), (601, None, "en", "a"), (602, "x y z " * 60, "en", "a"), (603, prose(r, 80), None, "alone"), rows[7]]


def at_share(values, share):
    """The smallest value that at least such a share does not exceed, per column."""
    return np.sort(values, axis=0)[max(int(np.ceil(share * len(values))), 1) - 1]


def slow_distances(x, lengths):
    """Squared distances of all rows from the regularized estimate with the smallest determinant of three starts."""
    low, middle, high = (at_share(x, s) for s in (0.25, 0.5, 0.75))
    words = at_share(lengths, 0.25)
    events = np.array([np.log1p(10 / words), np.log1p(10 / words), 6 / words, 0.5 / np.sqrt(words)])
    spread = np.max([events, (high - middle) / 0.6745, (middle - low) / 0.6745], axis=0)

    def regular(part, factor):
        w = 16 / (len(part) + 16)
        centred = part - part.mean(axis=0)
        mixed = w * np.diag(spread**2) + (1 - w) * factor * (centred.T @ centred) / len(part)
        values, axes = np.linalg.eigh(np.diag(1 / events) @ mixed @ np.diag(1 / events))
        root = np.diag(events) @ axes @ np.diag(np.sqrt(np.maximum(values, 1)))
        return part.mean(axis=0), root @ root.T

    def distances(centre, scatter):
        return np.array([(v - centre) @ np.linalg.solve(scatter, v - centre) for v in x])

    found = []
    for centre, scatter in ((middle, np.diag(np.square([0.25, 0.2, 0.2, 0.1]))), (middle, np.diag(spread**2)), regular(x, 1)):
        size = np.inf
        while True:
            d2 = np.round(distances(centre, scatter), 6)
            new = regular(x[d2 <= at_share(d2, 0.5)], 0.5 / 0.23760)
            if not np.linalg.slogdet(new[1])[1] < size - 1e-6:
                break
            (centre, scatter), size = new, np.linalg.slogdet(new[1])[1]
        found.append((size, centre, scatter))
    _, centre, scatter = min(found, key=lambda f: f[0])
    stretch = np.diag(np.maximum(spread / np.sqrt(np.diag(scatter)), 1))
    return distances(centre, stretch @ scatter @ stretch)


def test_a_text_against_the_correlation_is_far(spark):
    """Statistics with a correlation of 0.97: (2, -2) is an outlier although neither value is; (2, 2) is none."""
    g = np.random.default_rng(7)
    both = g.multivariate_normal([0, 0], [[1, 0.97], [0.97, 1]], 600)
    x = np.column_stack([both, g.normal(size=(600, 2))])
    x = np.vstack([x, [[2, -2, 0, 0], [2, 2, 0, 0]]])
    names = [f"x{i}" for i in range(4)]
    rows = [("a", *map(float, v), 1_000_000) for v in x] + [("b", 1.0, 2.0, 3.0, 4.0, 60)]
    df = spark.createDataFrame(rows, f"g string, {', '.join(n + ' double' for n in names)}, n_words long").repartition(4)
    found = {r.g: r for r in quality.estimates(df).collect()}
    precision = np.zeros((4, 4))
    for k, (i, j) in enumerate((i, j) for i in range(4) for j in range(i, 4)):
        precision[i, j] = precision[j, i] = found["a"].precision[k]
    away = x - np.array(found["a"].centre)
    d2 = np.einsum("ni,ij,nj->n", away, precision, away)
    assert d2[600] > 50 > quality.CUTOFF > d2[601] and np.mean(d2[:600] <= quality.CUTOFF) > 0.995
    assert np.allclose(d2, slow_distances(x, np.full(602, 1_000_000)), rtol=1e-5)
    assert found["b"].centre == [1.0, 2.0, 3.0, 4.0] and set(found) == {"a", "b"}


def test_outliers_against_plain_concentration(spark, no_documents):
    rows = quality_documents(random.Random(2))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {(r.doc_id): r for r in quality.judge(df.repartition(5)).collect()}
    groups = {}
    for d, text, lang, source in rows:
        n, chars, symbols, dup, rep = slow_statistics(text)
        failed = n < 50 or 100 * rep > 50 * n
        assert got[d].base_failed == failed and got[d].n_words == n
        if not failed:
            groups.setdefault((lang, source), []).append((d, [np.log1p(10 * symbols / n), np.log1p(10 * dup / n), rep / n, np.log(chars / n)]))
        else:
            assert not got[d].kept
    lengths = {d: slow_statistics(text)[0] for d, text, *_ in rows}
    for members in groups.values():
        x = np.array([v for _, v in members])
        d2 = slow_distances(x, np.array([lengths[d] for d, _ in members]))
        assert [got[d].kept for d, _ in members] == (d2 <= quality.CUTOFF).tolist()
    assert not got[0].kept and got[1].kept and got[603].kept
    kept = quality.keep_good(df).collect()
    assert Counter(r.doc_id for r in kept) == Counter(d for d, *_ in rows if got[d].kept)
    assert quality.judge(no_documents).collect() == [] and quality.keep_good(no_documents).collect() == []


def test_planted_outliers_in_every_group(spark):
    """Groups without repeats and symbols, with some repeats in every text, and of few texts."""
    r = random.Random(15)
    rows, planted, groups = [], set(), (("en", "plain", 150), ("de", "some", 150), ("fr", "few", 12))
    for lang, source, size in groups:
        texts = []
        for _ in range(size):
            words = prose(r, r.randint(100, 300), 100_000).split()
            if source == "some":
                words += words[: r.randrange(3, 6)]
            texts.append(" ".join(words))
        words = prose(r, 200, 100_000).split()
        lines = [" ".join(words[i : i + 4]) for i in range(0, 200, 4)]
        bad = [
            " ".join(words[:150] + words[:49]),
            "\n".join(x for i, x in enumerate(lines) for x in [x] * (2 if i % 4 == 0 else 1)),
            " ".join(w + "#" if i % 8 == 0 else w for i, w in enumerate(words)),
            " ".join(w[:3] for w in prose(r, 200, 100_000).split()),
        ]
        for k, text in enumerate([*texts, *bad[: 4 if size > 20 else 3]]):
            if k >= size:
                planted.add(len(rows))
            rows.append((len(rows), text, lang, source))
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)).collect()
    assert not any(x.base_failed for x in got)
    assert {x.doc_id for x in got if not x.kept} == planted


def test_quality_of_odd_documents(odd_documents):
    rows = quality.judge(odd_documents).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd_documents.collect())
    kept = quality.keep_good(odd_documents)
    assert kept.columns == odd_documents.columns and {r.doc_id for r in kept.collect()} <= {4}


def edited_texts(r):
    """Bases with copies, copies in other white space, and copies with more and more words changed."""
    texts = []
    for _ in range(30):
        base = prose(r, r.randint(40, 300), 100_000).split()
        texts.append(" ".join(base))
        for share in (0, 0.01, 0.02, 0.03, 0.05, 0.1, 0.3):
            texts.append("  \n".join(w if r.random() >= share else f"new{r.random()}" for w in base))
    return texts


def slow_classes(rows, threshold):
    known = neardup.Words()
    found = [neardup.shingles((t or "").split(), known) for _, t in rows]
    cells = [neardup.cells(x) for x, _ in found]
    frequency = np.bincount(np.concatenate(cells), minlength=1 << neardup.BUCKETS)
    full = sum(len(c) > 0 for c in cells)
    factors = (1 + np.log((1.0 + full) / (1.0 + np.minimum(frequency, full))) / neardup.DAMPING).astype(np.float32)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = found[i], found[j]
            if (not len(a[0]) and not len(b[0])) or (len(a[0]) and len(b[0]) and neardup.similarity(a, b, factors) >= threshold):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {d: min(e for k, (e, _) in enumerate(rows) if root(k) == root(i)) for i, (d, _) in enumerate(rows)}, factors


def test_classes_against_all_pairs(spark, no_documents):
    rows = list(enumerate([*edited_texts(random.Random(4)), "", None, " ", "a b", "b a", "a b", LONG, LONG + " end"]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want, factors = slow_classes(rows, neardup.THRESHOLD)
    assert np.array_equal(neardup.inverse_frequencies(df), factors)
    got = {r.doc_id: r for r in neardup.classes(df).collect()}
    wrong = [d for d in want if got[d].class_id != want[d]]
    assert len(wrong) <= 1
    assert all(r.kept == (r.doc_id == r.class_id) and r.copy_of <= r.doc_id for r in got.values())
    assert Counter(r.doc_id for r in neardup.keep_one(df).collect()) == Counter({r.class_id: 1 for r in got.values()})
    assert neardup.classes(no_documents).collect() == [] and neardup.keep_one(no_documents).collect() == []


def test_samples_agree_as_often_as_texts_are_similar():
    known, draws = neardup.Words(), neardup._draws()
    factors = np.ones(1 << neardup.BUCKETS, np.float32)
    r = random.Random(8)
    agree, similar = [], []
    for _ in range(60):
        base = prose(r, 200, 100_000).split()
        other = [w if r.random() > 0.04 else f"new{r.random()}" for w in base]
        a, b = (neardup.shingles(w, known) for w in (base, other))
        drawn = neardup.samples([a, b], factors, draws)
        agree.append((drawn[0] == drawn[1]).mean())
        similar.append(neardup.similarity(a, b, factors))
    assert abs(np.mean(agree) - np.mean(similar)) < 0.03


def test_large_groups_make_few_pairs(spark, monkeypatch):
    r = random.Random(9)
    base = prose(r, 150, 100_000).split()
    rows = [(i, " ".join([*base[:-1], f"end{i}"])) for i in range(400)]
    made = []
    plain = neardup.candidates
    monkeypatch.setattr(neardup, "candidates", lambda bands: made.append(plain(bands)) or made[-1])
    got = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.class_id for x in got} == {0}
    assert made[0].count() <= 2 * neardup.BANDS * len(rows)


def test_classes_of_odd_documents(odd_documents):
    rows = neardup.classes(odd_documents).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd_documents.collect())
    by = {r.doc_id: r.class_id for r in rows if r.doc_id is not None}
    assert by[0] == by[1] == by[2] == 0 and by[5] == by[6] == 5 and by[4] == 4
    kept = neardup.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([0, 3, 4, 5, 5, 7, 7, 8, 9, None])


def test_documents_without_an_id_stay(spark):
    rows = [(None, "some words of a text that has no id"), (None, "some words of a text that has no id"), (3, "some words of a text that has one"), (None, "some words of a text that has one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in neardup.classes(df).select("doc_id", "class_id").collect()) == Counter([(None, None)] * 2 + [(3, 3), (None, 3)])
    assert neardup.keep_one(df).count() == 4


def slow_fingerprints(rows):
    rows = sorted(rows)
    for i, (d, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        changed = fingerprint.edited(text, following)
        a, b, c = (fingerprint.sketches([t])[0] for t in (text, changed, following))
        yield d, len(text), hashlib.sha256(changed.encode()).hexdigest(), fingerprint.written(a), fingerprint.written(b), fingerprint.likeness(a, b), fingerprint.likeness(a, c)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_fingerprints_across_ranges(spark, parts):
    r = random.Random(11)
    rows = [(i * 3, t or "") for i, t in enumerate([*TEXTS, *(prose(r, r.randint(0, 60)) for _ in range(60))])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(tuple(r) for r in fingerprint.fingerprints(df).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == sorted(slow_fingerprints(rows))


def test_fingerprints_of_odd_documents(spark, odd_documents, no_documents):
    rows = fingerprint.fingerprints(odd_documents).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd_documents.collect())
    assert {r.fingerprint for r in rows if r.n_chars == 0} == {""}
    assert len({r.fingerprint for r in rows if r.doc_id in (5, 6)}) == 1
    assert fingerprint.fingerprints(no_documents).collect() == []
    (alone,) = fingerprint.fingerprints(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).collect()
    assert alone.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and alone.near_next == 1


def test_equal_passages_share_phrases_at_any_offset():
    r = random.Random(12)
    passage = prose(r, 300)
    for lead in ("", "x", "a few words before ", prose(r, 97)):
        names, _ = fingerprint.phrases([passage])
        shifted, _ = fingerprint.phrases([lead + passage + " tail"])
        assert np.isin(names, shifted).mean() > 0.95
    together, owner = fingerprint.phrases([passage, "aaaa" * 50, "", passage])
    assert together[owner == 0].tolist() == together[owner == 3].tolist() == fingerprint.phrases([passage])[0].tolist()
    assert not (owner == 2).any()
    labels = fingerprint._tossed(np.array([5, 4, 5, 7], np.uint64), np.array([True, False, False, False]))
    assert labels.tolist() == [1, 0, 1, 3]


def toxic_documents(r, n):
    out = []
    for i in range(n):
        words = prose(r, r.randint(5, 80), 300).split()
        toxic = i % 4 == 0
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(["nastling", "grumbox", "vilefolk"]) + r.choice(["", "s", "er"]))
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_toxicity_on_held_out_rows(spark, odd_documents, no_documents):
    rows = toxic_documents(random.Random(13), 1200)
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows] + [(5, None), (99999, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    import zlib

    held = [d for d, _, _ in rows if zlib.crc32(str(d).encode()) % 4 == 2]
    assert held == sorted(d for d, r in got.items() if r.held_out)
    right = sum(got[d].predicted == rows[d][2] for d in held)
    assert right / len(held) > 0.98
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    again = toxicity.fit(df, flipped)
    assert np.array_equal(again.weights, model.weights) and again.intercept == model.intercept
    scored = toxicity.score(odd_documents, model).collect()
    assert Counter(r.doc_id for r in scored) == Counter(r.doc_id for r in odd_documents.collect())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored)
    assert toxicity.score(no_documents, model).collect() == []
    clean = toxicity.keep_clean(odd_documents, model)
    assert clean.columns == odd_documents.columns
    assert toxicity.fit(no_documents, labels).scores(["x", None, ""]).max() < 1e-6
    assert toxicity.training_rows(labels, rows=10).count() == 10


def test_scores_do_not_depend_on_neighbours():
    weights = np.random.default_rng(1).normal(size=1 << toxicity.BITS)
    model = toxicity.Model(weights, 0.1)
    texts = [t for t in TEXTS if t != LONG]
    assert np.allclose(model.scores(texts), [model.scores([t])[0] for t in texts])
    owner, features = toxicity.distinct_features(["abcabc"])
    assert len(features) == len(set(features.tolist()))


def test_run_with_many_clusters_against_all_pairs(spark, monkeypatch):
    """One run that holds many clusters, whose members are near to the one before only, dealt in small blocks; and hot components."""
    r = random.Random(14)
    rows = []
    for c in range(12):
        words = prose(r, 120, 100_000).split()
        for k in range(30 if c == 0 else 6):
            rows.append(" ".join(words))
            words = [w if not 8 * k <= i % 120 < 8 * k + 2 else f"new{c}-{k}-{i}" for i, w in enumerate(words)]
    r.shuffle(rows)
    rows = list(enumerate(rows))
    want, factors = slow_classes(rows, neardup.THRESHOLD)
    assert 12 <= len(set(want.values())) < len(rows) / 3
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 8, raising=False)
    monkeypatch.setattr(neardup, "bands_of", lambda drawn: np.full((len(drawn), neardup.BANDS), 5, np.int64))
    got = {x.doc_id: x.class_id for x in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
