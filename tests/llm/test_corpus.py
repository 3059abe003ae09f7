"""Mixing, divergence of sources and collocations against plain versions."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lorekeep.llm import collocations, divergence, mixing
from tests.llm.conftest import TEXTS, prose

SCHEMA = "doc_id long, text string, lang string, source string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ------------------------------------------------------------------ mixing


def slow_targets(sizes: dict, weights, share, repeats):
    """Share by weight, cap, share the rest again until nothing is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, full = Fraction(share) * sum(sizes.values()), set()
    while True:
        left = budget - sum(repeats * sizes[s] for s in full)
        room = sum(weight[s] for s in names if s not in full)
        target = {s: Fraction(repeats * sizes[s]) if s in full else left * weight[s] / room for s in names}
        above = {s for s in names if s not in full and target[s] >= repeats * sizes[s]}
        if not above:
            return target, budget
        full |= above


def slow_mix(rows, weights=(5, 2, 1), share=1, repeats=3):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    key = lambda d: int(hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()[:15], 16)
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += size(text)
    target, budget = slow_targets(dict(sizes), weights, share, repeats)
    items, taken = [], [0] * len(rows)
    for source in sizes:
        queue = sorted((i for i, r in enumerate(rows) if r[3] == source), key=lambda i: (key(rows[i][0]), rows[i][0] is not None, rows[i][0] or 0, size(rows[i][1])))
        done = 0
        for e in range(repeats):
            for i in queue:
                done += size(rows[i][1])
                if size(rows[i][1]) and target[source]:
                    items.append((done / target[source], source is None, source or "", i, e))
    items.sort(key=lambda x: x[:3])
    total = 0
    for _, _, _, i, _ in items:
        total += size(rows[i][1])
        if total > budget:
            break
        taken[i] += size(rows[i][1])
    return sorted(((r[0], size(r[1]), sizes[r[3]], float(target[r[3]]), t) for r, t in zip(rows, taken, strict=True)), key=repr)


def mixed_documents(r):
    rows = [(i, prose(r, r.randint(0, 30)), "en", r.choice(["a"] * 20 + ["b", "b", "c", None, "d"])) for i in range(300)]
    return rows + [(900, prose(r, 3), "en", "tiny"), (901, None, None, "empty"), (902, "", None, None), (None, "no id", "de", "a"), rows[3], rows[3]]


@pytest.mark.parametrize(("weights", "share", "repeats"), [((5, 2, 1), 1, 3), ((1, 7), 2, 4), ((1,), 0.5, 1)])
def test_mix_against_a_plain_queue(spark, weights, share, repeats):
    rows = mixed_documents(random.Random(5))
    df = spark.createDataFrame(rows, SCHEMA)
    mix = mixing.mix(df.repartition(5), weights=weights, share=share, max_repeats=repeats)
    got = rows_of(mix.taken())
    want = slow_mix(rows, weights, share, repeats)
    assert [(*g[:3], g[4]) for g in got] == [(*w[:3], w[4]) for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])
    assert rows_of(mixing.mix(df.repartition(2), weights=weights, share=share, max_repeats=repeats).taken()) == got

    target, largest, sums = {}, Counter(), Counter()
    by_id = {r[0]: r[3] for r in rows}
    for doc, size, _, goal, taken in got:
        assert taken <= repeats * size
        target[by_id[doc]] = goal
        largest[by_id[doc]] = max(largest[by_id[doc]], size)
        sums[by_id[doc]] += taken
    assert all(abs(sums[s] - target[s]) <= max(largest.values()) for s in target)

    schedule = mix.schedule().collect()
    assert [x.mixed for x in schedule] == sorted(x.mixed for x in schedule)
    assert sum(x["size"] for x in schedule) == sum(g[4] for g in got) == (schedule[-1].mixed if schedule else 0)
    assert [x.finish for x in schedule] == sorted(x.finish for x in schedule)


def test_mix_of_one_hot_source_and_of_repeated_ids(spark):
    rows = [(7, "a b c", "en", "hot")] * 400 + [(i, "x y", "en", f"s{i % 3}") for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r[4] for r in rows_of(mixing.mix(df.repartition(7)).taken())] == [w[4] for w in slow_mix(rows)]


def test_mix_of_odd_and_of_no_documents(spark, odd_documents, no_documents):
    got = mixing.mix(odd_documents).taken()
    assert got.count() == odd_documents.count()
    assert {r.taken for r in got.where("size = 0").collect()} == {0}
    assert mixing.mix(no_documents).taken().collect() == []
    assert mixing.mix(no_documents).schedule().collect() == []
    assert {r.taken for r in mixing.mix(odd_documents.where("text is null")).taken().collect()} == {0}


def test_mix_uses_no_python(spark, odd_documents):
    mix = mixing.mix(odd_documents)
    for df in (mix.taken(), mix.schedule()):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


# -------------------------------------------------------------- divergence


def slow_audit(rows, top=200):
    counts, documents, groups = Counter(), {}, set()
    for i, (_, text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for term in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or "")):
            counts[lang, source, term] += 1
            documents.setdefault((lang, term), set()).add(i)
    out = []
    for lang in {x for x, _ in groups}:
        terms = [t for (x, t), d in documents.items() if x == lang and len(d) >= 3]
        sources = [s for x, s in groups if x == lang]
        n = {s: sum(counts[lang, s, t] for t in terms) for s in sources}
        share = lambda c, total: 1 + 10**9 * (c + 1) // (total + len(terms))  # noqa: E731, B023
        p = {(s, t): share(counts[lang, s, t], n[s]) for s in sources for t in terms}
        q = {t: share(sum(counts[lang, s, t] for s in sources), sum(n.values())) for t in terms}
        for s in sources:
            pairs = [(sum((p[s, t] - p[o, t]) ** 2 // p[o, t] for t in terms), o) for o in sources if o != s]
            found = [((p[s, t] - q[t]) ** 2 // q[t], t) for t in terms if counts[lang, s, t] and p[s, t] > q[t]]
            for part, items in (("pair", pairs), ("term", found)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(items[: None if part == "pair" else top], 1)]
    return sorted(out, key=repr)


def divergent_documents(r):
    words = ["The", "the,", "cat-dog", "élan", "ÉLAN", "don't", "x1y2", "a_b", "mixed-Case-CASE", "…", "日本", "tail"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(i, " ".join(r.choices(words, k=r.randint(0, 12))), r.choice(["en", "de", None]), r.choice(["a", "b", "c", None])) for i in range(120)]
    # Terms in exactly two and three documents, in the same or in different chunks.
    rows += [(200, "twice twice. twice!", "en", "a"), (201, "twice", "en", "b"), (202, "thrice thrice.", "en", "a"), (203, "(thrice", "en", "a"), (204, "thrice;", "en", "c")]
    return rows + [(205, None, "fr", "a"), (206, "", "fr", "b"), (207, "1 2 3", "it", "a"), rows[3], rows[3]]


def test_audit_against_plain_counts(spark):
    rows = divergent_documents(random.Random(6))
    df = spark.createDataFrame(rows, SCHEMA)
    want = slow_audit(rows)
    assert {"thrice"} == {x[3] for x in want if x[3] in ("twice", "thrice")}
    assert rows_of(divergence.audit(df.repartition(5))) == want
    small = divergence.Limits(words=5, entries=7, tile=2, cells=5)
    assert rows_of(divergence.audit(df.repartition(2), top=3, limits=small)) == slow_audit(rows, top=3)


def test_audit_of_odd_and_of_no_documents(spark, odd_documents, no_documents):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in odd_documents.collect()]
    assert rows_of(divergence.audit(odd_documents)) == slow_audit(rows)
    assert divergence.audit(no_documents).collect() == []


def test_shares_stay_exact_beyond_64_bits():
    import numpy as np

    n, total = 3_000_000_000_000, 4_000_000_000_007
    assert divergence._shares(np.array([n]), np.array([total]))[0] == 1 + 10**9 * (n + 1) // total


# ------------------------------------------------------------ collocations


def slow_collocations(rows, top=2000, min_count=10, max_words=3, covered=50):
    f, n = {}, Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                f.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {x: a for x, a in counts.items() if len(x) > 1 and a >= min_count}
        inner = {}
        for x, a in candidates.items():
            for k in range(2, len(x)):
                for i in range(len(x) - k + 1):
                    inner[x[i : i + k]] = max(inner.get(x[i : i + k], 0), a)
        found = []
        for x, a in candidates.items():
            if x in inner and 100 * inner[x] >= covered * a:
                continue
            score, _, left, right = min((10**6 * a * a // (counts[x[:k]] * counts[x[k:]]), k, counts[x[:k]], counts[x[k:]]) for k in range(1, len(x)))
            found.append((-score, -a, " ".join(x).encode(), left, right))
        for rank, (score, a, x, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, x.decode(), -a, left, right, n[lang], -score))
    return sorted(out, key=repr)


def wordy_documents(r):
    vocabulary = ["The", "of", "new", "york", "city", "à", "B-b", "x", "日本", "#"] + [f"w{i}" for i in range(30)]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    def text():
        words = r.choices(vocabulary, weights, k=r.randint(0, 40))
        return "".join(w + r.choice([" ", "  ", "\t", " ", ". ", ",", "\n", "\x0b"]) for w in words)
    rows = [(i, text() + (" new york city hall" if i % 3 else " rare pair"), r.choice(["en", "en", None, "de"]), "s") for i in range(200)]
    return rows + [(300, None, "en", "s"), (301, "", "xx", "s"), (302, "a a a a a a a a a a a a", "xx", "s"), rows[5], rows[5]]


@pytest.mark.parametrize(("head_words", "head_phrases"), [(1000, 1000), (8, 1000), (1000, 5), (12, 4), (0, 0)])
@pytest.mark.parametrize("max_words", [3, 4])
def test_collocations_against_plain_counts(spark, head_words, head_phrases, max_words):
    rows = wordy_documents(random.Random(7))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = collocations.collocations(df, max_words=max_words, limits=collocations.Limits(head_words, head_phrases, pairs=700, words=20))
    assert rows_of(got) == slow_collocations(rows, max_words=max_words)


def test_sparse_tiles(spark):
    """Ids beyond the dense tiles: many words, each often enough."""
    r = random.Random(8)
    pairs = [(f"a{i}", f"b{i % 1300}") for i in range(2600)]
    texts = [" ".join(w for p in r.sample(pairs, 400) for w in p) for _ in range(90)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    small = collocations.Limits(dense=256, pairs=5000)
    assert rows_of(collocations.collocations(df, top=10_000, min_count=9, limits=small)) == slow_collocations(rows, top=10_000, min_count=9)


def test_collocations_of_odd_and_of_no_documents(spark, odd_documents, no_documents):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in odd_documents.collect()]
    assert rows_of(collocations.collocations(odd_documents)) == slow_collocations(rows)
    assert collocations.collocations(no_documents).collect() == []
    assert rows_of(collocations.collocations(odd_documents.where("text = ''"))) == []
    assert len(TEXTS) and odd_documents.where(F.col("text").isNull()).count()
