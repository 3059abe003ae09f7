"""Main text of pages and WARC records."""

import base64
import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest

from lorekeep.llm import html_extract, html_samples, html_tree, warc


@pytest.fixture(scope="module")
def trees(spark):
    return html_extract.fit(spark)


def test_trees_give_the_margins_of_the_fitted_model(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    r = np.random.default_rng(2)
    x = r.normal(size=(300, 4)).round(3)
    rows = [(float(a[0] * a[1] > 0), a.tolist()) for a in x]
    data = spark.createDataFrame(rows, "label double, x array<double>").select("label", array_to_vector("x").alias("features"))
    model = GBTClassifier(maxIter=4, maxDepth=3, seed=1).fit(data)
    raw = [row.rawPrediction[1] for row in model.transform(data).collect()]
    assert np.allclose(html_extract.Trees.of(model).margins(x), 2 * np.array(raw)) or np.allclose(html_extract.Trees.of(model).margins(x), raw)


def slow_decode(page, margins):
    best = None
    n = len(page.parent)
    for states in itertools.product((0, 1, 2), repeat=n):
        if states[0] == 2 or any(s < states[page.parent[v]] or s - states[page.parent[v]] > 1 for v, s in enumerate(states) if v):
            continue
        total = -html_extract.ENTER if states[0] == 1 else 0.0
        for v, s in enumerate(states):
            gain = max(-html_extract.MOST, min(html_extract.MOST, margins[v])) * (1.0 if page.own[v] else html_extract.EMPTY_WEIGHT)
            total += gain * (s == 1)
            if v:
                step = (states[page.parent[v]], s)
                total -= {(0, 1): html_extract.ENTER, (1, 2): html_extract.LEAVE}.get(step, 0.0)
        best = total if best is None else max(best, total)
    return best


def score_of(page, margins, kept):
    total = 0.0
    above_inside = [False] * len(kept)
    for v, inside in enumerate(kept):
        p = page.parent[v]
        gain = max(-html_extract.MOST, min(html_extract.MOST, margins[v])) * (1.0 if page.own[v] else html_extract.EMPTY_WEIGHT)
        total += gain * inside
        if inside and (v == 0 or not kept[p]):
            assert v == 0 or not above_inside[p], "kept below a dropped part of the article"
            total -= html_extract.ENTER
        if v and kept[p] and not inside:
            total -= html_extract.LEAVE
        above_inside[v] = inside or (v > 0 and above_inside[p])
    return total


def test_decoding_is_the_best_consistent_choice():
    r = random.Random(3)
    for _ in range(60):
        page = html_tree.Page()
        for v in range(1, r.randint(2, 8)):
            page.add(r.randrange(v), "div", "", labelled=False)
        page.own = [r.choice((0, 5)) for _ in page.own]
        margins = [r.uniform(-6, 6) for _ in page.own]
        kept = html_extract.decode(page, margins)
        assert score_of(page, margins, kept) == pytest.approx(slow_decode(page, margins))


def all_text(source):
    page = html_tree.read_page(source)
    return html_extract.kept_text(page, [True] * len(page.parent))


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("", ""),
        ("plain", "plain"),
        ("<p>a<b>b</b>c<br>d</p><p>e", "abc d e"),
        ("<p>a &amp; b&nbsp;&#99; &am</p>", "a & b c &am"),
        ("<ul><li>x<li>y</ul>z", "x y z"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"),
        ("<style>p{}</style><script>var t='</p>';</script>t<!-- no --> <!doctype html>u", "t u"),
        ("a<script>never closed", "a"),
        ("a < b <3 c<p", "a < b <3 c"),
        ("<p title='a>b'>x</p >y<div", "x y"),
        ("<body><p>q</i></section></p>r</body>", "q r"),
        ("<title>no</title><head><meta></head><body>yes", "yes"),
        ("<p>  many \n\t spaces </p>", "many spaces"),
    ],
)
def test_reading_markup(source, text):
    assert all_text(source) == text


def test_composed_pages_are_extracted(trees):
    exact = lost = 0
    for i in range(10_000, 10_120):
        source = html_samples.sample_page(i)
        page = html_tree.read_page(source)
        want = html_extract.kept_text(page, [y == 1 for y in page.label])
        got = html_extract.texts_of([source], [trees][0])[0]
        exact += got == want
        lost += bool(want) and not got
    assert exact >= 100 and lost <= 6


def test_an_article_among_everything_else(trees):
    source = (
        "<html><head><title>T</title></head><body><header class=top>Site name</header><nav><ul><li><a href=/a>A</a></li><li><a href=/b>B</a></li></ul></nav>"
        "<div class='ad'>Buy this now.</div><article><h1>Head &amp; line</h1><p>First paragraph of the text, long enough to read.</p>"
        "<div class='ad'>Buy that.</div><p><b>Second paragraph<br>goes on here, with more words to read.<p>Third one is unclosed</article>"
        "<section class='comments'><h3>Comments</h3><p>I do not agree with any of this, says a reader.</p></section>"
        "<aside class='sidebar'><a href=/x>More</a></aside><form><label>Name</label><button>Go</button></form><footer>&copy; site</footer></body></html>"
    )
    (text,) = html_extract.texts_of([source], trees)
    assert text == "Head & line First paragraph of the text, long enough to read. Second paragraph goes on here, with more words to read. Third one is unclosed"


def test_odd_pages(spark, trees):
    long = "<html><body><article>" + "<p>some words of a long page here</p>" * 5000 + "</article></body></html>"
    rows = [(1, None, None, "a", 1), (2, "u", "", "b", 2), (None, "u", long, "c", 3), (4, "v", "<div>" * 3000 + "x", "d", 4), (4, "v", "<div>" * 3000 + "x", "d", 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, h long")
    got = html_extract.extract(df, trees).collect()
    assert Counter(r.page_id for r in got) == Counter([1, 2, None, 4, 4])
    assert {r.text for r in got if r.page_id in (1, 2)} == {""}
    assert next(r.n_chars for r in got if r.page_id is None) == len("some words of a long page here ") * 5000 - 1
    assert html_extract.extract(df.limit(0), trees).collect() == []


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, record string, data long")


def slow_records(rows):
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    out = Counter()
    for page, _, html, *_ in rows:
        same = [p for p, _, h, *_ in rows if digest(h) == digest(html)]
        first = max((p for p in same if p is not None), default=None)
        response = len(same) == 1 or page == first
        out[page, len((html or "").encode()), digest(html), "response" if response else "revisit", None if response else first] += 1
    return out


def test_records_come_back(spark):
    r = random.Random(5)
    long = "".join(r.choices("abé🙂\r\n", k=300_000)) + "\r\n\r\nWARC/1.1\r\n\r\n"
    rows = [(1, "http://a/\r\nb", "<p>x</p>", "r", 1), (2, None, "<p>x</p>", "r", 1), (3, "", None, "r", 1), (4, "u", "", "r", 1), (9, "u", long, "r", 1), (5, "u", long, None, None)]
    rows += [(7, "u", "twice", "r", 1), (7, "u", "twice", "r", 1), (8, "u", "\r\n\r\n", "r", 1), (None, "u", "no id", "r", 1)]
    for chunk in (97, 1000, warc.CHUNK):
        table = warc.write_archive(pages(spark, rows).repartition(3), "page_id", "url", "html", chunk=chunk)
        assert table.selectExpr("max(octet_length(data))").first()[0] <= max(chunk, 800) + 8
        got = warc.read_archive(table, "page_id").collect()
        assert Counter(map(tuple, got)) == slow_records(rows)
    empty = pages(spark, rows).limit(0)
    assert warc.read_archive(warc.write_archive(empty, "page_id", "url", "html"), "page_id").collect() == []


def test_small_payloads_can_stay_responses(spark):
    rows = [(1, "u", "x", "r", 1), (2, "u", "x", "r", 1), (3, "u", "long one", "r", 1), (4, "u", "long one", "r", 1)]
    got = warc.read_archive(warc.write_archive(pages(spark, rows), "page_id", "url", "html", min_bytes=5), "page_id").collect()
    assert {r.page_id: (r.record_type, r.refers_to) for r in got} == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}


def test_chunks_carry_running_digests_and_damage_is_found():
    payload = bytes(range(256)) * 40
    header = warc.record_header("1", "u", "response", len(payload), warc.base32(hashlib.sha1(payload).digest()), None)
    chunks = list(warc.chunks_of(header, memoryview(payload), 1000))
    assert b"".join(c for c, _, _ in chunks) == header + payload + b"\r\n\r\n"
    assert chunks[-1][1] == hashlib.sha1(payload).hexdigest() and [x[2] for x in chunks] == [False] * (len(chunks) - 1) + [True]
    reader = warc.Reader()
    rows = [reader.feed(memoryview(c), last) for c, _, last in chunks]
    assert rows[-1] == (1, len(payload), warc.base32(hashlib.sha1(payload).digest()), "response", None)
    broken = bytearray(chunks[1][0])
    broken[5] ^= 1
    reader = warc.Reader()
    with pytest.raises(ValueError, match="damaged"):
        for c, _, last in [chunks[0], (bytes(broken), None, False), *chunks[2:]]:
            reader.feed(memoryview(c), last)


def test_label_attributes_of_given_pages_are_ignored():
    one = np.zeros((1, 1))
    trees = html_extract.Trees(one.astype(np.int32), one + np.inf, one.astype(np.int32), one.astype(np.int32), one + 1.0, 1)
    for mark in ('data-y="12.5"', 'data-y=""', "data-y=top", 'metadata-y="a"', 'DATA-Y="x"', 'data-y="1"'):
        assert html_extract.texts_of([f"<body><div {mark}><p>some text</p></div></body>"], trees) == ["some text"]
        page = html_tree.read_page(f"<body><div {mark}>x</div></body>", labelled=False)
        assert set(page.label) == {0} and not any(page.words)
