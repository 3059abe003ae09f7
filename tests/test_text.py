import base64
import random

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import brute
from lorekeep.functions import text as X
from lorekeep.functions.chunks import ChunkRules, chunk_elements, split_long_text
from lorekeep.functions.elements import ELEMENTS, elements_to_text, text_elements
from lorekeep.functions.tokens import Tokenizer, porter_stem, term_counts
from lorekeep.sources.files import decode_text, has_extension, is_below, not_excluded


def values(spark, column, rows, schema="x string"):
    df = spark.createDataFrame([(r,) for r in rows], schema)
    return [r[0] for r in df.select(column).collect()]


def test_lines_follow_python(spark):
    text = "a\r\nb\rc\n\n  d e\x85f\x0bg\x1ch  \t"
    want = [s.strip() for s in text.splitlines() if s.strip()]
    assert values(spark, X.lines(F.col("x")), [text]) == [want]


def test_truncate_counts_characters(spark):
    assert values(spark, X.truncate(F.col("x"), 3), ["a\U0001f600bcd", None]) == ["a\U0001f600b", ""]


def test_suffix_and_basename(spark):
    paths = ["/a/b.TXT", "c.tar.gz", "/x/.hidden", "noext", "a\\b\\d.md"]
    assert values(spark, X.suffix(F.col("x")), paths) == [".TXT", ".gz", "", "", ".md"]
    assert values(spark, X.basename(F.col("x")), paths)[0::4] == ["b.TXT", "d.md"]


def test_path_filters(spark):
    paths = ["/d/a.TXT", "/d/_Archives/b.txt", "/d/c.exe", "/dd/e.txt"]
    assert values(spark, has_extension(F.col("x"), ["txt"]), paths) == [True, True, False, True]
    assert values(spark, not_excluded(F.col("x")), paths) == [True, False, True, True]
    assert values(spark, is_below(F.col("x"), "/d/"), paths) == [True, True, True, False]


@pytest.mark.parametrize(
    "raw", ["déjà vu".encode(), "déjà vu €".encode("cp1252"), b"bad \x81 byte", b"", b"plain"]
)
def test_decoding_cascade(spark, raw):
    for encoding in ("utf-8", "cp1252"):
        try:
            want = raw.decode(encoding)
            break
        except UnicodeDecodeError:
            want = raw.decode("utf-8", "replace")
    assert values(spark, decode_text(F.col("x")), [raw], "x binary") == [want]


def test_strip_thinking(spark):
    mark = X.CHANNEL_MARK
    rows = {
        "<think>a\nb</think> yes ": "yes",
        f"{mark}thought about it{mark}final\nanswer": "final\nanswer",
        f"before{mark} THOUGHT never closed": "before",
        f"x{mark}y{mark}z": "z",
        "plain": "plain",
    }
    assert values(spark, X.strip_thinking(F.col("x")), [*rows, None]) == [*rows.values(), ""]


def test_analysis_needs_summary_and_keywords(spark):
    rows = [
        '{"summary": " s ", "keywords": ["a", " ", "b "]}',
        '{"summary": "s", "keywords": []}',
        '{"summary": " ", "keywords": ["a"]}',
        "no json",
        None,
    ]
    got = values(spark, X.parse_analysis(F.col("x")), rows)
    assert got[0].asDict() == {"summary": "s", "keywords": ["a", "b"]}
    failed = {"summary": X.FAILED_SUMMARY, "keywords": list(X.FAILED_KEYWORDS)}
    assert all(r.asDict() == failed for r in got[1:])


def test_head_and_tail(spark):
    long = " ".join(f"w{i}" for i in range(5001))
    short = " ".join(f"w{i}" for i in range(5000))
    got = values(spark, X.head_and_tail(F.col("x")), [long, short])
    assert got[1] == short
    assert got[0].startswith("Tête du document:\nw0 ") and got[0].endswith(" w5000")
    assert "w2499\n...\nQueue du document:\nw2501 " in got[0]


def test_citations_and_labels(spark):
    rows = [("S", 2), ("S", None), (None, 3), ("", 0), (None, None)]
    df = spark.createDataFrame(rows, "s string, p int")
    cited = [tuple(r) for r in df.select(X.citation(F.col("s"), F.col("p")), X.citation(F.col("s"), F.col("p"), False)).collect()]
    assert cited == [("S, p.2",) * 2, ("S",) * 2, ("p.3",) * 2, ("p.0", ""), ("", "")]
    labels = [r[0] for r in df.select(X.source_label(F.lit("f.txt"), F.col("p"), F.col("s"))).collect()]
    assert labels == ["f.txt - p.2 - S", "f.txt - S", "f.txt - p.3", "f.txt", "f.txt"]
    assert df.select(X.source_label(F.lit(""), F.col("p"), F.col("s"))).first()[0] is None


def test_image_mime(spark):
    paths = ["a.JPG", "b.png", "c.tif", "d.webp", "e"]
    want = ["image/jpeg", "image/png", "image/tiff", "image/png", "image/png"]
    assert values(spark, X.image_mime(F.col("x")), paths) == want
    encoded = spark.createDataFrame([(b"\x00\x01",)], "x binary").select(F.base64("x")).first()[0]
    assert encoded == base64.b64encode(b"\x00\x01").decode()


# ------------------------------------------------------------------ elements


def test_markdown_elements(spark):
    text = "intro\n# One\nbody\n- item\n##   \n## Two\n* x\n+ y\n-no\n\n#Three"
    got = values(spark, text_elements(F.col("x")), [text])[0]
    assert [(e.text, e.element_type, e.section) for e in got] == [
        ("intro", "NarrativeText", None),
        ("One", "Title", "One"),
        ("body", "NarrativeText", "One"),
        ("item", "ListItem", "One"),
        ("Two", "Title", "One"),
        ("x", "ListItem", "Two"),
        ("y", "ListItem", "Two"),
        ("-no", "NarrativeText", "Two"),
        ("Three", "Title", "Two"),
    ]
    assert values(spark, elements_to_text(text_elements(F.col("x"))), [text, "", None])[:2] == [
        "intro\nOne\nbody\nitem\nTwo\nx\ny\n-no\nThree", "",
    ]


# ------------------------------------------------------------ split and chunk

_alphabet = st.text(alphabet="ab .!?\né\U0001f600", max_size=900)


@settings(max_examples=25, deadline=None)
@given(st.lists(_alphabet, min_size=1, max_size=20))
def test_split_matches_brute_force(spark, texts):
    for size, overlap in ((300, 50), (120, 30)):
        got = values(spark, split_long_text(F.col("x"), size, overlap), texts)
        assert got == [brute.split(t, size, overlap) for t in texts]


def test_split_bounds(spark):
    text = "One sentence here. " * 400
    parts = values(spark, split_long_text(F.col("x"), 300, 50), [text])[0]
    assert all(len(p) <= 300 for p in parts) and all(p.endswith(".") for p in parts)
    assert sum(map(len, parts)) > len(text.strip())
    with pytest.raises(ValueError):
        split_long_text(F.col("x"), 300, 150)


def random_elements(seed):
    rng = random.Random(seed)
    kinds = ["NarrativeText"] * 5 + ["Title", "ListItem", "Table", "Section"]
    out = []
    for _ in range(rng.randrange(0, 60)):
        words = rng.choice([0, 1, 3, 20, 60, 300, 800])
        text = " ".join(rng.choice(["alpha", "be.", "gamma!", "d\n"]) for _ in range(words))
        out.append((text, rng.choice(kinds), rng.choice([None, 1, 2]), rng.choice([None, "S"])))
    return out


@pytest.mark.parametrize("cap", [100, 7, None])
def test_chunks_match_brute_force(spark, cap):
    docs = [random_elements(seed) for seed in range(60)]
    df = spark.createDataFrame([(d,) for d in docs], f"x {ELEMENTS}")
    rules = ChunkRules(max_chunks=cap)
    got = [[tuple(c) for c in r[0]] for r in df.select(chunk_elements(F.col("x"), rules)).collect()]
    assert got == [brute.chunks(d, cap) for d in docs]


def test_title_opens_a_parent_only_after_enough_text(spark):
    def parents(words):
        rows = [("word " * words, "NarrativeText", None, None), ("Next", "Title", None, None), ("end", "NarrativeText", None, None)]
        df = spark.createDataFrame([(rows,)], f"x {ELEMENTS}")
        return {c.parent_text for c in df.select(chunk_elements(F.col("x"))).first()[0]}

    assert len(parents(50)) == 1 and len(parents(100)) == 2


def test_cap_renumbers(spark):
    rows = [("A long enough sentence to pass. " * 60, "NarrativeText", None, None)] * 150
    df = spark.createDataFrame([(rows,)], f"x {ELEMENTS}")
    got = df.select(chunk_elements(F.col("x"), ChunkRules(max_chunks=100))).first()[0]
    assert [c.chunk_index for c in got] == list(range(100))
    assert len(df.select(chunk_elements(F.col("x"))).first()[0]) > 150


def test_one_very_long_line_is_split_in_linear_time(spark):
    def seconds(chars):
        df = spark.createDataFrame([("Some words é of it. " * (chars // 20),)], "x string")
        start = time.time()
        assert df.select(F.size(split_long_text(F.col("x"), 300, 50))).first()[0] > chars / 300
        return time.time() - start

    seconds(1000)
    assert seconds(2_000_000) < 8


def test_documents_of_many_elements_are_chunked_in_linear_time(spark):
    rows = [("A line of a long document, some eighty characters long, as lines mostly are.", "NarrativeText", None, None)] * 20_000
    df = spark.createDataFrame([(rows,)], f"x {ELEMENTS}")
    start = time.time()
    assert df.select(F.size(chunk_elements(F.col("x")))).first()[0] > 4000
    assert time.time() - start < 10


# -------------------------------------------------------------------- tokens


def test_tokens_and_counts(spark):
    text = "Été, l'ÉTÉ 42 Straße éte"
    assert values(spark, Tokenizer().tokens(F.col("x")), [text]) == [
        ["ete", "l", "ete", "stra", "e", "ete"]
    ]
    got = values(spark, term_counts(Tokenizer().tokens(F.col("x"))), [text, "42", ""])
    assert [(t.term, t.tf) for t in got[0]] == [("e", 1), ("ete", 3), ("l", 1), ("stra", 1)]
    assert got[1:] == [[], []]


@pytest.mark.parametrize(
    "word,stem",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"),
        ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"),
        ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"),
        ("relational", "relat"), ("digitizer", "digit"), ("triplicate", "triplic"), ("hopeful", "hope"),
        ("allowance", "allow"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"),
        ("controll", "control"), ("roll", "roll"), ("generalizations", "gener"), ("oscillators", "oscil"),
    ],
)
def test_porter_published_examples(word, stem):
    assert porter_stem(word) == stem


def test_stemming_and_stopwords(spark):
    english = Tokenizer.english()
    got = values(spark, english.tokens(F.col("x")), ["The connections were connected", None, "the"])
    assert got == [["connect", "connect"], None, []]
