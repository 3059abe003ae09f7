"""Elements as rows: against the array form, over block borders, in bounded memory."""

import subprocess
import sys
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekeep.functions.elements import text_elements
from lorekeep.operators.common import unnest
from lorekeep.sources import rows as R
from lorekeep.sources.files import decode_text

TEXTS = [
    None, "", " \n\t\n", "one line", "# A\nx\n## B\ny\n- item\n* \n#\nz", "a\r\nb\rc d\x85e\x1cf", "  # not stripped yet\n+ é\xa0 ",
    "- a\n# " + "t" * 500 + "\nafter", "#\n#\nx", "\n".join(f"{'#' if n % 7 == 0 else '-'} line {n}" for n in range(3000)), "same", "same",
]


def _arrays(df):
    found = df.select("id", F.posexplode_outer(text_elements(F.col("content"))).alias("position", "e")).where("e is not null")
    return sorted(map(tuple, found.select("id", "position", "e.element_type", "e.text", "e.section").collect()), key=str)


def test_rows_equal_the_array_form(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, content string")
    got = R.with_element_rows(df, "content")
    assert got.columns == ["id", *R.FIELDS]
    assert sorted(map(tuple, got.collect()), key=str) == _arrays(df)
    assert R.with_element_rows(df.where("id < 0"), "content").count() == 0
    R.register(spark)
    df.createOrReplaceTempView("told")
    sql = spark.sql("SELECT id, e.* FROM told, LATERAL element_rows(content) e")
    assert sorted(map(tuple, sql.collect()), key=str) == _arrays(df)


def test_columns_that_clash(spark):
    df = spark.createDataFrame([(1, "a\nb", "x")], "id long, text string, `odd.name` string")
    assert [tuple(r) for r in R.with_element_rows(df, "text").select("id", "`odd.name`", "position").collect()] == [(1, "x", 0), (1, "x", 1)]
    with pytest.raises(ValueError):
        R.with_element_rows(df.withColumn("Section", F.lit(1)), "text")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab#- \r\n\x0b ", max_size=60), st.integers(1, 7))
def test_block_borders_change_nothing(text, step):
    assert list(R.rows_of(text[i : i + step] for i in range(0, len(text), step))) == list(R.rows_of([text]))


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.integers(1, 5))
def test_encoding_is_that_of_the_whole_file(data, step):
    def decodes(name):
        try:
            data.decode(name)
            return True
        except UnicodeDecodeError:
            return False

    want = ("utf-8", "strict") if decodes("utf-8") else ("cp1252", "strict") if decodes("cp1252") else ("utf-8", "replace")
    assert R.encoding_of(data[i : i + step] for i in range(0, len(data), step)) == want


def test_files_equal_decoded_contents(spark, tmp_path):
    contents = [b"", "# é\nx".encode(), "# é\ncaf\xe9".encode("cp1252"), b"# a\x81b\n\xff\xfe c", b"a\r\n" * 5, "﻿x".encode(), "cut é".encode()[:-1]]
    for n, data in enumerate(contents):
        (tmp_path / f"f{n}.txt").write_bytes(data)
    files = spark.createDataFrame([(n, str(tmp_path / f"f{n}.txt"), bytearray(c)) for n, c in enumerate(contents)], "id long, path string, content binary")
    found = unnest(files, ["id"], text_elements(decode_text(F.col("content"))))
    want = sorted((r["id"], r["element_type"], r["text"], r["section"]) for r in found.collect() if r["section"])
    rows = R.with_file_rows(files.select("id", "path")).collect()
    got = sorted((r["id"], r["element_type"], r["text"], r["section"]) for r in rows if r["section"])
    assert got == want
    assert len(rows) == found.count()
    gone = R.with_file_rows(spark.createDataFrame([(str(tmp_path / "none"),), (None,)], "path string")).collect()
    assert len(gone) == 1 and (gone[0]["position"], gone[0]["element_type"]) == (-1, "error")


def test_a_file_of_200_mb_is_never_held(tmp_path):
    """The rows of a large file, read by a process of its own."""
    path = tmp_path / "large.md"
    line = b"word " * 2000 + b"\n"
    with open(path, "wb") as f:
        for n in range(20_000):
            f.write(b"# title\n" if n % 100 == 0 else line)
    assert path.stat().st_size > 190_000_000
    code = (
        "import resource, sys\nfrom lorekeep.sources.rows import file_rows\n"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\nn = sum(1 for _ in file_rows(sys.argv[1]))\n"
        "print(n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)"
    )
    told = subprocess.run([sys.executable, "-c", code, str(path)], cwd=Path(__file__).parents[1], capture_output=True, text=True, check=True)
    n, grown_mb = map(int, told.stdout.split())
    assert n == 20_000 and grown_mb < 100
