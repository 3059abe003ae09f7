import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lorekeep.functions.lines import group_words
from lorekeep.sources.files import read_files
from lorekeep.sources.html import html_elements, html_matches
from lorekeep.sources.router import extract_elements, page_elements

PAGE = """<html><head><title>t</title><style>p{}</style></head><body>
<header><h1>gone</h1></header><nav><ul><li>gone</li></ul></nav>
<h2> Main <em>part</em> </h2><p>First <b>bold</b> text<p>Second &amp; more<br>line
<ul><li><p>inner</p></li><li>plain</ul>
<table><tr><th>a</th><th>b</th></tr><tr></tr><tr><td>1</td><td> <i>2</i> </td></tr></table>
<script>var s = "<p>no</p>";</script><!-- <p>no</p> --><h3></h3><footer><p>gone</p></footer></body></html>"""


def test_html_elements(spark):
    df = spark.createDataFrame([(PAGE,), (None,), ("",)], "x string")
    rows = [r[0] for r in df.select(html_elements(F.col("x"))).collect()]
    assert [(e.text, e.element_type, e.section) for e in rows[0]] == [
        ("Mainpart", "Title", None),
        ("Firstboldtext", "NarrativeText", "Mainpart"),
        ("Second & moreline", "NarrativeText", "Mainpart"),
        ("inner", "ListItem", "Mainpart"),
        ("inner", "NarrativeText", "Mainpart"),
        ("plain", "ListItem", "Mainpart"),
        ("a\tb\n1\t2", "Table", "Mainpart"),
    ]
    assert rows[2] == []


def word(text, x0, top, size=10.0, font="Regular"):
    return (text, x0, top, size, font)


WORDS = "array<struct<text:string,x0:double,top:double,size:double,fontname:string>>"
BOXES = "array<struct<x0:double,top:double,x1:double,bottom:double>>"


def test_words_become_lines(spark):
    words = [
        word("world", 50.0, 10.0), word("hello", 10.0, 10.02), word("drift", 90.0, 12.9),
        word("Big", 10.0, 30.0, 15.0), word("Heavy", 10.0, 50.0, 9.0, "Sans-BoldItalic"),
        word("boxed", 200.0, 200.0), word(" ", 10.0, 400.0), word("zero", 10.0, 300.0, 0.0),
    ]
    df = spark.createDataFrame([(words, [(190.0, 190.0, 250.0, 210.0)]), ([], [])], f"w {WORDS}, b {BOXES}")
    got = [[tuple(g) for g in r[0]] for r in df.select(group_words(F.col("w"), F.col("b"))).collect()]
    assert got == [
        [("hello world drift", False), ("Big", True), ("Heavy", True), ("zero", False)],
        [],
    ]


def test_page_elements(spark):
    schema = (
        f"p array<struct<page_number:int,tables:array<string>,boxes:{BOXES},words:{WORDS},plain:array<string>>>"
    )
    pages = [
        (1, [], [], [word("Head", 1.0, 1.0, 20.0), word("body", 1.0, 30.0)], []),
        (2, ["a\tb"], [], [], ["flat line"]),
    ]
    df = spark.createDataFrame([(pages, [(1, "picture")])], schema + ", t array<struct<page_number:int,text:string>>")
    told = df.select(page_elements(F.col("p"), F.col("t"))).first()[0]
    assert [e.text for e in told] == ["Head", "body", "picture", "a\tb", "flat line"]
    assert tuple(told[2]) == ("picture", "NarrativeText", 1, "Head")
    got = df.select(page_elements(F.col("p"))).first()[0]
    assert [tuple(e) for e in got] == [
        ("Head", "Title", 1, None),
        ("body", "NarrativeText", 1, "Head"),
        ("a\tb", "Table", 2, "Head"),
        ("flat line", "NarrativeText", 2, "Head"),
    ]


def docx_bytes():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    para = lambda text, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'
    cell = lambda text: f"<w:tc>{para(text)}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>"
    body = para("Top", "H1") + para("text") + table + para("entry", "ListBullet") + para(" ")
    blip = '<a:blip xmlns:a="a" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" r:embed="r1"/>'
    body += f'<w:p><w:r><wp:inline xmlns:wp="wp">{blip}</wp:inline></w:r></w:p>'
    links = '<Relationships><Relationship Id="r1" Target="media/i.jpeg"/><Relationship Id="r2" Target="media/unused.png"/></Relationships>'
    styles = f'<w:styles {w}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as package:
        package.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        package.writestr("word/styles.xml", styles)
        package.writestr("word/_rels/document.xml.rels", links)
        package.writestr("word/media/i.jpeg", b"jpeg")
    return out.getvalue()


@pytest.fixture(scope="module")
def extracted(spark):
    files = [
        ("/d/a.csv", b"a,b\n1,2\n3,4"),
        ("/d/b.docx", docx_bytes()),
        ("/d/c.docx", b"broken"),
        ("/d/d.png", b"\x89PNG\x00"),
        ("/d/e.md", "# T\ncafé".encode("cp1252")),
        ("/d/f.HTM", PAGE.encode()),
        ("/d/g.pdf", b"%PDF broken"),
        ("/d/h.doc", b"old"),
        ("/d/i.unknown", b"read as text"),
    ]
    df = spark.createDataFrame(files, "path string, content binary")
    rows = extract_elements(df, describer=lambda image, mime: f" seen {mime} ").collect()
    return {r["path"]: r for r in rows}


def found(row):
    return [(e.text, e.element_type, e.section) for e in row["elements"]]


def test_router(extracted):
    assert found(extracted["/d/a.csv"]) == [(" a  b\n 1  2\n 3  4", "Table", "a.csv")]
    assert found(extracted["/d/b.docx"]) == [
        ("Top", "Title", None),
        ("text", "NarrativeText", "Top"),
        ("a\tb\n1\t2", "Table", "Top"),
        ("entry", "ListItem", "Top"),
        ("seen image/jpeg", "NarrativeText", "Top"),
    ]
    assert found(extracted["/d/c.docx"]) == [] and "BadZipFile" in extracted["/d/c.docx"]["extract_error"]
    assert found(extracted["/d/d.png"]) == [("seen image/png", "NarrativeText", "d.png")]
    assert found(extracted["/d/e.md"]) == [("T", "Title", "T"), ("café", "NarrativeText", "T")]
    assert len(found(extracted["/d/f.HTM"])) == 7
    assert extracted["/d/g.pdf"]["extract_error"] and found(extracted["/d/g.pdf"]) == []
    assert extracted["/d/h.doc"]["extract_error"] == "unsupported format"
    assert found(extracted["/d/i.unknown"]) == [("read as text", "NarrativeText", None)]


def test_images_need_a_describer(spark):
    df = spark.createDataFrame([("/d/x.png", b"\x89PNG")], "path string, content binary")
    row = extract_elements(df).first()
    assert row["elements"] == [] and row["extract_error"] is None


def test_read_files_is_recursive(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("a")
    (tmp_path / "sub" / "b.txt").write_text("b")
    got = {r["path"] for r in read_files(spark, str(tmp_path)).select("path").collect()}
    assert got == {str(tmp_path / "a.txt"), str(tmp_path / "sub" / "b.txt")}


class FakePdf(list):
    """Stands in for the optional renderer: one page of text with a picture, one scanned page."""

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return None

    def extract_image(self, number):
        return {"image": b"pic", "ext": "jpg"} if number == 7 else {}


class FakePage:
    def __init__(self, text, images=()):
        self.text, self.images = text, images

    def get_text(self):
        return self.text

    def get_images(self, full):
        return self.images

    def get_pixmap(self, dpi, alpha):
        self.dpi = dpi
        return self

    def tobytes(self, kind):
        return f"{kind}@{self.dpi}".encode()


def test_pdf_pictures(monkeypatch):
    import sys
    import types

    from lorekeep.sources import office

    pages = FakePdf([FakePage(" text ", [(7,), (8,)]), FakePage(" \n")])
    monkeypatch.setitem(sys.modules, "fitz", types.SimpleNamespace(open=lambda stream, filetype: pages))
    assert office._pdf_images(b"x", 150) == [
        {"page_number": 1, "mime": "image/jpeg", "data": b"pic"},
        {"page_number": 2, "mime": "image/png", "data": b"png@150"},
    ]
    assert office.rasterize_page(b"x", 2, 90) == b"png@90"
    assert [p["plain"] for p in office._pdf_plain(b"x")] == [["text"], []]


def test_text_of_plain_blocks_is_not_lost(spark):
    page = (
        "<html><head><title>no</title></head><body>loose <b>text</b> here<div>in a div<p>in a p</p>after it"
        "<select><option>no</option></select></div><nav>no</nav><ul><li>item</li></ul></body></html>"
    )
    found = spark.createDataFrame([(page,)], "x string").select(html_matches(F.col("x"))).first()[0]
    assert [(e.element_type, e.text) for e in found] == [
        ("NarrativeText", "loose text here"), ("NarrativeText", "in a div"), ("NarrativeText", "in a p"),
        ("NarrativeText", "after it"), ("ListItem", "item"),
    ]


def test_tables_in_other_encodings_and_broken_ones_are_read(spark):
    rows = [("/d/a.csv", "name,n\nété,1\n".encode("cp1252")), ("/d/b.csv", b'a,b\n1,2\n1,2,3,4\n"open'), ("/d/c.csv", b"")]
    df = spark.createDataFrame(rows, "path string, content binary")
    found = {r["path"]: r for r in extract_elements(df).collect()}
    assert "été" in found["/d/a.csv"]["elements"][0]["text"] and found["/d/a.csv"]["elements"][0]["element_type"] == "Table"
    assert [e["text"] for e in found["/d/b.csv"]["elements"]] == ["a,b", "1,2", "1,2,3,4", '"open']
    assert found["/d/b.csv"]["extract_error"] is None and found["/d/c.csv"]["elements"] == []
