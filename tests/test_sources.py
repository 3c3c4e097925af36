import io
import zipfile

import pytest
from pyspark.sql import functions as F

from fluvial.sources import captions, files, markdown, markup, pages


def kinds(df, *more):
    return [(r.kind, r.text, *(r[m] for m in more)) for r in df.orderBy("section_ord", "block_ord").collect()]


def of(parse, value):
    return [(b["kind"], b["text"]) for b in parse(value)]


def packed(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in members.items():
            z.writestr(k, v)
    return out.getvalue()


def test_markdown(spark):
    text = "---\ntitle: Safe Lesson\ntags: [a, 'b', ]\n---\nbefore\n\n# Topic\ntext \nmore\n- one\n2. two\n\n## Details ##x\n```py\nx = 1\n\n```\n|a|b|\n|---|---|\n|1|2|\n#### Deep\n~~~\nopen"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "\n \n")], "doc_id long, text string")
    got = markdown.blocks(docs)
    assert [r.doc_id for r in got.select("doc_id").distinct().collect()] == [1]
    assert kinds(got, "section_ord", "line_start", "line_end") == [
        ("paragraph", "before", 0, 5, 5), ("heading", "Topic", 1, 7, 7), ("paragraph", "text\nmore", 1, 8, 9), ("list", "one\ntwo", 1, 10, 11), ("heading", "Details ##x", 2, 13, 13),
        ("code", "x = 1\n", 2, 14, 17), ("table", "|a|b|\n|1|2|", 2, 18, 20), ("heading", "Deep", 3, 21, 21), ("code", "open", 3, 22, 23),
    ]
    assert [r.heading_path for r in got.filter("kind = 'heading'").orderBy("block_ord").collect()] == [["Topic"], ["Topic", "Details ##x"], ["Topic", "Details ##x", "Deep"]]
    assert got.filter("language = 'py'").count() == 1
    front = docs.orderBy("doc_id").select(markdown.front_matter(F.col("text")).alias("f")).collect()
    assert (front[0].f.title, front[0].f.tags, front[1].f) == ("Safe Lesson", ["a", "b"], None)


def test_pages(spark):
    html = "<title>T</title>loose<h1>A &amp; B</h1><p>one <b>two</b><p>three<script>x<p>no</p></script></p><ul><li>l</ul><blockquote>q</blockquote><pre> c\n d </pre><img alt=' pic '><table><tr><th>h<td>i<table><tr><td>in</table><tr><td>1</table>"
    rows = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    want = [("heading", "A & B"), ("paragraph", "one two"), ("paragraph", "three"), ("list", "l"), ("quote", "q"), ("code", "c\n d"), ("caption", "pic"), ("table", "in"), ("table", "h\ti\n1")]
    assert kinds(pages.blocks(rows)) == want


def test_captions(spark):
    srt = "1\n00:00:01,000 --> 00:00:02,000\nHello\n\n2\n00:00:02.900 --> 00:00:04,000\n there \nfriend\n\n3\n01:00.000 --> 01:01.500\nLate\n\n4\n00:02:00,000 --> 00:02:01,000\n"
    got = captions.blocks(spark.createDataFrame([(1, srt), (2, None)], "doc_id long, text string")).orderBy("block_ord").collect()
    assert [(r.text, r.start, r.end, r.line_start, r.line_end) for r in got] == [("Hello\nthere\nfriend", 1.0, 4.0, 2, 8), ("Late", 60.0, 61.5, 11, 12)]


@pytest.mark.parametrize(
    ("kind", "text", "want"),
    [
        ("yaml", "title: 'My notes'\n\nbody", [(0, "heading", "My notes", 1, 1), (1, "paragraph", "body", 3, 3)]),
        ("rst", "Head\n====\ntext", [(0, "heading", "Head", 1, 2), (1, "paragraph", "text", 3, 3)]),
        ("org", "** Head \ntext", [(0, "heading", "Head", 1, 1), (1, "paragraph", "text", 2, 2)]),
        ("latex", "\\section{Head}\ntext", [(0, "heading", "Head", 1, 1), (1, "paragraph", "text", 2, 2)]),
        ("text", "\nplain", [(0, "paragraph", "plain", 2, 2)]),
    ],
)
def test_markup(spark, kind, text, want):
    got = markup.blocks(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), kind)
    assert [tuple(r)[1:] for r in got.orderBy("block_ord").collect()] == want


def test_text_files(spark):
    assert of(files.csv_of, 'Name,Score\n"a,b",1\n') == [("table", "Name\tScore\na,b\t1")]
    assert of(files.tsv_of, "only\theader") == []
    assert of(files.xml_of, '<a x="1"> t <b>u</b>tail</a>') == [("metadata", "/a/@x = 1"), ("metadata", "/a = t"), ("metadata", "/a/b = u")]
    book = '{"cells": [{"cell_type": "markdown", "source": ["# x\\n", "y"]}, {"cell_type": "code", "source": "1+1", "outputs": [{"output_type": "stream", "text": "2"}, {"data": {}}]}]}'
    assert of(files.notebook_of, book) == [("paragraph", "# x\ny"), ("code", "1+1"), ("transcript", "2")]
    rows = spark.createDataFrame([(1, "<!DOCTYPE x><a/>"), (2, "<a>"), (3, "<a>x</a>"), (4, "<a>" * 70 + "</a>" * 70), (5, None)], "doc_id long, text string")
    got = {r.doc_id: r.error for r in files.blocks(rows, "xml", "text").collect()}
    assert got == {1: "xml_not_safe", 2: "malformed_file", 3: None, 4: "document_too_complex", 5: "malformed_file"}


def test_packed_files(spark):
    docx = packed(**{"word/document.xml": '<d xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:t>a</w:t></w:p></w:tc><w:tc><w:p><w:t>b</w:t></w:p></w:tc></w:tr></w:tbl></w:body></d>'})
    rel = '<Relationships><Relationship Id="r1" Target="{}"/></Relationships>'
    pptx = packed(**{"ppt/presentation.xml": '<p xmlns:r="rel"><sldId r:id="r1"/></p>', "ppt/_rels/presentation.xml.rels": rel.format("slides/s.xml"), "ppt/slides/s.xml": "<s><p><t>Head</t></p><tbl><tr><tc><p><t>x</t></p></tc></tr></tbl><p><t>item</t></p></s>"})
    xlsx = packed(**{"xl/workbook.xml": '<w xmlns:r="rel"><sheet name="S" r:id="r1"/><sheet name="H" state="hidden" r:id="r2"/></w>', "xl/_rels/workbook.xml.rels": rel.format("/xl/s.xml"), "xl/sharedStrings.xml": "<s><si><t>name</t></si></s>", "xl/s.xml": '<s><row><c r="A1" t="s"><v>0</v></c><c r="B1"><f>1+1</f><v>2</v></c></row></s>'})
    epub = packed(mimetype="application/epub+zip", **{"META-INF/container.xml": '<c><rootfile full-path="O/b.opf"/></c>', "O/b.opf": '<p><item id="c" href="c.xhtml"/><itemref idref="c"/></p>', "O/c.xhtml": "<html><body><h1>One</h1><p>text</p></body></html>"})
    assert of(files.docx_of, docx) == [("heading", "Head"), ("paragraph", "one\ttwo"), ("table", "a\tb")]
    assert of(files.pptx_of, pptx) == [("heading", "Head"), ("list", "item"), ("table", "x")]
    assert of(files.xlsx_of, xlsx) == [("table", "name\t2"), ("formula", "=1+1 (cached: 2)")]
    assert of(files.epub_of, epub) == [("heading", "One"), ("paragraph", "text")]
    rows = spark.createDataFrame([(1, bytearray(docx)), (2, bytearray(b"no")), (3, bytearray(packed(**{"../x": ""})))], "doc_id long, content binary")
    assert {r.doc_id: r.error for r in files.blocks(rows, "docx", "content").collect()} == {1: None, 2: "malformed_file", 3: "archive_not_safe"}


def test_detect(spark):
    cases = [
        ("a.txt", b"hello", "text", None), ("a.md", b"# x", "markdown", None), ("a.py", b"\xef\xbb\xbfx", "python", None), ("a.txt", b"", None, "empty_file"), ("a.txt", b"a\x00b", None, "binary_extension_mismatch"),
        ("a.bin", b"\x01\x02\x03", None, "unsupported_binary"), ("a.pdf", b"%PDF-1.7", "pdf", None), ("a.txt", b"%PDF-1.7", None, "risky_extension_mismatch"), ("a.json", b' {"a": 1}', "json", None), ("a.json", b"x", None, "malformed_file"),
        ("a.ipynb", b'{"cells": []}', "ipynb", None), ("a.html", b"<!doctype html><html>", "html", None), ("a.xml", b"<?xml version='1.0'?><r/>", "xml", None), ("a.txt", "x".encode("utf-16"), "text", None),
        ("a.docx", packed(**{"word/document.xml": "x"}), "docx", None), ("a.docx", b"x", None, "malformed_file"), ("a.pptx", packed(**{"word/document.xml": "x"}), None, "risky_extension_mismatch"), ("noext", b"plain", "text", None),
    ]
    rows = spark.createDataFrame([(i, p, len(b), bytearray(b)) for i, (p, b, _, _) in enumerate(cases)], "i int, path string, length long, content binary")
    got = [(r.file_type, r.error) for r in files.detect(rows).orderBy("i").collect()]
    assert got == [c[2:] for c in cases]
