from __future__ import annotations

import mimetypes

from pyspark.sql import functions as F

from answerloom.functions import text as X

PATHS = [
    "a.html",
    "dir.with.dots/file",
    "a.tar.gz",
    "A.PDF",
    "x.tgz",
    "file:/tmp/a b/report.docx",
    "https://example.com",
    "https://example.com/a/b.html?x=1#y",
    "http://example.org/page#top.html",
    ".bashrc",
    ".hidden.json",
    "noext",
    "trailing.",
    "weird.unknownext",
    "slides.pptx",
    "c:/x.txt",
    "img.JPEG",
    "data.json.bz2",
]


def test_mime_type_agrees_with_the_standard_library(spark):
    table = mimetypes.MimeTypes(filenames=())
    rows = (
        spark.createDataFrame([(p,) for p in PATHS], "path string")
        .select("path", X.mime_type("path").alias("m"))
        .collect()
    )
    assert {r.path: r.m for r in rows} == {p: table.guess_type(p)[0] for p in PATHS}
    assert spark.range(1).select(X.mime_type(F.lit(None).cast("string"))).first()[0] is None


def test_html_to_text(spark):
    html = (
        "<html><head><title>T</title></head><body><nav>menu</nav><!-- x --><script>if(a<b){}</script>"
        "<h2 class=c>Head &amp; tail</h2><p>One <b>bold</b> word<p>Two<br>lines"
        "<ul><li>first<li>second</ul><table><tr><td>a</td><td>b</td></tr></table></body>"
    )
    got = spark.createDataFrame([(html,), (None,)], "h string").select(X.html_to_text("h")).collect()
    assert got[0][0] == (
        "## Head & tail\n\nOne bold word\n\nTwo\nlines\n\n- first\n- second\n\n| a | b |"
    )
    assert got[1][0] is None


def test_references(spark):
    rows = [("&#8212;&#x27;&eacute;&nbsp;&apos;",), ("&amp;lt; &AMP; &nobody; & &#; &#0;&#1114112;&#xd800;",), ("none",), (None,)]
    got = spark.createDataFrame(rows, "t string").coalesce(1).select(X.decode_references("t")).collect()
    assert [r[0] for r in got] == ["—'é '", "&lt; &AMP; &nobody; & &#; \ufffd\ufffd\ufffd", "none", None]


def test_unreadable_documents_are_null(spark):
    rows = [(b"<p>ok</p>",), (b"\xff\xfe<p>broken</p>",), (b"plain text",), (b"%PDF-1.7",), (None,), (b"",)]
    got = spark.createDataFrame(rows, "b binary").select(X.parse_document("b")).collect()
    assert [r[0] for r in got] == ["ok", None, None, None, None, None]
    why = spark.createDataFrame(rows, "b binary").select(X.why_unreadable("b")).collect()
    assert [r[0] for r in why] == [None, "not UTF-8", "not HTML", "not HTML", "no content", "not HTML"]


def test_sentences(spark):
    text = "See 10.0.0.1 or a@b.co.uk now!  Then?? \nLast one"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, " \n ")], "id int, t string")
    got = X.sentences(df, "t", ["id"]).orderBy("id", "sentence_ix").collect()
    assert [tuple(r) for r in got] == [
        (1, 0, "See 10.0.0.1 or a@b.co.uk now!"),
        (1, 1, "Then??"),
        (1, 2, "Last one"),
    ]
