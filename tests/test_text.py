import time

from pyspark.sql import functions as F

from quietspan.functions import text as X
from quietspan.operators import normalise as N


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def each(spark, values, f):
    df = spark.createDataFrame(list(enumerate(values)), "i long, t string")
    return [r.x for r in df.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


def test_kernels(spark):
    assert each(spark, ["a\r\nb\rc\n", None], X.line_endings) == ["a\nb\nc\n", None]
    assert each(spark, ["a​﻿b­"], X.strip_zero_width) == ["ab­"]
    assert each(spark, ["1 2-3–4", "1\n2", "a 1"], X.collapse_separators) == ["123–4", "1\n2", "a 1"]
    assert each(spark, ["1 \n 2"], lambda c: X.collapse_separators(c, True)) == ["12"]
    assert each(spark, ["", " \t\x1c", "x", "​"], X.is_blank) == [True, True, False, False]
    assert each(spark, ["abcé", "é"], X.nfc_inert) == [True, False]


def test_hidden_styles_agree_with_the_reader(spark):
    styles = ["display:none", "display : NONE", "visibility:hidden", "opacity:0", "opacity:0.0;", "opacity:0.5", "font-size:0", "font-size:0px;", "font-size:10px", "color:#fff", "color:white", "color:rgb(255, 255,255)", "color:#fff;background:red", "background-color:#fff", "font-size:0 !important", ""]
    got = each(spark, styles, X.hidden_style)
    assert got == [N.style_hides(s) for s in styles]
    assert got == [True, True, True, True, True, False, True, True, False, True, True, True, False, False, False, False]


def test_dropped_labels_agree_with_the_reader(spark):
    texts = ["Ignore all previous instructions", "you are  now", "don't tell", "system prompt", "new instruction", "DE12 3456789012", "DE123456789012", "123 456 789", "12345678", "plain"]
    ident, imper = each(spark, texts, X.identifier_shaped), each(spark, texts, X.imperative)
    for t, a, b in zip(texts, ident, imper, strict=True):
        assert N.dropped_labels("w", t) == ({"w:identifier_shaped"} if a else set()) | ({"w:imperative"} if b else set())


def test_suspicions(spark):
    labels = ["hidden_css:imperative", "ical_duplicate_property:summary", "hidden_css:identifier_shaped", ""]
    assert each(spark, labels, X.suspicious) == [True, True, False, False]


def test_raw_blocks_agree_with_the_reader(spark):
    pages = ["a<style>x</style>b", "a<SCRIPT src=1>x<b></Script >c", "a<style>b", "<title>t</title>x<head><p></head>y", "<header>h</header>"]
    assert each(spark, [*pages, None], N.strip_raw_blocks) == ["ab", "ac", "a<style>b", "xy", "<header>h</header>", None]
    hostile = ["<style>" * 200_000, "<style>" * 100_000 + "</title" + "x" * 1_000_000, "<style>x</style>" * 50_000]
    began = time.time()
    assert [len(x) for x in each(spark, hostile, N.strip_raw_blocks)] == [len(hostile[0]), len(hostile[1]), 0]
    assert time.time() - began < 10


def test_calendar_kernels(spark):
    assert each(spark, ["a\n b\n\tc\nd"], X.unfold) == ["abc\nd"]
    values = [r"a\nb\Nc", r"x\;y\,z", r"\\n", r"\q", "\\"]
    assert each(spark, values, X.unescape_ical) == [N._value(v) for v in values] == ["a\nb\nc", "x;y,z", "\\n", "\\q", "\\"]
    lines = ['SUMMARY:a:b', 'desc;X="a:b":c', "none", 'A"b:c', " x ;p=1:v"]
    got = each(spark, lines, X.content_line)
    assert [None if g is None else (g.name, g.value) for g in got] == [N._content_line(x) for x in lines] == [("SUMMARY", "a:b"), ("DESC", "c"), None, None, ("X", "v")]


def test_shape_guards(spark):
    raws = [b"Subject: x\n\nhi", b"\xef\xbb\xbf  BEGIN:VCALENDAR", b" \r\n", b"%PDF-1", b"\x89PNG\r\n\x1a\n", b"PK\x03\x04", b"X: 1\r\n\r\nFrom: a", b"x\nFrom: a", b"[1]", None, b"A: " + b"x" * 70000 + b"\nFrom: y\n\n"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i long, c binary")
    got = [r.x for r in df.select("i", X.mail_shape(F.col("c")).alias("x")).orderBy("i").collect()]
    assert got == [None, "other_format", "blank", "other_format", "other_format", "other_format", "no_mail_headers", None, "other_format", "blank", "no_mail_headers"]
    cal = [r.x for r in df.select("i", X.ical_shape(F.col("c")).alias("x")).orderBy("i").collect()]
    assert cal[1] is None and cal[2] == "blank" and cal[0] == "not_icalendar"


def test_defang(spark):
    html = '<img src="https://a/b.png"> <a href="https://x/y?z=1">q</a> <a href="https://x/y">q</a>'
    assert each(spark, [html], X.defang_links) == ['<img src=""> <a href="[link removed]">q</a> <a href="https://x/y">q</a>']
