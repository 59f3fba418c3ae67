"""Visible text of pages: nesting, references, what is left open, and long broken pages."""

import time

import pytest
from pyspark.sql import functions as F

from lattica.sources import html


@pytest.mark.parametrize(
    "page, text",
    [
        ("<nav>a<nav>b</nav>c</nav>d", "d"),
        ("<header><nav>menu</nav>logo</header><p>one</p><p>two</p>", "one two"),
        ("<header>x<nav>y</header>z</nav>w", "z w"),
        ("&copy; &#8364;&#x41; &amp;lt; a&nbsp;b &eacute;", "© €A &lt; a b é"),
        ("<script>if (a < b) '</p>'</script>x<style>p{}</style>y", "x y"),
        ("a<script>never closed", "a"),
        ("a<nav>never closed", "a never closed"),
        ("</nav>a</header>", "a"),
        ("a<!-- <nav> -->b<br/>c<nav/>d</nav>e", "a b c e"),
        ("a\n\t b<b>c</b>", "a b c"),
        ("", ""),
    ],
)
def test_read(page, text):
    assert html.read(page) == text


def test_long_pages():
    began = time.time()
    assert html.read("<nav>x" * 50_000) == " ".join(["x"] * 50_000)
    assert html.read("<nav>x" * 50_000 + "</nav>" * 50_000 + "end") == "end"
    assert html.read("<p>y" * 100_000).count("y") == 100_000
    assert time.time() - began < 10


def test_page_text(spark):
    df = spark.createDataFrame([(1, "<header>h</header>t"), (2, None), (3, "")], "i int, raw string")
    assert [r.t for r in df.select("i", html.page_text(F.col("raw")).alias("t")).orderBy("i").collect()] == ["t", None, ""]
