"""Text functions against the same rules written with Python's re."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from narrata.functions import text as tx
from narrata.functions.stopwords import ENGLISH_STOP_WORDS

# Inputs and what cleaning leaves of them, worked out by hand.
CLEANED = {
    "See [Link](http://a.b/c) now": "see link now",
    "x [rel](/r/foo) y": "x y",
    "[deleted]": "deleted",
    "her/him or you/me R/Politics u/Bob": "he or yo",
    "l1\n\n\nl2\nl3": "l1\nl2\nl3",
    "\u2003nbsp\u00a0em line\x1csep ": "nbsp\u00a0em line\x1csep",
    "中文 r/中文 測試": "中文 測試",
    "é u/éx": "é",
    "ΣΟΦΟΣ": "σοφος",
    "www.x.y z": "z",
    "[a\nb](c)": "a\nbc",
    "ur/abc/def": "",
    "  ": "",
    "\n": "",
    "`code` *bold* (par)": "code bold par",
    "httpx http": "http",
    "": "",
    "a\n\n b\n": "a b",
    "https://a.b)[c](d) e": "e",
    "\x1f x \x85": "x",
}
EDGES = list(CLEANED)


def test_cleaning_gives_the_expected_texts(spark):
    df = spark.createDataFrame([(t,) for t in [*EDGES, None]], "t string")
    for row in df.select("t", tx.clean_text(F.col("t")).alias("c")).collect():
        assert row.c == ("" if row.t is None else CLEANED[row.t]), repr(row.t)


def test_guards_change_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select(F.col("html").alias("text"))
    text = F.lower("text")
    for pattern in (tx.URL, tx.MARKDOWN_LINK):
        text = F.regexp_replace(text, pattern, "")
    text = F.regexp_replace(F.regexp_replace(text, tx.LOOSE_MARKDOWN, ""), r"\n\n+", "\n")
    for pattern in (tx.COMMUNITY_MENTION, tx.USER_MENTION):
        text = F.regexp_replace(text, pattern, "")
    unguarded = tx.strip(F.regexp_replace(text, f"{tx.SPACE}{{2,}}", " "))
    both = docs.union(pages).select(tx.clean_text(F.col("text")).alias("a"), unguarded.alias("b"))
    assert both.where("a != b").count() == 0


def test_strip_blank_and_tokens(spark):
    df = spark.createDataFrame([(t,) for t in EDGES], "t string")
    t = F.col("t")
    for row in df.select("t", tx.strip(t).alias("s"), tx.is_blank(t).alias("b"), tx.tokens(t).alias("w")).collect():
        assert row.s == row.t.strip()
        assert row.b == (row.t.strip() == "")
        assert row.w == re.findall(r"\b\w\w+\b", row.t.lower())


def test_space_characters_are_pythons():
    assert set(tx.SPACE_CHARACTERS) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_times(spark):
    df = spark.createDataFrame([(1_700_000_000.0,), (1_700_000_000.25,)], "s double")
    at = tx.epoch_to_timestamp(F.col("s"))
    rows = df.select(at.alias("t"), tx.iso_text(at).alias("i"), tx.parse_iso(tx.iso_text(at)).alias("p")).collect()
    for row, s in zip(rows, (1_700_000_000, 1_700_000_000.25)):
        expected = dt.datetime.fromtimestamp(s, dt.timezone.utc).replace(tzinfo=None)
        assert row.t == row.p == expected
        assert row.i == expected.isoformat()
    bad = spark.createDataFrame([("not a time",)], "s string").select(tx.parse_iso(F.col("s")).alias("p")).first()
    assert bad.p is None


def test_author_and_post_text(spark):
    df = spark.createDataFrame([(None, None, "b"), ("x", "a", None)], "author string, title string, body string")
    rows = df.select(
        tx.author_name(F.col("author")).alias("a"), tx.author_name(F.col("author"), True).alias("n"),
        tx.post_text(F.col("title"), F.col("body")).alias("t"),
    ).collect()
    assert [tuple(r) for r in rows] == [(None, "None", " b"), ("x", "x", "a ")]


def test_stop_words_are_sparks(spark):
    assert list(ENGLISH_STOP_WORDS) == StopWordsRemover.loadDefaultStopWords("english")
