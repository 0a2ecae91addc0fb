"""Small tables with everything that may go wrong in them."""

from __future__ import annotations

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, d bigint, f string, row string, score string, rank int, spans string, at bigint, v string, rid string, t string, y string"
LONG = " ".join(f"w{i % 977} long" for i in range(30_000))
ROWS = [
    (1, "The quick brown fox jumps. over the lazy dog"),
    (2, None),
    (None, "a text without an id"),
    (None, None),
    (3, ""),
    (4, " \t\n "),
    (5, "one"),
    (6, LONG),
    (6, LONG),
    (7, "The quick brown fox jumps. over the lazy dog"),
    (8, "ÄÖ ▁ß  日本語 😀\x00"),
    (9, "word " * 120),
]


def documents(spark, rows=ROWS):
    full = [(i, t, None, "src", len(t or ""), 1, "f", "row", "s", 2, "x", 3, "v", "rid", "t", "y") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def labels(spark, rows=((1, 1, 0), (5, 0, 1), (7, 1, 0), (6, 0, 1), (None, 1, 1), (9, None, None))):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")
