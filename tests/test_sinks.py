from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrata import schemas
from narrata.sinks import files, keyed
from narrata.sources import landed
from narrata.streaming.landing import land

T0 = dt.datetime(2024, 1, 2, 3, 4, 5, 250000)
ROWS = [
    ("a", "s", 'quote " and, comma', "", 1, T0, None, ["x", "y,z"]),
    ("b", "s", "two\nlines", None, 2, dt.datetime(2024, 1, 1), "flair", []),
    ("c", "s", "\\back é", '"', 3, None, "", None),
]
SCHEMA = T.StructType([f for f in schemas.POSTS if f.name in ("post_id", "subreddit", "title", "selftext", "score", "created_utc", "flair", "tags")])


def rows(spark):
    cols = ("post_id", "subreddit", "title", "selftext", "score", "created_utc", "flair", "tags")
    return spark.createDataFrame(ROWS, T.StructType([SCHEMA[c] for c in cols])).select(*SCHEMA.names)


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "csv")
    files.write_csv(rows(spark), path)
    assert sorted(landed.read_csv(spark, path, SCHEMA).collect()) == sorted(rows(spark).collect())


def test_json_round_trip(spark, tmp_path):
    path = str(tmp_path / "json")
    files.write_json(rows(spark), path)
    assert sorted(landed.read_json(spark, path, SCHEMA).collect()) == sorted(rows(spark).collect())
    files.write_json(rows(spark).limit(1), path)  # overwrites
    assert landed.read_json(spark, path, SCHEMA).count() == 1
    text = spark.read.text(path).first().value
    assert "created_utc" in json.loads(text)


def test_rejects_do_not_stop_the_job(spark, tmp_path):
    path = tmp_path / "landed.json"
    good = {"post_id": "a", "score": 3, "created_utc": 1.0, "title": "é"}
    path.write_text("\n".join([json.dumps(good), '{"post_id": "b", "score": "many"}', "not json", ""]), encoding="utf-8")
    ok, bad = landed.read_landed(spark, str(path), schemas.POST_LANDED)
    assert [(r.post_id, r.score, r.title) for r in ok.collect()] == [("a", 3, "é")]
    assert sorted(r._corrupt_record for r in bad.collect()) == ["not json", '{"post_id": "b", "score": "many"}']


KEYED = "post_id string, seq bigint, created_utc timestamp_ntz, title string"


def test_insert_or_ignore(spark, tmp_path):
    path = str(tmp_path / "posts")
    first = spark.createDataFrame([("a", 1, T0, "first"), ("a", 2, T0, "second"), ("b", 3, T0, "b")], KEYED)
    keyed.save_posts(first, path)
    keyed.save_posts(first, path)
    keyed.save_posts(spark.createDataFrame([("b", 0, T0, "changed"), ("c", 9, T0, "c")], KEYED), path)
    got = sorted((r.post_id, r.title) for r in spark.read.parquet(path).collect())
    assert got == [("a", "first"), ("b", "b"), ("c", "c")]


def test_unique_rows_are_written_where_they_lie(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "posts")
    rows = spark.createDataFrame([("a", 1, T0, "a"), (None, 2, T0, "none"), ("b", 3, T0, "b")], KEYED)
    monkeypatch.setattr(type(rows), "repartition", lambda *a: pytest.fail("moved"))
    keyed.save_posts(rows, path, unique=True)
    keyed.save_posts(spark.createDataFrame([("b", 0, T0, "changed"), ("c", 9, T0, "c"), (None, 0, T0, "again")], KEYED), path, unique=True)
    got = sorted((r.post_id or "", r.title) for r in keyed.read_table(spark, path).collect())
    assert got == [("", "none"), ("a", "a"), ("b", "b"), ("c", "c")]


def test_orphans(spark):
    posts = spark.createDataFrame([("a",)], "post_id string")
    comments = spark.createDataFrame([("1", "a"), ("2", "z")], "comment_id string, post_id string")
    assert [r.comment_id for r in keyed.orphans(comments, posts).collect()] == ["2"]


def test_streamed_landing_equals_batch(spark, tmp_path):
    inbox, path = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in ([("a", 1, T0, "x"), ("b", 2, T0, "y")], [("a", 5, T0, "late"), ("c", 6, T0, "z")]):
        spark.createDataFrame(batch, KEYED).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(KEYED).parquet(inbox)
        land(stream, path, "post_id", [F.asc("seq")], str(tmp_path / "cp")).awaitTermination()
    got = sorted((r.post_id, r.title) for r in spark.read.parquet(path).collect())
    assert got == [("a", "x"), ("b", "y"), ("c", "z")]


def test_missing_vectors(spark):
    posts = spark.createDataFrame([("a",), ("b",)], "post_id string")
    vectors = spark.createDataFrame([("a", [1.0])], schemas.VECTORS)
    assert [r.post_id for r in landed.without_vector(posts, vectors).collect()] == ["b"]


def _posts(spark, ids, title="t"):
    return spark.createDataFrame([(i, n, T0, title) for n, i in enumerate(ids)], KEYED)


def test_two_writers_never_store_a_key_twice(spark, tmp_path):
    """Two inserts that started from the same version: the second to finish drops what the first has stored."""
    path, order = str(tmp_path / "posts"), [F.asc("seq")]
    keyed.insert_or_ignore(_posts(spark, ["a", "b"]), path, "post_id", order, parts=3)
    base = keyed.current(spark, path)
    late = keyed._write(spark, path, _posts(spark, ["c", "d", None], "late"), "post_id", base.parts)  # not yet committed
    assert keyed.read_table(spark, path).count() == 2
    keyed.insert_or_ignore(_posts(spark, ["d", "e", "a", None], "early"), path, "post_id", order)
    version = keyed.add_batch(spark, path, "post_id", base, late, base.parts, spark.createDataFrame([], KEYED).schema)
    got = sorted(((r.post_id, r.title) for r in keyed.read_table(spark, path).collect()), key=repr)
    assert got == sorted([("a", "t"), ("b", "t"), ("c", "late"), ("d", "early"), ("e", "early"), (None, "early")], key=repr)
    assert version.number == 3 and late not in version.batches and len(version.batches) == 3


def test_two_first_writers_with_other_parts(spark, tmp_path):
    path, order = str(tmp_path / "posts"), [F.asc("seq")]
    late = keyed._write(spark, path, _posts(spark, ["a", "b"], "late"), "post_id", 5)
    keyed.insert_or_ignore(_posts(spark, ["b", "c"], "early"), path, "post_id", order, parts=2)
    keyed.add_batch(spark, path, "post_id", keyed.Version(), late, 5, spark.createDataFrame([], KEYED).schema)
    assert sorted((r.post_id, r.title) for r in keyed.read_table(spark, path).collect()) == [("a", "late"), ("b", "early"), ("c", "early")]
    assert keyed.current(spark, path).parts == 2


def test_rows_without_a_key_are_one(spark, tmp_path):
    path = str(tmp_path / "posts")
    for _ in range(3):
        keyed.save_posts(_posts(spark, [None, "a", None]), path)
    assert sorted(((r.post_id, r.seq) for r in keyed.read_table(spark, path).collect()), key=repr) == sorted([(None, 0), ("a", 1)], key=repr)


def test_inserts_read_touched_parts_only(spark, tmp_path):
    path, order = str(tmp_path / "posts"), [F.asc("seq")]
    for k in range(3):
        keyed.insert_or_ignore(_posts(spark, [f"{k}-{i}" for i in range(200)]), path, "post_id", order, parts=8)
    version = keyed.current(spark, path)
    parts = {r.post_id: r["key_part"] for r in _posts(spark, ["1-7", "new"]).select("post_id", keyed._part_of("post_id", 8)).collect()}
    assert keyed.touched(spark, path, _posts(spark, ["1-7"]), "post_id", version.batches, 8) == [(version.batches[1], parts["1-7"])]
    many = keyed.touched(spark, path, _posts(spark, [f"new-{i}" for i in range(8)]), "post_id", version.batches, 8)
    assert len(many) <= 3  # of 24, by chance
    all_of_one = keyed.touched(spark, path, _posts(spark, [f"2-{i}" for i in range(200)]), "post_id", version.batches[2:], 8)
    assert len(all_of_one) == 8
    keyed.insert_or_ignore(_posts(spark, []), path, "post_id", order)
    assert keyed.read_table(spark, path).count() == 600 and keyed.read_table(spark, str(tmp_path / "none")) is None


def test_csv_records_cross_splits(spark, tmp_path):
    """One file in splits of a few bytes, with records that span many of them, quotes and line breaks everywhere."""
    rng = random.Random(4)
    texts = ["", '"', "\n", "a,b", 'say ""', "x\r\ny", "\r", "long " * 40 + "\n" * 30, '\n"\n', None, "plain", "é "]
    made = [(f"p{i}", rng.choice(texts), "".join(rng.choice(["a", "\n", '"', ",", "\r", "b "]) for _ in range(rng.randint(0, 60))), i) for i in range(150)]
    schema = T.StructType([f for f in schemas.POSTS if f.name in ("post_id", "title", "selftext", "score")])
    path = str(tmp_path / "csv")
    files.write_csv(spark.createDataFrame(made, schema).coalesce(1), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("64", "1000", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            records = landed.csv_records(spark, path, "post_id,title,selftext,score")
            assert records.count() == len(made)
            assert sorted(landed.read_csv(spark, path, schema).collect(), key=repr) == sorted(spark.createDataFrame(made, schema).collect(), key=repr)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    with pytest.raises(Exception, match="header"):
        landed.read_csv(spark, path, T.StructType(schema.fields[::-1])).collect()


def test_csv_of_others(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'post_id,title\r\n1,"two\r\nlines"\r\n2,\r\n3,""')
    schema = T.StructType([schemas.POSTS["post_id"], schemas.POSTS["title"]])
    got = sorted(landed.read_csv(spark, str(tmp_path), schema).collect())
    assert [tuple(r) for r in got] == [("1", "two\r\nlines"), ("2", None), ("3", "")]
