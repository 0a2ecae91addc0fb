"""Archives, their records, and the merged capture histories."""

from __future__ import annotations

import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from narrata.llm import warc

BIG = "<p>ä</p>" * 200
ROWS = [
    (1, "http://b.example.com/x", BIG),
    (2, "http://a.example.com/?q=1", BIG),
    (2, "http://a.example.com/?q=1", BIG),
    (3, None, "small"),
    (4, "no scheme", "small"),
    (5, "http://c.org/a b\r\nWARC/1.1\t%", None),
    (6, "http://c.org", ""),
    (7, "http://d.org/", "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 60),
    (8, "http://B.example.com/X", "y" * 3_000_000),
    (None, "http://e.org/", BIG),
    (None, "http://e.org/", "z" * 1000),
    (None, "http://e.org/", "z" * 1000),
    (9, "http://e.org/", "w" * 999),
    (10, "http://e.org/", "w" * 999),
    (11, "http://e.org/", "v" * 1000),
    (12, "http://e.org/", "v" * 1000),
]


def pages(spark, rows=ROWS):
    full = [(*r, "clash", 1, "d", "k", "h", "r") for r in rows]
    return spark.createDataFrame(full, "page_id bigint, url string, html string, id string, bytes int, digest string, key string, head string, payload string").repartition(3)


def expected(rows):
    groups = {}
    for i, _, html in rows:
        if len((html or "").encode()) >= 1000 and i is not None:
            groups[html] = max(groups.get(html, i), i)
    out = []
    for i, _, html in rows:
        body, last = (html or "").encode(), groups.get(html)
        to = last if last is not None and (i is None or i < last) else None
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


@pytest.mark.parametrize("archive_bytes", [1, 5000, 1 << 25])
def test_round_trip(spark, tmp_path, archive_bytes):
    warc.write_archives(pages(spark), str(tmp_path / "w"), "page_id", "url", "html", archive_bytes=archive_bytes)
    rows = warc.merge_runs(warc.capture_runs(spark, str(tmp_path / "w")), range_rows=4).collect()
    assert sorted(((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=repr) == expected(ROWS)
    ordered = sorted(rows, key=lambda r: (r.part, r.place))
    keys = [(r.url_key, r.captured_at, r.id is not None, r.id or 0) for r in ordered]
    assert keys == sorted(keys) and len({r.part for r in rows}) > 1
    assert {r.url for r in rows if r.id == 5} == {"http://c.org/a%20b%0D%0AWARC/1.1%09%"}
    for r in rows:  # every entry leads to its record
        with gzip.open(r.archive.removeprefix("file:"), "rb") as data:
            data.seek(r.offset)
            [(header, _, _, block)] = warc.read_records(io.BytesIO(data.read(r.length)))
            assert header["warc-type"] == r.record_type and header["content-length"] == str(len(block))


def test_decisions_do_not_depend_on_the_way(spark, tmp_path, monkeypatch):
    """Frequent payloads are broadcast, rare ones joined: the result is the same."""
    for n, share in enumerate((1, 10**9)):
        monkeypatch.setattr(warc, "HOT_SHARE", share)
        rows = warc._decided(pages(spark).select(F.col("page_id").alias("id"), "url", F.lit(None).cast("timestamp_ntz").alias("at"), F.coalesce("html", F.lit("")).alias("payload"))).collect()
        assert sorted(((r.id, r.refers) for r in rows), key=repr) == sorted(((e[0], e[4]) for e in expected(ROWS)), key=repr)


def test_loser_tree():
    rng = random.Random(5)
    for k in (0, 1, 2, 3, 7, 16, 33):
        lists = [sorted(rng.randrange(50) for _ in range(rng.choice([0, 1, 5, 30]))) for _ in range(k)]
        merged = [(lists[s][i], s, i) for s, i in warc.LoserTree(lists)]
        assert merged == sorted((v, s, i) for s, values in enumerate(lists) for i, v in enumerate(values))


def test_damaged_archives_are_named(spark, tmp_path):
    good = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:narrata:capture:1>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: 40\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n" % hashlib.sha1(b"hi").hexdigest().encode()
    (tmp_path / "plain.warc").write_bytes(good)
    assert warc.capture_runs(spark, str(tmp_path)).first().payload_bytes == 2
    for bad in (good.replace(b"hi\r\n", b"ho\r\n"), good[:-6], b"x" + good):
        (tmp_path / "plain.warc").write_bytes(bad)
        with pytest.raises(Exception, match="plain.warc"):
            warc.capture_runs(spark, str(tmp_path)).collect()


def test_no_pages(spark):
    assert warc.capture_histories(pages(spark, []), "page_id", "url", "html").collect() == []


def test_url_keys():
    assert warc.url_key("http://a.B.com/Path?q") == "com,b,a)/path?q" and warc.url_key("https://x.org") == "org,x)/"
    assert warc.url_key(None) == "" and warc.url_key("Odd") == "odd"
