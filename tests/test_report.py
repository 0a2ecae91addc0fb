from __future__ import annotations

import datetime as dt

from narrata.operators import summary, suspicion
from narrata.plans import jobs
from narrata.plans.report import build_report
from narrata.settings import ReportSettings

S = ReportSettings()
SCHEMA = "post_id string, seq bigint, author string, title string, selftext string, created_utc timestamp_ntz, cluster_label int"
T0 = dt.datetime(2024, 1, 1)


def post(i, label, author="ann", title="solar panels", body="power", minutes=0):
    return (f"p{i:03d}", i, author, title, body, T0 + dt.timedelta(minutes=minutes), label)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_flags(spark):
    rows = [post(i, 0, f"u{i}", minutes=i) for i in range(3)]  # 2 minutes: burst
    rows += [post(10, 1, "x"), post(11, 1, "y", minutes=60)]  # exactly an hour: none
    rows += [post(20 + i, 2, "bot", minutes=100 * i) for i in range(5)]  # 5 by one author
    rows += [post(30 + i, 3, "four", minutes=100 * i) for i in range(4)]  # 4 are allowed
    rows += [post(40, 4, None)]  # one post
    rows += [post(50, -1), post(51, None)]
    got = {r.cluster_label: (r.size, r.burst, r.concentrated, r.flagged) for r in suspicion.cluster_flags(frame(spark, rows), S).collect()}
    assert got == {
        0: (3, True, False, True), 1: (2, False, False, False), 2: (5, False, True, True),
        3: (4, False, False, False), 4: (1, True, False, True),
    }


def test_flagged_users_count_noise_but_not_null(spark):
    rows = [post(1, 0, "a"), post(2, -1, "a"), post(3, 0, "b"), post(4, None, "b"), post(5, 1, None), post(6, 2, None), post(7, 1, "c"), post(8, 2, "c")]
    df = frame(spark, rows)
    assert sorted(r.author for r in suspicion.flagged_users(df, S).collect()) == ["a", "c"]
    assert [r.author for r in suspicion.flagged_users(df, ReportSettings(exclude_noise=True)).collect()] == ["c"]
    assert tuple(suspicion.headline(df, S).first()) == (3, 8, 2)


def test_keywords(spark):
    rows = [post(i, 0, title=f"The Zebra word{i:02d}", body="zebra Apple's x") for i in range(12)]
    rows += [post(50, 1, title="the and of", body="")]  # nothing but stop words
    got = {r.cluster_label: list(r.keywords) for r in build_report(frame(spark, rows), S)["clusters"].collect()}
    assert got[0] == ["apple", *[f"word{i:02d}" for i in range(8)], "zebra"]
    assert got[1] == []


def test_record(spark):
    rows = [post(i, 0, f"u{i % 4}", title=f"t{i}", minutes=1440 * (i % 2)) for i in range(9)]
    (r,) = build_report(frame(spark, rows), S)["clusters"].collect()
    assert r.sample_text == "t0\nt1\nt2\nt3\nt4"
    assert list(r.top_authors) == ["u0", "u1", "u2"]
    assert [(d.day, d.n) for d in r.timeline] == [(dt.date(2024, 1, 1), 5), (dt.date(2024, 1, 2), 4)]
    assert len(r.sample_posts) == 5 and set(r.sample_posts) <= {f"t{i}" for i in range(9)}
    again = build_report(frame(spark, rows[::-1]), S)["clusters"].first()
    assert again == r


def test_no_labels_gives_an_empty_report(spark):
    out = build_report(frame(spark, [post(1, None), post(2, None)]), S)
    assert out["clusters"].count() == 0 and out["flagged_users"].count() == 0
    assert tuple(out["headline"].first()) == (0, 2, 0)


def test_sizes_and_noise_add_up(spark):
    rows = [post(i, [-1, 0, 1, None][i % 4]) for i in range(23)]
    df = frame(spark, rows)
    sizes = sum(r.size for r in summary.sizes(df).collect())
    assert sizes + df.where("cluster_label = -1").count() == df.where("cluster_label is not null").count()


def test_label_statistics(spark):
    labels = [(0, x) for x in [-1] * 7 + [0] * 3 + [1] * 5] + [(1, -1)]
    got = jobs.label_statistics(spark.createDataFrame(labels, "run int, cluster_label int"), ["run"]).orderBy("run").collect()
    assert tuple(got[0]) == (0, 2, 7, 7, 5.0, 4.0)
    assert tuple(got[1]) == (1, 0, 1, 1, 1.0, None)


def test_labels_attach_by_key(spark):
    posts = spark.createDataFrame([("a",), ("b",)], "post_id string")
    labels = spark.createDataFrame([("b", 3), ("gone", 1)], "post_id string, cluster_label int")
    assert sorted((r.post_id, r.cluster_label) for r in jobs.attach_labels(posts, labels).collect()) == [("a", None), ("b", 3)]
