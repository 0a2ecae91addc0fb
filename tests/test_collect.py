from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from narrata import schemas
from narrata.operators import collect, enrich, tags
from narrata.plans import jobs
from narrata.settings import CollectSettings

POST = "post_id string, subreddit string, author string, title string, selftext string, score int, num_comments int, " \
       "created_utc double, flair string, url string, listing string, listing_rank int"
DAY = 86_400.0
NOW = 1_700_000_000.0


def post(i, community="politics", score=50, n=50, age=1, listing="top", rank=None, title="Title", body="Body", author="ann", flair=None):
    return (i, community, author, title, body, score, n, NOW - age * DAY, flair, "http://u", listing, rank)


def settings(**kw):
    return CollectSettings(**{"as_of": "2023-11-14 22:13:20", **kw})


def test_top_listing_takes_the_best_of_the_last_month(spark):
    rows = [post(f"p{i}", score=i) for i in range(20)] + [post("old", score=999, age=40), post("else", "cats", score=999)]
    rows += [post("c1", "conspiracy", score=1)]
    got = collect.top_listing(spark.createDataFrame(rows, POST), settings(top_limit=3)).collect()
    assert sorted((r.subreddit, r.listing_rank, r.post_id) for r in got) == [
        ("conspiracy", 1, "c1"), ("politics", 1, "p19"), ("politics", 2, "p18"), ("politics", 3, "p17"),
    ]


def test_top_listing_breaks_ties_by_id(spark):
    rows = [post(f"p{i}", score=7) for i in range(9)]
    got = collect.top_listing(spark.createDataFrame(rows, POST), settings(top_limit=4)).collect()
    assert sorted((r.listing_rank, r.post_id) for r in got) == [(1, "p0"), (2, "p1"), (3, "p2"), (4, "p3")]


def test_listings_without_limits_are_one_pass(spark):
    rows = [post(f"p{i}", score=i, listing="hot" if i % 3 else "top", rank=i, age=i * 4) for i in range(12)]
    rows += [post("x", listing=None), post("y", listing="new", rank=1), post("z", listing="hot"), post("w", None, score=None), post("v", "cats")]
    df = spark.createDataFrame(rows, POST)
    for s in (settings(top_limit=None, hot_limit=None), settings(top_limit=None, hot_limit=None, communities=None, as_of=None)):
        got = collect.listings(df, s)
        top = collect.top_listing(df, s).withColumn("_pos", F.lit(0))
        apart = top.unionByName(collect.hot_listing(df, s).withColumn("_pos", F.lit(1)))
        assert got.schema["listing_rank"].dataType == apart.schema["listing_rank"].dataType
        assert sorted(map(repr, got.drop("seq").collect())) == sorted(map(repr, apart.drop("_pos").collect()))
        assert len({r.seq >> 32 for r in got.where("post_id in ('p0', 'p1')").collect()}) == 2
        assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_first_seen_row_decides_even_when_it_fails(spark):
    rows = [
        post("a", score=5, listing="top"), post("a", score=500, listing="hot", rank=1),  # seen below the thresholds first
        post("b", score=500, listing="top"), post("b", score=5, listing="hot", rank=2),
        post("c", score=10, n=10, listing="hot", rank=3), post("d", score=10, n=9, listing="hot", rank=4),
    ]
    s = settings()
    kept = collect.select_posts(collect.listings(spark.createDataFrame(rows, POST), s), s).collect()
    assert sorted((r.post_id, r.score, r.listing) for r in kept) == [("b", 500, "top"), ("c", 10, "hot")]
    assert all(r.title == "Title" for r in kept)


def test_selecting_twice_changes_nothing(spark):
    s = settings()
    rows = [post(f"p{i % 7}", score=10 + i, listing="hot", rank=i) for i in range(30)]
    once = collect.select_posts(collect.listings(spark.createDataFrame(rows, POST), s), s)
    assert sorted(once.collect()) == sorted(collect.select_posts(once, s).collect())


def test_order_is_community_then_top_then_hot(spark):
    rows = [post("h", "politics", listing="hot", rank=1), post("t", "politics"), post("w", "worldnews"), post("c", "conspiracy", listing="hot", rank=9)]
    s = settings()
    got = collect.listings(spark.createDataFrame(rows, POST), s).orderBy("seq").collect()
    assert [r.post_id for r in got] == ["t", "h", "c", "w"]


COMMENT = "comment_id string, post_id string, subreddit string, author string, body string, score int, created_utc double, " \
          "parent_id string, comment_seq int"


def comment(i, p, body="some words", score=1, seq=0, author="bob"):
    return (i, p, None, author, body, score, NOW, f"t3_{p}", seq)


def test_comments_are_cut_per_post_and_follow_kept_posts(spark):
    rows = [comment(f"a{i:03d}", "a", seq=i) for i in range(70)] + [comment("b0", "b"), comment("x0", "gone")]
    posts = spark.createDataFrame([("a", "politics"), ("b", "worldnews")], "post_id string, subreddit string")
    got = collect.comments_of_posts(spark.createDataFrame(rows, COMMENT), posts, settings()).collect()
    assert sorted(r.comment_id for r in got) == [f"a{i:03d}" for i in range(50)] + ["b0"]
    assert {r.subreddit for r in got if r.post_id == "b"} == {"worldnews"}


def test_top_comments(spark):
    rows = [comment(f"c{i:02d}", "a", "x" * (i + 1), score=i - 2, seq=i) for i in range(15)]
    rows += [comment("d1", "a", "[deleted]", score=9999), comment("d2", "a", "[removed]", score=9999), comment("n1", "a", None, score=3)]
    rows += [comment("t2", "t", "same", 5), comment("t1", "t", "also", 5)]
    projected = collect.project_comments(spark.createDataFrame(rows, COMMENT), settings(), "2024-01-01 00:00:00")
    posts = spark.createDataFrame([("a",), ("t",), ("none",)], "post_id string")
    got = {r.post_id: r for r in enrich.with_comment_text(enrich.attach_top_comments(posts, projected)).collect()}
    expected = sorted(((i - 2) * math.log1p(i + 1), f"{'x' * (i + 1)}") for i in range(15))[::-1][:10]
    assert list(got["a"].top_comments) == [b for _, b in expected]
    assert list(got["t"].top_comments) == ["also", "same"]  # equal score: by comment id
    assert list(got["none"].top_comments) == [] and got["none"].comment_text == ""


def test_projection_types(spark):
    s = settings(literal_none_author=True)
    raw = spark.createDataFrame([post("a", author=None)], POST).withColumn("seq", F.lit(1))
    out = collect.project_posts(raw, s, "2024-01-01 00:00:00")
    assert out.first().author == "None"
    types = {f.name: f.dataType for f in out.schema}
    assert all(types[f.name] == f.dataType for f in schemas.POSTS if f.name in types)


def test_collection_end_to_end(spark):
    posts = [post("a", title="A Hoax http://x", body=""), post("a", listing="hot", rank=1), post("b", "conspiracy", score=2)]
    comments = [comment("c1", "a", "[deleted]", 50), comment("c2", "a", "Good (point)", 2), comment("c3", "b", "lost")]
    kept, said = jobs.collect_posts(
        spark.createDataFrame(posts, POST), spark.createDataFrame(comments, COMMENT), settings(), "2024-01-01 00:00:00"
    )
    (row,) = kept.collect()
    assert (row.post_id, row.title, list(row.top_comments)) == ("a", "a hoax", ["good point"])
    assert list(row.tags) == ["conspiracy", "political", "url_only"]
    assert sorted((r.comment_id, r.subreddit, r.raw_body) for r in said.collect()) == [
        ("c1", "politics", "[deleted]"), ("c2", "politics", "Good (point)"),
    ]


TAGGED = "subreddit string, author string, title string, selftext string, flair string, num_comments int, score int"


@pytest.mark.parametrize("term", tags.MISINFORMATION_TERMS)
def test_misinformation_terms(spark, term):
    _check(spark, ("x", "a", f"About {term.upper()}!", "t", None, 50, 50), ["potential_misinfo"])


@pytest.mark.parametrize("term", tags.CONSPIRACY_TERMS)
def test_conspiracy_terms(spark, term):
    _check(spark, ("x", "a", "t", f"the {term}.", None, 50, 50), ["conspiracy"])


@pytest.mark.parametrize(
    ("row", "expected"),
    [
        (("Conspiracy", "a", "hoax", "t", None, 50, 50), ["conspiracy", "conspiracy"]),
        (("x", "a", "t", "t", None, 300, 1000), []),
        (("x", "a", "t", "t", None, 301, 0), ["high_engagement"]),
        (("x", "a", "t", "t", None, 0, 1001), ["high_engagement"]),
        (("x", "a", "t", "t", None, 4, 4), ["low_engagement"]),
        (("x", "a", "t", "t", None, 5, 4), []),
        (("x", "[Deleted]", "t", "t", None, 50, 50), ["deleted_author"]),
        (("x", "a", "t", "t", "A Joke", 50, 50), ["likely_satire"]),
        (("x", "a", "t", "t", "academic", 50, 50), ["political"]),
        (("Politics", "a", "t", "t", None, 50, 50), ["political"]),
        (("x", "a", "t", " " + "y" * 1000 + " ", None, 50, 50), []),
        (("x", "a", "t", "y" * 1001, None, 50, 50), ["theory_drop"]),
        (("x", "a", "t", " \n", None, 50, 50), ["url_only"]),
        ((None, None, None, None, None, 50, 50), ["url_only"]),
    ],
)
def test_tag_rules(spark, row, expected):
    _check(spark, row, expected)


def _check(spark, row, expected):
    assert list(tags.with_tags(spark.createDataFrame([row], TAGGED)).first().tags) == expected
