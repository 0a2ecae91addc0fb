from __future__ import annotations

import numpy as np

from narrata.operators import vectors
from narrata.plans import jobs
from narrata.settings import Settings

POSTS = "post_id string, comment_text string"


def _by_id(df, column="embedding"):
    return {r.post_id: np.array(r[column]) for r in df.collect()}


def test_stored_vectors_are_reused(spark, tmp_path):
    path = str(tmp_path / "v")
    first = spark.createDataFrame([("a", "solar power plant"), ("b", "wind power"), ("n", ""), ("s", "the and")], POSTS)
    one = _by_id(vectors.embed_posts(first, path, 64))
    assert set(one) == {"a", "b"}  # no text, no vector
    assert all(abs(np.linalg.norm(v) - 1) < 1e-6 for v in one.values())
    more = spark.createDataFrame([("a", "changed text"), ("c", "solar power plant")], POSTS)
    two = _by_id(vectors.embed_posts(more, path, 64))
    assert set(two) == {"a", "b", "c"}
    assert np.array_equal(one["a"], two["a"])  # not embedded again
    assert np.allclose(two["c"], two["a"])  # new vectors use the stored document frequencies
    three = _by_id(vectors.embed_posts(more, path, 64, overwrite=True))
    assert set(three) == {"a", "c"}


def test_caller_supplied_encoder(spark, tmp_path):
    def factory():
        return lambda texts: np.array([[len(t), t.count("a")] for t in texts], float)

    posts = spark.createDataFrame([("a", "banana"), ("b", "xyz")], POSTS)
    got = _by_id(vectors.embed_posts(posts, str(tmp_path / "e"), encoder=factory))
    assert {k: v.tolist() for k, v in got.items()} == {"a": [6.0, 3.0], "b": [3.0, 0.0]}


def test_reduction_keeps_the_distances_of_a_direct_decomposition(spark):
    rng = np.random.default_rng(3)
    x = np.hstack([rng.normal(size=(40, 6)) * [1, 5, 2, 1, 1, 3], np.full((40, 1), 4.0)])  # one constant column
    df = spark.createDataFrame([(f"{i:02d}", r.tolist()) for i, r in enumerate(x)], "post_id string, embedding array<float>")
    got = _by_id(vectors.reduce_vectors(df, 3), "vec")
    got = np.array([got[k] for k in sorted(got)])
    z = x[:, :6].astype(np.float32).astype(float)
    z = (z - z.mean(0)) / z.std(0, ddof=1)
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    want = (u * s)[:, :3]

    def distances(m):
        return np.sqrt(((m[:, None] - m[None]) ** 2).sum(-1))

    assert np.allclose(distances(got), distances(want), atol=1e-9)


def test_run_stages(spark, tmp_path):
    """Collect with clustering, then report alone from the saved tables."""
    rng = np.random.default_rng(5)
    words = [["solar", "panel", "roof", "sun"], ["ballot", "vote", "poll", "senate"]]
    posts, comments = [], []
    for i in range(60):
        posts.append((f"p{i:02d}", "politics", f"u{i % 7}", f"title {i}", "text", 50, 50, 1e9 + i, None, "u", "hot", i))
        for j in range(3):
            body = " ".join(rng.choice(words[i % 2], 6))
            comments.append((f"c{i:02d}{j}", f"p{i:02d}", None, "bob", body, 5 + j, 1e9, f"t3_p{i:02d}", j))
    from test_collect import COMMENT, POST

    landed = spark.createDataFrame(posts, POST), spark.createDataFrame(comments, COMMENT)
    path = str(tmp_path / "run")
    settings = Settings()
    settings = type(settings)(collect=type(settings.collect)(hot_limit=None))
    out = jobs.run(spark, path, "one", settings, landed, "2024-01-01 00:00:00")
    assert out["headline"].first().posts == 60
    first = sorted(out["clusters"].collect())
    labels = spark.read.parquet(f"{path}/labels/run=one").collect()
    assert len(labels) == 60
    found = {}
    for r in labels:
        if r.cluster_label >= 0:
            found.setdefault(r.cluster_label, set()).add(int(r.post_id[1:]) % 2)
    assert len(found) >= 2 and all(len(kinds) == 1 for kinds in found.values())
    again = jobs.run(spark, path, "one", settings, cluster=False)
    assert sorted(again["clusters"].collect()) == first
    empty = jobs.run(spark, path, "two", settings, cluster=False)
    assert empty["clusters"].count() == 0


def test_two_batches_equal_one_corpus_within_a_version(spark, tmp_path):
    rng = np.random.default_rng(2)
    words = [f"word{i}" for i in range(40)]
    rows = [(f"p{i:02d}", " ".join(rng.choice(words, 8))) for i in range(30)]
    first, all_ = spark.createDataFrame(rows[:20], POSTS), spark.createDataFrame(rows, POSTS)
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    whole = _by_id(vectors.embed_posts(all_, one, 64))
    vectors.embed_posts(first, two, 64)
    before = _by_id(vectors.embed_posts(all_, two, 64))  # counted, but not yet part of the model
    assert not all(np.array_equal(before[k], whole[k]) for k in whole)
    assert {r.version for r in spark.read.parquet(f"{two}/vectors").collect()} == {1}
    after = _by_id(vectors.embed_posts(all_, two, 64, refresh=True))
    assert set(after) == set(whole) and all(np.array_equal(after[k], whole[k]) for k in whole)
    assert {r.version for r in spark.read.parquet(f"{two}/vectors").collect()} == {2}
    again = _by_id(vectors.embed_posts(all_, two, 64, refresh=True))  # nothing is counted twice
    assert all(np.array_equal(again[k], whole[k]) for k in whole)
