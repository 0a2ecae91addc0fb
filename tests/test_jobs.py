"""Stages of the run job: hand-over in every form, and runs that are cut short."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from narrata import schemas
from narrata.plans import jobs, marks
from narrata.settings import ClusterSettings, CollectSettings, Settings
from narrata.sources import landed

SETTINGS = Settings(collect=CollectSettings(communities=None, month_window=False), cluster=ClusterSettings(vector_size=32, components=4, min_cluster_size=3, min_samples=2))
DATE = "2024-01-01 00:00:00"
WORDS = (("solar", "wind", "power,", "plant"), ("moon", '"landing"', "hoax", "claims"), ("soup", "recipe\nwith", "lentils", "salt"))


def tables(spark, n=30):
    posts = [(f"p{i:02d}", "politics", f"user{i % 5}", f'Title, "{i}"\nmore', f"text {i}" if i % 4 else "", 20 + i, 15, 1.7e9 + i, None, None, "top", None) for i in range(n)]
    draw = random.Random(3)
    comments = [(f"c{i:02d}-{j}", f"p{i:02d}", None, "a", " ".join(draw.choices(WORDS[i % 3], k=6)), 5 + j, 1.7e9, None, j) for i in range(n) for j in range(3)]
    return spark.createDataFrame(posts, schemas.POST_LANDED), spark.createDataFrame(comments, schemas.COMMENT_LANDED)


def _ready(spark):
    """Posts and comments as the collector's functions take them."""
    posts, comments = tables(spark)
    at = F.timestamp_seconds("created_utc").cast("timestamp_ntz")
    return posts.withColumn("created_utc", at), comments.withColumn("created_utc", at)


def _encoder():
    """Texts of one vocabulary lie together; no two distances are equal."""
    vocabularies = WORDS

    def factory():
        def encode(texts):
            kinds = [next((k for k, words in enumerate(vocabularies) if any(w in t for w in words)), -1) for t in texts]
            assert -1 not in kinds, texts
            noise = np.array([np.random.default_rng(zlib.crc32(t.encode())).normal(size=6) for t in texts])
            return noise + np.eye(3, 6)[kinds] * np.array([30.0, 50, 90, 0, 0, 0])

        return encode

    return factory


encoder = _encoder()


def rows(out):
    return {name: sorted(map(repr, df.collect())) for name, df in out.items()}


def test_every_hand_over_gives_the_same_report(spark, tmp_path):
    got = {}
    for form in jobs.HAND_OVERS:
        path = str(tmp_path / form)
        jobs.run(spark, path, "one", SETTINGS, _ready(spark), DATE, cluster=False, report=False, hand_over=form)
        got[form] = rows(jobs.run(spark, path, "one", SETTINGS, encoder=encoder, hand_over=form))
    assert got["csv"] == got["table"] == got["json"] and got["csv"]["clusters"]
    schema = schemas.POSTS
    labelled = [landed.read_csv(spark, f"{path}/files/labelled_posts.csv", schema), landed.read_json(spark, f"{path}/files/labelled_posts.json", schema)]
    assert sorted(map(repr, labelled[0].collect())) == sorted(map(repr, labelled[1].collect()))
    assert labelled[0].where("cluster_label >= 0").count() > 0
    with pytest.raises(ValueError, match="hand_over"):
        jobs.run(spark, path, "one", hand_over="parquet")


def test_a_run_that_is_cut_short_and_resumed_equals_one_run(spark, tmp_path, monkeypatch):
    whole = rows(jobs.run(spark, str(tmp_path / "whole"), "one", SETTINGS, _ready(spark), DATE, encoder=encoder))
    path = str(tmp_path / "cut")

    def stop(*args, **kwargs):
        raise RuntimeError("lost")

    for broken in ("collect_posts", "cluster_vectors", "build_report"):
        with monkeypatch.context() as m, pytest.raises(RuntimeError, match="lost"):
            m.setattr(jobs, broken, stop)
            jobs.run(spark, path, "one", SETTINGS, _ready(spark), DATE, encoder=encoder, resume=True)
    assert marks.finished(spark, path, "one") == {"collect", "cluster"}
    with monkeypatch.context() as m:  # finished stages are not done again
        m.setattr(jobs, "collect_posts", stop)
        m.setattr(jobs, "cluster_vectors", stop)
        assert rows(jobs.run(spark, path, "one", SETTINGS, _ready(spark), DATE, encoder=encoder, resume=True)) == whole
        m.setattr(jobs, "save_posts", stop)
        assert rows(jobs.run(spark, path, "one", SETTINGS, resume=True)) == whole
    assert marks.finished(spark, path, "one") == {"collect", "cluster", "report"} and marks.finished(spark, path, "two") == set()


def test_only_needed_columns_are_written_between_stages(spark, tmp_path, monkeypatch):
    """Which posts are kept is written without their text, the report's posts without what it does not read."""
    seen, real = {}, jobs.cut

    def cut(df, name, *more):
        seen[name] = real(df, name, *more)
        return seen[name]

    monkeypatch.setattr(jobs, "cut", cut)
    out = jobs.run(spark, str(tmp_path), "one", SETTINGS, _ready(spark), DATE, cluster=False, report=False)
    labels = [(f"p{i:02d}", (-1, 0, 1, None)[i % 4]) for i in range(28)]
    spark.createDataFrame(labels, schemas.LABELS).write.parquet(f"{tmp_path}/labels/run=one")
    out = jobs.run(spark, str(tmp_path), "one", SETTINGS, cluster=False)
    assert seen["kept"].columns == ["post_id", "subreddit"] and seen["posts"].count() == 30
    got = seen["labelled"].collect()
    assert len(got) == 30 and not {"tags", "top_comments", "url"} & set(seen["labelled"].columns)
    assert all((r.title is None and r.selftext is None) == (r.cluster_label in (None, -1)) for r in got)
    assert out["headline"].first().posts == 30 and {r["size"] for r in out["clusters"].collect()} == {7}


def test_a_sweep_takes_a_reduced_matrix(spark):
    vectors = spark.createDataFrame([(f"p{i}", [float(i % 3) * 10 + i * 0.01, float(i % 7) * 0.1]) for i in range(60)], "post_id string, embedding array<double>")
    reduced = vectors.withColumnRenamed("embedding", "vec")
    got = jobs.sweep(reduced, SETTINGS.cluster, reduced=True).collect()
    assert len(got) == 12 and all(r.n_noise + r.n_clusters > 0 for r in got)
    assert {r.n_clusters for r in got if r.min_cluster_size == 10 and r.min_samples == 5} == {3}
