"""The cluster report as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.operators import summary, suspicion
from narrata.operators.summary import LABEL, NOISE
from narrata.settings import ReportSettings


def cluster_records(posts: DataFrame, s: ReportSettings) -> DataFrame:
    """One record per cluster.

    All inputs are aggregates keyed by the cluster, so the joins reuse their
    partitioning; what is missing for a cluster is an empty array, not an error.
    """
    parts = [
        suspicion.cluster_flags(posts, s),
        summary.keywords(posts, s),
        summary.sample_text(posts, s),
        summary.top_authors(posts, s),
        summary.sample_posts(posts, s),
        summary.timeline(posts),
    ]
    joined = reduce(lambda left, right: left.join(right, LABEL, "left"), parts)
    empty = F.array().cast("array<string>")
    return joined.select(
        LABEL,
        F.coalesce("keywords", empty).alias("keywords"),
        "sample_text",
        "size",
        F.coalesce("top_authors", empty).alias("top_authors"),
        "sample_posts",
        F.coalesce("timeline", F.array().cast("array<struct<day:date,n:bigint>>")).alias("timeline"),
        "flagged",
    )


def for_report(posts: DataFrame) -> DataFrame:
    """What the report reads of labelled posts: texts of clustered posts only."""
    inside = F.col(LABEL) != NOISE
    texts = [F.when(inside, F.col(c)).alias(c) for c in ("title", "selftext")]
    return posts.select("post_id", "seq", "author", "created_utc", *texts, LABEL)


def build_report(posts: DataFrame, s: ReportSettings) -> dict[str, DataFrame]:
    """The report's tables: cluster records, flagged users by name, headline counts."""
    return {
        "clusters": cluster_records(posts, s),
        "flagged_users": suspicion.flagged_users(posts, s),
        "headline": suspicion.headline(posts, s),
    }
