"""Rules that flag clusters and users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.operators.summary import LABEL, NOISE, author_counts, clustered
from narrata.settings import ReportSettings


def bursts(posts: DataFrame, s: ReportSettings) -> DataFrame:
    """Size and ``burst`` per cluster: all posts within less than the burst length."""
    span = F.timestamp_diff("MICROSECOND", F.min("created_utc"), F.max("created_utc"))
    return clustered(posts).groupBy(LABEL).agg(
        F.count("*").alias("size"),
        F.coalesce(span < s.burst_seconds * 1_000_000, F.lit(False)).alias("burst"),
    )


def concentrations(posts: DataFrame, s: ReportSettings) -> DataFrame:
    """``concentrated`` per cluster: some author has more than ``author_posts`` posts."""
    return author_counts(posts).groupBy(LABEL).agg((F.max("n") > s.author_posts).alias("concentrated"))


def cluster_flags(posts: DataFrame, s: ReportSettings) -> DataFrame:
    """Size, both rules and their disjunction per cluster."""
    joined = bursts(posts, s).join(concentrations(posts, s), LABEL, "left")
    concentrated = F.coalesce("concentrated", F.lit(False))
    return joined.select(LABEL, "size", "burst", concentrated.alias("concentrated"), (F.col("burst") | concentrated).alias("flagged"))


def flagged_users(posts: DataFrame, s: ReportSettings) -> DataFrame:
    """Authors seen under more than one label; noise counts as a label by default."""
    rows = posts.where(F.col("author").isNotNull() & F.col(LABEL).isNotNull())
    if s.exclude_noise:
        rows = rows.where(F.col(LABEL) != NOISE)
    spread = rows.groupBy("author").agg(F.count_distinct(LABEL).alias("n_labels"))
    return spread.where(F.col("n_labels") > 1)


def headline(posts: DataFrame, s: ReportSettings) -> DataFrame:
    """One row: clusters, posts (noise included) and flagged users."""
    zero = F.lit(0).cast("bigint")
    parts = [
        posts.agg(
            F.count_distinct(F.when(F.col(LABEL) != NOISE, F.col(LABEL))).alias("clusters"),
            F.count("*").alias("posts"),
        ).withColumn("flagged_users", zero),
        flagged_users(posts, s).agg(F.count("*").alias("flagged_users")).withColumns({"clusters": zero, "posts": zero}),
    ]
    return parts[0].unionByName(parts[1]).agg(*[F.sum(c).alias(c) for c in ("clusters", "posts", "flagged_users")])
