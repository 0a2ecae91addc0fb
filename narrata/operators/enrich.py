"""Attach each post's most informative comments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.functions import text as tx
from narrata.operators.ranking import first_per_group

# Bodies that stand for a removed comment.
PLACEHOLDERS = ("[deleted]", "[removed]")


def drop_placeholders(comments: DataFrame) -> DataFrame:
    """Drop removed comments, judged by the raw body: cleaning strips the brackets."""
    raw = F.col("raw_body")
    return comments.where(raw.isNull() | ~raw.isin(*PLACEHOLDERS))


def with_informativeness(comments: DataFrame) -> DataFrame:
    return comments.withColumn("score_len", tx.informativeness(F.col("score"), F.col("body")))


def ranked_top_comments(comments: DataFrame, n: int = 10) -> DataFrame:
    """One row per (post, rank): the ``n`` comments with the highest score_len."""
    scored = with_informativeness(drop_placeholders(comments)).select("post_id", "comment_id", "body", "score_len")
    return first_per_group(scored, ["post_id"], [F.desc_nulls_last("score_len"), F.asc("comment_id")], n, "rank")


def attach_top_comments(posts: DataFrame, comments: DataFrame, n: int = 10) -> DataFrame:
    """Add ``top_comments``, best first; an empty array for a post without comments."""
    lists = (
        ranked_top_comments(comments, n)
        .groupBy("post_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "body"))).alias("_ranked"))
        .select("post_id", F.transform("_ranked", lambda x: x["body"]).alias("top_comments"))
    )
    empty = F.array().cast("array<string>")
    return posts.join(lists, "post_id", "left").withColumn("top_comments", F.coalesce("top_comments", empty))


def with_comment_text(posts: DataFrame) -> DataFrame:
    """Add ``comment_text``, the text that is embedded; '' when there are no comments."""
    return posts.withColumn("comment_text", F.array_join("top_comments", "\n"))
