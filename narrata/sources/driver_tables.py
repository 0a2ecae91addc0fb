"""The driver's parquet tables seen as posts, comments and vectors.

documents are posts, events give them an author, a time and counts, pages a
url, embeddings a cluster label, and conversations are comments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Communities the first four document sources stand for.
COMMUNITY_OF_SOURCE = {"src0": "politics", "src1": "conspiracy", "src2": "worldnews", "src3": "Conservative"}
BURST_LABEL = 3
AUTHORS = 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Joined by the posts' key, so that rows lie by it and what groups by it later need not move the text again.
    ids = {"documents": "doc_id", "events": "event_id", "pages": "page_id", "embeddings": "vec_id"}
    d, e, p, v = (table(spark, sf_dir, n).withColumn("post_id", F.col(i).cast("string")) for n, i in ids.items())
    community = F.col("source")
    for source, name in COMMUNITY_OF_SOURCE.items():
        community = F.when(F.col("source") == source, name).otherwise(community)
    user = F.col("user_id") % AUTHORS
    line_end = F.instr("text", "\n")
    k = F.get_json_object("props", "$.k").cast("int")
    noon = F.lit("2024-01-05 12:00:00").cast("timestamp_ntz")
    created = F.when(F.col("label") == BURST_LABEL, F.timestamp_add("MINUTE", F.minute("ts"), noon)).otherwise(F.col("ts"))
    flair = F.when(F.col("lang") == "fr", "Satire").when(F.col("lang") == "de", "Liberal view")
    return (
        d.join(e, "post_id")
        .join(p.select("post_id", "url"), "post_id", "left")
        .join(v.select("post_id", "label"), "post_id", "left")
        .select(
            "post_id",
            community.alias("subreddit"),
            F.when(user == 0, "[deleted]").otherwise(F.concat(F.lit("user_"), user.cast("string"))).alias("author"),
            F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
            F.when(line_end == 0, "").otherwise(F.expr("substr(text, instr(text, '\\n') + 1)")).alias("selftext"),
            F.floor(F.col("value") * 4).cast("int").alias("score"),
            (k * 4).alias("num_comments"),
            created.alias("created_utc"),
            flair.alias("flair"),
            "url",
            F.col("doc_id").alias("seq"),
            (F.col("label") - 1).alias("cluster_label"),
        )
    )


def landed_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every post landed twice: by the top and by the hot listing, with a supplied hot position."""
    both = F.array(
        F.struct(F.lit("top").alias("listing"), F.lit(None).cast("int").alias("listing_rank")),
        F.struct(F.lit("hot").alias("listing"), (F.col("num_comments") / 4 + 1).cast("int").alias("listing_rank")),
    )
    base = posts(spark, sf_dir).drop("seq", "cluster_label")
    return base.withColumn("l", F.explode(both)).select(*base.columns, "l.*")


def landed_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, e = table(spark, sf_dir, "conversations"), table(spark, sf_dir, "events")
    conv, turn = F.col("conv_id"), F.col("turn")
    parent = F.when(turn == 0, F.concat(F.lit("t3_"), conv.cast("string"))).otherwise(
        F.concat(F.lit("t1_"), conv.cast("string"), F.lit("-"), (turn - 1).cast("string"))
    )
    return c.join(e.select("event_id", "ts"), F.col("event_id") == conv * 8 + turn).select(
        F.concat(conv.cast("string"), F.lit("-"), turn.cast("string")).alias("comment_id"),
        conv.cast("string").alias("post_id"),
        F.lit(None).cast("string").alias("subreddit"),
        F.col("role").alias("author"),
        F.col("text").alias("body"),
        ((conv * 7 + turn * 13) % 101 - 5).cast("int").alias("score"),
        F.col("ts").alias("created_utc"),
        parent.alias("parent_id"),
        turn.cast("int").alias("comment_seq"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("post_id"), "embedding")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("post_id"), (F.col("label") - 1).alias("cluster_label")
    )
