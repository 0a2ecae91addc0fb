"""From landed posts and comments to clean, deduplicated, filtered tables."""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.functions import text as tx
from narrata.operators.ranking import first_per_group
from narrata.settings import CollectSettings

_TOP, _HOT = 0, 1


def of_communities(landed: DataFrame, communities: tuple[str, ...] | None) -> DataFrame:
    """Rows of the configured communities; ``None`` keeps every community."""
    return landed if communities is None else landed.where(F.col("subreddit").isin(*communities))


def _latest(df: DataFrame) -> list[Column]:
    """The order in which copies of one landed row are preferred: last landed first, where the table says when."""
    landed = [F.desc_nulls_last("landed_at")] if "landed_at" in df.columns else []
    return [*landed, F.desc("score"), F.asc("created_utc")]


def _month_until(instant: str, created: str) -> tuple[Column, Column]:
    """First and last value of the month that ends at ``instant``, as constants of the stored type, so that files can be skipped."""
    last = dt.datetime.fromisoformat(instant)
    year, month = (last.year, last.month - 1) if last.month > 1 else (last.year - 1, 12)
    first = last.replace(year=year, month=month, day=min(last.day, calendar.monthrange(year, month)[1]))
    if created == "timestamp_ntz":
        return F.lit(first), F.lit(last)
    return tuple(F.lit(t.replace(tzinfo=dt.timezone.utc).timestamp()) for t in (first, last))


def top_listing(landed: DataFrame, s: CollectSettings) -> DataFrame:
    """Best-scored posts of the month that ends at ``as_of``, ``top_limit`` per community.

    A post landed several times has one place, by its latest landing. Ranking
    reads only the score columns, and the chosen rows' text follows by id, so
    text is neither sorted nor shuffled for posts that are not listed.
    """
    rows = of_communities(landed, s.communities).where(F.col("listing") == "top")
    if s.as_of:
        first, last = _month_until(s.as_of, dict(rows.dtypes)["created_utc"])
        rows = rows.where(F.col("created_utc").between(first, last))
    if s.top_limit is None:
        return rows.withColumn("listing_rank", -F.col("score").cast("bigint"))
    order = [F.desc("score"), F.asc("post_id")]
    keys = [c for c in ("subreddit", "post_id", "score", "created_utc", "landed_at") if c in rows.columns]
    once = first_per_group(rows.select(*keys), ["subreddit", "post_id"], _latest(rows), 1)
    chosen = first_per_group(once, ["subreddit"], order, s.top_limit, "listing_rank")
    chosen = chosen.select("subreddit", "post_id", F.col("listing_rank").cast("bigint").alias("listing_rank"))
    # ``top_limit`` rows per community: a list in the settings bounds them, otherwise Spark sizes them.
    chosen = F.broadcast(chosen) if s.communities is not None else chosen
    near = rows.drop("listing_rank").join(chosen, ["subreddit", "post_id"])
    return first_per_group(near, ["subreddit", "post_id"], _latest(rows), 1)


def hot_listing(landed: DataFrame, s: CollectSettings) -> DataFrame:
    """Posts whose supplied hot position is within ``hot_limit``."""
    rows = of_communities(landed, s.communities).where(F.col("listing") == "hot")
    if s.hot_limit is not None:
        rows = rows.where(F.col("listing_rank") <= s.hot_limit)
    return rows.withColumn("listing_rank", F.col("listing_rank").cast("bigint"))


def _community_position(communities: tuple[str, ...] | None) -> Column:
    if communities is None:
        return F.lit(0)
    return F.array_position(F.array(*[F.lit(c) for c in communities]), F.col("subreddit")).cast("int")


def listings(landed: DataFrame, s: CollectSettings) -> DataFrame:
    """Both listings with ``seq``: community, then top before hot, then position.

    ``seq`` is computed from the row itself, so no global sort is needed.
    Listings without limits are one pass over the landed rows.
    """
    if s.top_limit is None and s.hot_limit is None:
        rows, top = of_communities(landed, s.communities), F.col("listing") == "top"
        inside = F.lit(True)
        if s.as_of:
            inside = F.col("created_utc").between(*_month_until(s.as_of, dict(rows.dtypes)["created_utc"]))
        rows = rows.where((top & inside) | (F.col("listing") == "hot"))
        rank = F.when(top, -F.col("score").cast("bigint")).otherwise(F.col("listing_rank").cast("bigint"))
        both = rows.withColumns({"listing_rank": rank, "_pos": F.when(top, F.lit(_TOP)).otherwise(F.lit(_HOT))})
    else:
        both = top_listing(landed, s).withColumn("_pos", F.lit(_TOP)).unionByName(
            hot_listing(landed, s).withColumn("_pos", F.lit(_HOT))
        )
    seq = (_community_position(s.communities) * 2 + F.col("_pos")).cast("bigint") * F.lit(1 << 32) + F.col("listing_rank")
    return both.withColumn("seq", seq).drop("_pos")


def select_posts(listed: DataFrame, s: CollectSettings) -> DataFrame:
    """First-seen row per post id, then the engagement thresholds.

    A post counts as seen before it is tested, so a first row below the
    thresholds hides later rows of the same id. Text of rows that fail is
    dropped before the shuffle.
    """
    passes = (F.col("num_comments") >= s.min_comments) & (F.col("score") >= s.min_score)
    passes = F.coalesce(passes, F.lit(False))
    texts = [c for c in ("title", "selftext", "url", "flair") if c in listed.columns]
    thin = listed.withColumns({c: F.when(passes, F.col(c)) for c in texts}) if texts else listed
    order = [F.asc("seq"), F.desc("score"), F.desc("num_comments"), F.asc("created_utc"), F.asc("subreddit")]
    return first_per_group(thin, ["post_id"], order, 1).where(passes)


def _created(df: DataFrame) -> Column:
    if dict(df.dtypes)["created_utc"] == "timestamp_ntz":
        return F.col("created_utc")
    return tx.epoch_to_timestamp(F.col("created_utc"))


def project_posts(raw: DataFrame, s: CollectSettings, collection_date: str) -> DataFrame:
    """Landed post columns to the ``posts`` table, with cleaned text."""
    return raw.select(
        "post_id",
        "subreddit",
        tx.author_name(F.col("author"), s.literal_none_author).alias("author"),
        tx.clean_text(F.col("title")).alias("title"),
        tx.clean_text(F.col("selftext")).alias("selftext"),
        "score",
        "num_comments",
        _created(raw).alias("created_utc"),
        "flair",
        "url",
        F.lit(collection_date).cast("timestamp_ntz").alias("collection_date"),
        F.col("seq").cast("bigint").alias("seq"),
    )


def comments_of_posts(comments: DataFrame, posts: DataFrame, s: CollectSettings) -> DataFrame:
    """The first ``max_comments_per_post`` comments of each kept post.

    Kept posts are unique by id, so the join only filters, and gives a comment
    its post's community; it comes first, so comments of other posts are not
    sorted. A comment landed several times is one, by its latest landing. Both
    limits on ranks also run before their shuffles, so a busy post stays small.
    """
    kept = comments.drop("subreddit").join(posts.select("post_id", "subreddit"), "post_id")
    kept = first_per_group(kept, ["post_id", "comment_id"], [*_latest(comments)[:-2], F.asc("comment_seq"), F.desc("score")], 1)
    if s.max_comments_per_post is None:
        return kept
    return first_per_group(kept, ["post_id"], [F.asc("comment_seq"), F.asc("comment_id")], s.max_comments_per_post)


def project_comments(raw: DataFrame, s: CollectSettings, collection_date: str) -> DataFrame:
    """Landed comment columns to the ``comments`` table; the raw body is kept."""
    return raw.select(
        "comment_id",
        "post_id",
        "subreddit",
        tx.author_name(F.col("author"), s.literal_none_author).alias("author"),
        F.col("body").alias("raw_body"),
        tx.clean_text(F.col("body")).alias("body"),
        "score",
        _created(raw).alias("created_utc"),
        "parent_id",
        F.lit(collection_date).cast("timestamp_ntz").alias("collection_date"),
        "comment_seq",
    )
