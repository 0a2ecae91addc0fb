"""Rule-based post tags as one column expression."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.functions import text as tx

# Terms, names and thresholds of the tagging rules.
MISINFORMATION_TERMS = ("5g", "plandemic", "bioweapon", "graphene", "cancer cure", "chemtrails")
CONSPIRACY_TERMS = ("deep state", "hoax", "false flag", "great reset", "illuminati")
SATIRE_FLAIRS = ("satire", "joke")
POLITICAL_FLAIRS = ("dem", "gop", "liberal", "conservative")
CONSPIRACY_COMMUNITY = "conspiracy"
POLITICAL_COMMUNITY = "politics"
REMOVED_AUTHOR = "[deleted]"
HIGH_COMMENTS, HIGH_SCORE = 300, 1000
LOW_COMMENTS, LOW_SCORE = 5, 5
LONG_TEXT = 1000


def _any_in(texts: Iterable[Column], terms: Iterable[str]) -> Column:
    return reduce(or_, [t.contains(term) for t in texts for term in terms])


def tag_rules(title: Column, selftext: Column) -> list[tuple[str, Column]]:
    """(tag, condition) pairs in the order tags are listed; texts are lower-cased and not null."""
    flair, community, author = (F.lower(tx.or_empty(F.col(c))) for c in ("flair", "subreddit", "author"))
    comments, score = F.col("num_comments"), F.col("score")
    return [
        ("potential_misinfo", _any_in([title, selftext], MISINFORMATION_TERMS)),
        ("conspiracy", _any_in([title, selftext], CONSPIRACY_TERMS)),
        ("conspiracy", community == CONSPIRACY_COMMUNITY),
        ("high_engagement", (comments > HIGH_COMMENTS) | (score > HIGH_SCORE)),
        ("low_engagement", (comments < LOW_COMMENTS) & (score < LOW_SCORE)),
        ("deleted_author", author.contains(REMOVED_AUTHOR)),
        ("likely_satire", _any_in([flair], SATIRE_FLAIRS)),
        ("political", (community == POLITICAL_COMMUNITY) | _any_in([flair], POLITICAL_FLAIRS)),
        ("theory_drop", F.length(tx.strip(tx.or_empty(F.col("selftext")))) > LONG_TEXT),
        ("url_only", tx.is_blank(tx.or_empty(F.col("selftext")))),
    ]


def with_tags(posts: DataFrame) -> DataFrame:
    """Add ``tags``; a tag two rules give is listed twice.

    The texts are lower-cased in a projection of their own: a dozen conditions
    read them, and each would lower-case them again.
    """
    low = posts.withColumns({"_title": F.lower(tx.or_empty(F.col("title"))), "_text": F.lower(tx.or_empty(F.col("selftext")))})
    found = [F.when(condition, F.lit(tag)) for tag, condition in tag_rules(F.col("_title"), F.col("_text"))]
    return low.withColumn("tags", F.array_compact(F.array(*found))).drop("_title", "_text")
