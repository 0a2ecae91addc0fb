"""Per-cluster summaries of labelled posts.

Every operator reads the few columns it needs and aggregates before it
shuffles, so a cluster holding a large share of all posts stays cheap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.functions import text as tx
from narrata.operators.ranking import first_per_group
from narrata.settings import ReportSettings

LABEL = "cluster_label"
NOISE = -1
_ARRIVAL = ("seq", "post_id")


def clustered(posts: DataFrame) -> DataFrame:
    """Posts that belong to a cluster: labelled and not noise."""
    return posts.where(F.col(LABEL).isNotNull() & (F.col(LABEL) != NOISE))


def cluster_count(labels: DataFrame) -> DataFrame:
    """Number of clusters, noise not counted."""
    return labels.agg(F.count_distinct(F.when(F.col(LABEL) != NOISE, F.col(LABEL))).alias("n_clusters"))


def sizes(posts: DataFrame) -> DataFrame:
    return clustered(posts).groupBy(LABEL).agg(F.count("*").alias("size"))


def _in_rank_order(ranked: DataFrame, value: str, out: str) -> DataFrame:
    """Collect at most ``rank`` values per cluster into an array, in rank order."""
    pairs = F.array_sort(F.collect_list(F.struct("rank", value)))
    return ranked.groupBy(LABEL).agg(F.transform(pairs, lambda x: x[value]).alias(out))


def term_counts(posts: DataFrame, s: ReportSettings) -> DataFrame:
    """(cluster, term, n) over title and body, stop words removed."""
    words = clustered(posts).select(LABEL, F.explode(tx.tokens(tx.post_text(F.col("title"), F.col("selftext")))).alias("term"))
    return words.where(~F.col("term").isin(*s.stop_words)).groupBy(LABEL, "term").agg(F.count("*").alias("n"))


def keyword_ranks(posts: DataFrame, s: ReportSettings) -> DataFrame:
    return first_per_group(term_counts(posts, s), [LABEL], [F.desc("n"), F.asc("term")], s.keywords, "rank")


def keywords(posts: DataFrame, s: ReportSettings) -> DataFrame:
    """The most frequent terms per cluster, listed alphabetically."""
    return keyword_ranks(posts, s).groupBy(LABEL).agg(F.array_sort(F.collect_list("term")).alias("keywords"))


def sample_text(posts: DataFrame, s: ReportSettings) -> DataFrame:
    """First titles in arrival order, joined by line breaks."""
    titles = clustered(posts).select(LABEL, *_ARRIVAL, tx.or_empty(F.col("title")).alias("title"))
    ranked = first_per_group(titles, [LABEL], [F.asc(c) for c in _ARRIVAL], s.sample_titles, "rank")
    return _in_rank_order(ranked, "title", "_titles").select(LABEL, F.array_join("_titles", "\n").alias("sample_text"))


def author_counts(posts: DataFrame) -> DataFrame:
    """(cluster, author, n); posts without an author are left out."""
    known = clustered(posts).where(F.col("author").isNotNull())
    return known.groupBy(LABEL, "author").agg(F.count("*").alias("n"))


def author_ranks(posts: DataFrame, s: ReportSettings) -> DataFrame:
    return first_per_group(author_counts(posts), [LABEL], [F.desc("n"), F.asc("author")], s.top_authors, "rank")


def top_authors(posts: DataFrame, s: ReportSettings) -> DataFrame:
    return _in_rank_order(author_ranks(posts, s), "author", "top_authors")


def sample_ranks(posts: DataFrame, s: ReportSettings) -> DataFrame:
    """A repeatable random sample of titles: posts ordered by a seeded hash."""
    draw = F.md5(F.concat("post_id", F.lit(s.sample_seed)))
    titles = clustered(posts).select(LABEL, "post_id", tx.or_empty(F.col("title")).alias("title"), draw.alias("_draw"))
    ranked = first_per_group(titles, [LABEL], [F.asc("_draw"), F.asc("post_id")], s.sample_titles, "rank")
    return ranked.drop("_draw")


def sample_posts(posts: DataFrame, s: ReportSettings) -> DataFrame:
    return _in_rank_order(sample_ranks(posts, s), "title", "sample_posts")


def daily_counts(posts: DataFrame) -> DataFrame:
    """(cluster, day, n) for days with posts."""
    dated = clustered(posts).where(F.col("created_utc").isNotNull())
    return dated.groupBy(LABEL, F.to_date("created_utc").alias("day")).agg(F.count("*").alias("n"))


def timeline(posts: DataFrame) -> DataFrame:
    """Daily counts as one array per cluster, in ascending order (one entry per day)."""
    return daily_counts(posts).groupBy(LABEL).agg(F.array_sort(F.collect_list(F.struct("day", "n"))).alias("timeline"))
