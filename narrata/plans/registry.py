"""The registered queries: operators and jobs over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata import schemas
from narrata.functions import text as tx
from narrata.operators import collect, enrich, ranking, suspicion, summary, tags, vectors
from narrata.operators.summary import LABEL
from narrata.plans import jobs, report
from narrata.settings import ClusterSettings, CollectSettings, ReportSettings, Settings
from narrata.shared import cut, new_folder
from narrata.sinks import files, keyed
from narrata.sources import driver_tables as src
from narrata.sources import landed

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = "2024-02-02 00:00:00"
RUN_DATE = "2024-02-02 00:00:00"
LISTED = CollectSettings(as_of=AS_OF)
WHOLE = CollectSettings(communities=None, top_limit=None, hot_limit=None, month_window=False)
REPORT = ReportSettings()


def _all_posts(spark: SparkSession, d: str) -> DataFrame:
    return collect.project_posts(src.posts(spark, d), WHOLE, RUN_DATE)


def _all_comments(spark: SparkSession, d: str) -> DataFrame:
    return collect.project_comments(src.landed_comments(spark, d), WHOLE, RUN_DATE)


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Labelled posts as the report stage gets them: a written table, read once per aggregate."""
    return cut(src.posts(spark, d).select("post_id", "seq", "author", "title", "selftext", "created_utc", LABEL), "labelled")


def top_listing(spark, d):
    return collect.top_listing(src.landed_posts(spark, d), LISTED).select("subreddit", "listing_rank", "post_id", "score")


def hot_listing(spark, d):
    return collect.hot_listing(src.landed_posts(spark, d), LISTED).select("subreddit", "listing_rank", "post_id")


def listings(spark, d):
    return collect.listings(src.landed_posts(spark, d), LISTED).select("seq", "post_id", "listing")


def kept_posts(spark, d):
    listed = collect.listings(src.landed_posts(spark, d), LISTED)
    return collect.select_posts(listed, LISTED).select("post_id", "seq", "listing", "score", "num_comments", "title")


def kept_posts_all_communities(spark, d):
    listed = collect.listings(src.landed_posts(spark, d), WHOLE)
    return collect.select_posts(listed, WHOLE).select("post_id", "seq", "listing", "score", "num_comments", "title")


def clean_posts(spark, d):
    return _all_posts(spark, d)


def clean_page_text(spark, d):
    pages = src.table(spark, d, "pages")
    return pages.select("page_id", tx.clean_text(F.col("html")).alias("text"), tx.clean_text(F.col("url")).alias("url"))


def post_comments(spark, d):
    posts = collect.select_posts(src.posts(spark, d), WHOLE)
    return collect.comments_of_posts(src.landed_comments(spark, d), posts, WHOLE).select("comment_id", "post_id", "comment_seq")


def clean_comments(spark, d):
    return _all_comments(spark, d)


def top_comment_ranks(spark, d):
    ranked = enrich.ranked_top_comments(_all_comments(spark, d), WHOLE.top_comments)
    return ranked.select("post_id", "rank", "comment_id", "body", F.round("score_len", 6).alias("score_len"))


def comment_text(spark, d):
    posts = enrich.attach_top_comments(_all_posts(spark, d).select("post_id"), _all_comments(spark, d), WHOLE.top_comments)
    return enrich.with_comment_text(posts).select("post_id", F.size("top_comments").alias("n_comments"), "comment_text")


def post_tags(spark, d):
    return tags.with_tags(src.posts(spark, d)).select("post_id", F.array_join("tags", ",").alias("tags"))


def tag_counts(spark, d):
    tagged = tags.with_tags(src.posts(spark, d)).select("subreddit", F.explode("tags").alias("tag"))
    return tagged.groupBy("subreddit", "tag").agg(F.count("*").alias("n"))


def collected_posts(spark, d):
    posts, _ = jobs.collect_posts(src.landed_posts(spark, d), src.landed_comments(spark, d), LISTED, RUN_DATE)
    return posts.select(
        "post_id", "subreddit", "author", "title", "seq",
        F.array_join("tags", ",").alias("tags"), F.array_join("top_comments", "\n").alias("top_comments"),
    )


def collected_comments(spark, d):
    _, comments = jobs.collect_posts(src.landed_posts(spark, d), src.landed_comments(spark, d), LISTED, RUN_DATE)
    return comments.select("comment_id", "post_id", "author", "body", "score", "parent_id", "created_utc")


def unvectorised_posts(spark, d):
    return landed.without_vector(src.posts(spark, d), src.vectors(spark, d)).select("post_id", "subreddit")


def labelled_posts(spark, d):
    return jobs.attach_labels(src.posts(spark, d).drop(LABEL), src.labels(spark, d)).select("post_id", "seq", LABEL)


def cluster_count(spark, d):
    return summary.cluster_count(src.labels(spark, d))


def label_size_statistics(spark, d):
    runs = src.labels(spark, d).withColumns({"min_cluster_size": F.lit(10), "min_samples": F.lit(5)})
    return jobs.label_statistics(runs, ["min_cluster_size", "min_samples"])


def cluster_sizes(spark, d):
    return summary.sizes(src.posts(spark, d))


def keyword_ranks(spark, d):
    return summary.keyword_ranks(src.posts(spark, d), REPORT)


def keywords(spark, d):
    return summary.keywords(src.posts(spark, d), REPORT).select(LABEL, F.array_join("keywords", ", ").alias("keywords"))


def sample_text(spark, d):
    return summary.sample_text(src.posts(spark, d), REPORT)


def author_ranks(spark, d):
    return summary.author_ranks(src.posts(spark, d), REPORT)


def sample_posts(spark, d):
    return summary.sample_ranks(src.posts(spark, d), REPORT)


def daily_timeline(spark, d):
    return summary.daily_counts(src.posts(spark, d))


def cluster_flags(spark, d):
    return suspicion.cluster_flags(src.posts(spark, d), REPORT)


def flagged_users(spark, d):
    return suspicion.flagged_users(src.posts(spark, d), REPORT)


def flagged_users_without_noise(spark, d):
    return suspicion.flagged_users(src.posts(spark, d), ReportSettings(exclude_noise=True))


def headline(spark, d):
    return suspicion.headline(_labelled(spark, d), REPORT)


def _flat_records(records: DataFrame) -> DataFrame:
    days = F.transform("timeline", lambda x: F.concat(x["day"].cast("string"), F.lit("="), x["n"].cast("string")))
    return records.select(
        LABEL, "size", "flagged", "sample_text",
        F.array_join("keywords", ",").alias("keywords"),
        F.array_join("top_authors", ",").alias("top_authors"),
        F.array_join("sample_posts", "\n").alias("sample_posts"),
        F.array_join(days, ",").alias("timeline"),
    )


def cluster_records(spark, d):
    return _flat_records(report.cluster_records(_labelled(spark, d), REPORT))


def new_posts(spark, d):
    """What inserting the hot listing adds to a table that holds the top listing."""
    rows = src.landed_posts(spark, d)
    s = CollectSettings(as_of=AS_OF, communities=None, hot_limit=None)
    stored, incoming = collect.top_listing(rows, s), collect.hot_listing(rows, s)
    return keyed.new_rows(incoming, stored, "post_id", [F.asc("listing_rank")]).select("post_id", "subreddit", "listing")


def new_comments(spark, d):
    """What inserting every comment adds to a table that holds the first comment of each post."""
    rows = src.landed_comments(spark, d)
    stored = ranking.first_per_group(rows, ["post_id"], [F.asc("comment_seq")], 1)
    return keyed.new_rows(rows, stored, "comment_id", [F.asc("comment_seq")]).select("comment_id", "post_id", "comment_seq")


def orphan_comments(spark, d):
    kept = collect.select_posts(collect.listings(src.landed_posts(spark, d), LISTED), LISTED)
    return keyed.orphans(src.landed_comments(spark, d), kept).select("comment_id", "post_id")


def saved_posts(spark, d):
    """The keyed table after the same posts were saved twice."""
    path = new_folder(spark, "posts")
    posts = cut(_all_posts(spark, d), "clean")
    keyed.save_posts(posts, path)
    keyed.save_posts(posts, path)
    return keyed.read_table(spark, path)


def saved_comments(spark, d):
    path = new_folder(spark, "comments")
    comments = cut(_all_comments(spark, d), "clean")
    keyed.save_comments(comments, path)
    keyed.save_comments(comments, path)
    return keyed.read_table(spark, path)


def _subset(schema, df):
    return type(schema)([f for f in schema.fields if f.name in df.columns])


def json_posts(spark, d):
    path, posts = new_folder(spark, "posts-json"), tags.with_tags(_all_posts(spark, d))
    files.write_json(posts, path)
    out = landed.read_json(spark, path, _subset(schemas.POSTS, posts))
    return out.withColumn("tags", F.array_join("tags", ","))


def csv_posts(spark, d):
    path, posts = new_folder(spark, "posts-csv"), tags.with_tags(_all_posts(spark, d))
    files.write_csv(posts, path)
    out = landed.read_csv(spark, path, _subset(schemas.POSTS, posts))
    return out.withColumn("tags", F.array_join("tags", ","))


def csv_comments(spark, d):
    path, comments = new_folder(spark, "comments-csv"), _all_comments(spark, d)
    files.write_csv(comments, path)
    return landed.read_csv(spark, path, schemas.COMMENTS)


def epoch_times(spark, d):
    e = src.table(spark, d, "events")
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    at = tx.epoch_to_timestamp(seconds.cast("double"))
    return e.select("event_id", at.alias("created_utc"), tx.iso_text(at).alias("iso"), tx.parse_iso(tx.iso_text(F.col("ts"))).alias("parsed"))


def token_counts(spark, d):
    docs = src.table(spark, d, "documents").select(F.explode(tx.tokens(F.col("text"))).alias("term"))
    return docs.groupBy("term").agg(F.count("*").alias("n"))


def text_lengths(spark, d):
    stripped = tx.strip(F.col("selftext"))
    return src.posts(spark, d).select(
        "post_id",
        F.length(stripped).alias("n_stripped"),
        F.round(F.log1p(F.length("selftext")), 6).alias("log_length"),
        F.length(tx.post_text(F.col("title"), F.col("selftext"))).alias("n_text"),
    )


CLUSTER = ClusterSettings()


def text_vectors(spark, d):
    texts = enrich.attach_top_comments(_all_posts(spark, d).select("post_id"), _all_comments(spark, d))
    return jobs.embed_posts(enrich.with_comment_text(texts), new_folder(spark, "vectors"), CLUSTER)


def text_weights(spark, d):
    """The weights that text vectors are made of."""
    texts = enrich.with_comment_text(enrich.attach_top_comments(_all_posts(spark, d).select("post_id"), _all_comments(spark, d)))
    counts = cut(vectors.term_counts(texts.where("comment_text != ''"), CLUSTER.vector_size), "terms")
    rows = vectors.weights(counts, vectors.document_frequencies(counts)).select("post_id", F.explode("terms").alias("t"))
    return rows.select("post_id", "t.bucket", F.round("t.weight", 6).alias("weight"))


def standardised_vectors(spark, d):
    scaled = vectors.standardise(src.vectors(spark, d)).withColumn("x", vector_to_array("_scaled"))
    return scaled.select("post_id", F.posexplode("x").alias("dim", "x")).select("post_id", "dim", F.round("x", 6).alias("value"))


def reduced_vectors(spark, d):
    return jobs.reduce_vectors(src.vectors(spark, d), CLUSTER)


def core_distances(spark, d):
    found = jobs.core_distances(src.vectors(spark, d), CLUSTER.min_samples)
    return found.select("post_id", F.round("core", 6).alias("core"))


def density_labels(spark, d):
    return jobs.cluster_vectors(src.vectors(spark, d), CLUSTER)


def density_sweep(spark, d):
    return jobs.sweep(src.vectors(spark, d), CLUSTER)


# As many components as the vectors have: a rotation, which keeps every distance.
FULL = ClusterSettings(components=64)


def reduced_distances(spark, d):
    """Distance of each reduced vector to the next one by id."""
    rows = vectors.reduce_vectors(src.vectors(spark, d), FULL.components)
    ordered = cut(rows.repartitionByRange("post_id").sortWithinPartitions("post_id").withColumn("at", F.monotonically_increasing_id()), "ordered")
    # The next row is in the same partition or the first of the next one that has rows: few rows, found by their numbers.
    edges = ordered.select("at").groupBy(F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    bounds = sorted((r["first"], r["last"]) for r in edges.collect())
    jumps = [(last, first) for (_, last), (first, _) in zip(bounds, bounds[1:])]
    jump = F.broadcast(spark.createDataFrame(jumps, "at bigint, to bigint"))
    ways = ordered.join(jump, "at", "left").withColumn("next", F.coalesce("to", F.col("at") + 1))
    other = ordered.select(F.col("at").alias("next"), F.col("post_id").alias("other"), F.col("vec").alias("vec2"))
    apart = F.sqrt(F.aggregate(F.zip_with("vec", "vec2", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x))
    return ways.join(other, "next").select("post_id", "other", F.round(apart, 6).alias("d"))


def full_density_labels(spark, d):
    return jobs.cluster_vectors(src.vectors(spark, d), FULL)


def full_density_sweep(spark, d):
    return jobs.sweep(src.vectors(spark, d), FULL)


def narrative_labels(spark, d):
    """Labels after collecting, embedding, clustering and reporting on every post."""
    landed_tables = src.landed_posts(spark, d), src.landed_comments(spark, d)
    path = new_folder(spark, "run")
    jobs.run(spark, path, "check", Settings(collect=WHOLE), landed_tables, RUN_DATE)
    return spark.read.schema(schemas.LABELS).parquet(f"{path}/labels/run=check")


def _report_run(spark, d, hand_over):
    """Records of two runs of the job: one collects and saves, another one reports from what was saved and given labels."""
    path = new_folder(spark, "run")
    landed_tables = src.landed_posts(spark, d), src.landed_comments(spark, d)
    jobs.run(spark, path, "check", Settings(collect=WHOLE), landed_tables, RUN_DATE, cluster=False, report=False)
    src.labels(spark, d).write.parquet(f"{path}/labels/run=check")
    return _flat_records(jobs.run(spark, path, "check", cluster=False, hand_over=hand_over)["clusters"])


def run_report(spark, d):
    return _report_run(spark, d, "table")


def run_from_csv(spark, d):
    return _report_run(spark, d, "csv")


def run_from_json(spark, d):
    return _report_run(spark, d, "json")


TIGHT = CollectSettings(communities=None, top_limit=None, hot_limit=None, max_comments_per_post=3, top_comments=3, literal_none_author=True)
# Rules that ordinary texts never meet: every term of the tag rules, in posts chosen by their id.
INJECTED = [*tags.MISINFORMATION_TERMS, *tags.CONSPIRACY_TERMS]


def _limited_comments(spark, d):
    """All comments landed twice; of some the text or the author was taken away."""
    rows = src.landed_comments(spark, d)
    n = (F.col("post_id").cast("bigint") * 8 + F.col("comment_seq")) % 7
    body = F.when(n == 1, "[deleted]").when(n == 2, "[removed]").otherwise(F.col("body"))
    rows = rows.withColumns({"body": body, "author": F.when(n != 3, F.col("author"))})
    return rows.withColumn("landed_at", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("score", F.col("score") + F.col("landed_at"))


def limited_comments(spark, d):
    """The first three comments of each kept post, whatever was landed twice."""
    posts = collect.select_posts(src.posts(spark, d), TIGHT)
    kept = collect.comments_of_posts(_limited_comments(spark, d), posts, TIGHT)
    return collect.project_comments(kept, TIGHT, RUN_DATE).select("comment_id", "post_id", "author", "raw_body", "score", "comment_seq")


def limited_top_comments(spark, d):
    """The three most informative comments of each post, leaving out removed ones."""
    comments = collect.project_comments(_limited_comments(spark, d).where("landed_at = 2"), TIGHT, RUN_DATE)
    ranked = enrich.ranked_top_comments(comments, TIGHT.top_comments)
    return ranked.select("post_id", "rank", "comment_id", F.round("score_len", 6).alias("score_len"))


def injected_tags(spark, d):
    """Tags of posts into which terms were put and from which engagement was taken."""
    rows = src.posts(spark, d)
    at = F.col("seq") % (len(INJECTED) + 5)
    term = F.get(F.array(*[F.lit(t.upper()) for t in INJECTED]), at.cast("int"))
    low = at == len(INJECTED) + 1
    few = {c: F.when(low, F.lit(4)).otherwise(F.col(c)).cast("int") for c in ("score", "num_comments")}
    rows = rows.withColumns({"title": F.concat_ws(" ", "title", term), **few})
    return tags.with_tags(rows).select("post_id", F.array_join("tags", ",").alias("tags"))


def relanded_listing(spark, d):
    """The top listing of posts that were landed three times, each time with another score."""
    rows = src.landed_posts(spark, d).withColumn("landed_at", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    rows = rows.withColumn("score", F.col("score") - 7 * F.col("landed_at"))
    tight = CollectSettings(as_of=AS_OF, top_limit=3)
    return collect.top_listing(rows, tight).select("subreddit", "listing_rank", "post_id", "score", "landed_at")


def landed_rejects(spark, d):
    """Good and rejected records of landed text, in which every fifth record is broken."""
    path = new_folder(spark, "landed")
    comments = src.table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    line = F.to_json(F.struct(F.concat_ws("-", "conv_id", "turn").alias("comment_id"), F.col("conv_id").cast("string").alias("post_id"), F.col("text").alias("body")))
    broken = (F.col("conv_id") * 8 + F.col("turn")) % 5 == 0
    comments.select(F.when(broken, F.concat(F.lit("x"), line)).otherwise(line)).write.text(path)
    good, rejects = landed.read_landed(spark, path, schemas.COMMENT_LANDED)
    counted = good.select(F.lit("good").alias("kind"), "post_id").unionByName(rejects.select(F.lit("rejected").alias("kind"), F.lit(None).cast("string").alias("post_id")))
    return counted.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("post_id").alias("posts"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        top_listing, hot_listing, listings, kept_posts, kept_posts_all_communities, clean_posts, clean_page_text,
        post_comments, clean_comments, top_comment_ranks, comment_text, post_tags, tag_counts, collected_posts,
        collected_comments, unvectorised_posts, labelled_posts, cluster_count, label_size_statistics, cluster_sizes,
        keyword_ranks, keywords, sample_text, author_ranks, sample_posts, daily_timeline, cluster_flags, flagged_users,
        flagged_users_without_noise, headline, cluster_records, new_posts, new_comments, orphan_comments, saved_posts,
        saved_comments, json_posts, csv_posts, csv_comments, epoch_times, token_counts, text_lengths, text_vectors,
        standardised_vectors, reduced_vectors, core_distances, density_labels, density_sweep, narrative_labels,
        limited_comments, limited_top_comments, injected_tags, relanded_listing, landed_rejects,
        run_report, run_from_csv, run_from_json, reduced_distances, full_density_labels, full_density_sweep,
        text_weights,
    )
}
