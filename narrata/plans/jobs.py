"""Stages of the narrative job and how they hand over."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrata import schemas
from narrata.operators import blocks, collect, enrich, tags, vectors
from narrata.operators.blocks import BlockSettings
from narrata.operators.summary import LABEL, NOISE
from narrata.plans import marks
from narrata.plans.density import cluster_points
from narrata.plans.report import build_report, for_report
from narrata.settings import ClusterSettings, CollectSettings, Settings
from narrata.shared import cut
from narrata.sinks.files import write_csv, write_json
from narrata.sinks.keyed import read_if_exists, read_table, save_comments, save_posts
from narrata.sources.landed import read_csv, read_json


_DECIDING = ("post_id", "subreddit", "seq", "score", "num_comments", "created_utc")  # what tells which rows are kept


def collect_posts(
    landed_posts: DataFrame, landed_comments: DataFrame, s: CollectSettings, collection_date: str
) -> tuple[DataFrame, DataFrame]:
    """Listings to tagged posts with their top comments, and the kept posts' comments.

    Which posts are kept is decided on a few columns first, for the comments; the
    posts' text then goes from its deduplication to the comments' lists in one
    shuffle. Cleaned comments are needed twice, so they are written.
    """
    if s.month_window and s.as_of is None and collection_date is not None:
        s = replace(s, as_of=collection_date)
    listed = collect.listings(landed_posts, s)
    kept = cut(collect.select_posts(listed.select(*_DECIDING), s).select("post_id", "subreddit"), "kept")
    comments = collect.project_comments(collect.comments_of_posts(landed_comments, kept, s), s, collection_date)
    comments = cut(comments, "comments")
    posts = collect.project_posts(collect.select_posts(listed, s), s, collection_date)
    return tags.with_tags(enrich.attach_top_comments(posts, comments, s.top_comments)), comments


def attach_labels(posts: DataFrame, labels: DataFrame) -> DataFrame:
    """Posts with their cluster label, by key; a post without a vector stays null."""
    return posts.join(labels.select("post_id", LABEL), "post_id", "left")


def label_statistics(labels: DataFrame, run: list[str]) -> DataFrame:
    """Cluster statistics per run: the largest and median size count noise as a
    group, the mean size leaves it out."""
    n = labels.groupBy(*run, LABEL).agg(F.count("*").alias("n"))
    real = F.col(LABEL) != NOISE
    return n.groupBy(*run).agg(
        F.count_if(real).alias("n_clusters"),
        F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0).cast("bigint")).alias("n_noise"),
        F.max("n").alias("largest"),
        F.median("n").alias("median"),
        F.avg(F.when(real, F.col("n"))).alias("mean"),
    )


def reduce_vectors(stored: DataFrame, s: ClusterSettings) -> DataFrame:
    return vectors.reduce_vectors(stored, s.components)


def core_distances(stored: DataFrame, min_samples: int) -> DataFrame:
    """Distance of every vector to its ``min_samples``-th nearest one, itself counted."""
    points = stored.select("post_id", F.col("embedding").cast("array<double>").alias("vec"))
    index = blocks.build_index(points, BlockSettings())
    k = min_samples - 1
    cores = blocks.list_cores(index, blocks.neighbour_lists(index, k), k, [min_samples]).select("v", "core")
    return points.join(index.nodes.select("v", "vec"), "vec").join(cores, "v").select("post_id", "core")


def cluster_vectors(stored: DataFrame, s: ClusterSettings) -> DataFrame:
    """(post_id, cluster_label) of stored vectors: standardise, reduce, cluster.

    Fewer vectors than ``min_samples`` have no density, so all are noise.
    """
    if stored.limit(s.min_samples).count() < s.min_samples:
        return stored.select("post_id", F.lit(NOISE).cast("int").alias(LABEL))
    found = cluster_points(reduce_vectors(stored, s), [(s.min_cluster_size, s.min_samples)])
    return found.select("post_id", LABEL)


# The parameter grid of the sweep; None stands for min_cluster_size.
SWEEP_SIZES = (5, 10, 15, 20)
SWEEP_SAMPLES = (None, 5, 10)


def sweep(stored: DataFrame, s: ClusterSettings, reduced: bool = False) -> DataFrame:
    """Cluster statistics for every pair of the parameter grid; ``reduced`` vectors (post_id, vec) are taken as they are."""
    pairs = [(size, samples) for size in SWEEP_SIZES for samples in SWEEP_SAMPLES]
    points = stored if reduced else reduce_vectors(stored, s)
    found = cluster_points(points, [(size, samples or size) for size, samples in pairs])
    named = [(run, size, samples) for run, (size, samples) in enumerate(pairs)]
    names = stored.sparkSession.createDataFrame(named, "run int, min_cluster_size int, min_samples int")
    statistics = label_statistics(found, ["run"]).join(F.broadcast(names), "run")
    return statistics.select("min_cluster_size", "min_samples", "n_clusters", "n_noise", "largest", "median", "mean")


def embed_posts(
    posts: DataFrame, path: str, s: ClusterSettings, encoder: vectors.EncoderFactory | None = None, overwrite: bool = False
) -> DataFrame:
    return vectors.embed_posts(posts, path, s.vector_size, encoder, overwrite)


HAND_OVERS = ("table", "csv", "json")


def _stored_posts(spark: SparkSession, path: str, hand_over: str) -> DataFrame:
    """Posts as an earlier collection left them: the keyed table holds those of all runs, the files those of the last one."""
    if hand_over == "table":
        return read_table(spark, f"{path}/posts")
    schema = T.StructType([f for f in schemas.POSTS.fields if f.name != LABEL])
    return (read_csv if hand_over == "csv" else read_json)(spark, f"{path}/files/posts.{hand_over}", schema)


def _write_files(path: str, name: str, rows: DataFrame, schema: T.StructType) -> None:
    """As JSON and CSV, in the schema's order of columns, which is how CSV is read."""
    rows = rows.select(*[f.name for f in schema.fields if f.name in rows.columns])
    write_json(rows, f"{path}/files/{name}.json")
    write_csv(rows, f"{path}/files/{name}.csv")


def run(
    spark: SparkSession,
    path: str,
    run_id: str,
    settings: Settings = Settings(),
    landed: tuple[DataFrame, DataFrame] | None = None,
    collection_date: str | None = None,
    cluster: bool = True,
    report: bool = True,
    encoder: vectors.EncoderFactory | None = None,
    overwrite: bool = False,
    hand_over: str = "table",
    resume: bool = False,
) -> dict[str, DataFrame]:
    """Run the chosen stages over the tables under ``path``.

    ``landed`` (posts, comments) adds a collection; without it the saved posts
    are used. Every stage hands over through what it writes: ``posts`` and
    ``comments`` by key and as JSON and CSV files, ``vectors`` by post,
    ``labels`` and ``report`` by run, labelled posts as files. ``hand_over``
    names the form in which later stages read the posts. ``overwrite`` makes all
    vectors anew, with a model fitted anew. Empty and tiny inputs give labels of
    noise and a report without clusters.

    A finished stage leaves a mark under ``runs``. With ``resume`` the stages
    that this run has finished are not done again. A stage that was cut short can
    be repeated: it adds stored keys to no table and replaces its files.
    """
    if hand_over not in HAND_OVERS:
        raise ValueError(f"hand_over must be one of {', '.join(HAND_OVERS)}")
    out: dict[str, DataFrame] = {}
    finished = marks.finished(spark, path, run_id) if resume else set()
    if landed is not None and "collect" not in finished:
        posts, comments = collect_posts(*landed, settings.collect, collection_date)
        posts = cut(posts, "posts", "zstd")  # written in three forms
        save_posts(posts, f"{path}/posts", unique=True)
        save_comments(comments, f"{path}/comments")
        _write_files(path, "posts", posts, schemas.POSTS)
        _write_files(path, "comments", comments, schemas.COMMENTS)
        marks.finish(spark, path, run_id, "collect")
    posts = _stored_posts(spark, path, hand_over)
    labels_path = f"{path}/labels/run={run_id}"
    if cluster and "cluster" not in finished:
        stored = embed_posts(enrich.with_comment_text(posts), f"{path}/vectors", settings.cluster, encoder, overwrite)
        cluster_vectors(stored, settings.cluster).write.mode("overwrite").parquet(labels_path)
        labelled = attach_labels(posts, spark.read.schema(schemas.LABELS).parquet(labels_path))
        _write_files(path, "labelled_posts", labelled, schemas.POSTS)
        marks.finish(spark, path, run_id, "cluster")
    if report:
        labels = read_if_exists(spark, labels_path, schemas.LABELS)
        if labels is None:
            labels = spark.createDataFrame([], schemas.LABELS)
        labelled = cut(for_report(attach_labels(posts, labels)), "labelled", "zstd")
        for name, table in build_report(labelled, settings.report).items():
            target = f"{path}/report/run={run_id}/{name}"
            if "report" not in finished:
                table.write.mode("overwrite").parquet(target)
            out[name] = spark.read.schema(table.schema).parquet(target)
        if "report" not in finished:
            marks.finish(spark, path, run_id, "report")
    return out
