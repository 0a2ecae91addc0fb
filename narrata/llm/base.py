"""What the operators of this subpackage share."""

from __future__ import annotations

import pickle

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.shared import cut


class Sent:
    """A broadcast of any object of this package.

    Spark pickles what is broadcast by the names of its classes, which executors without the package cannot import; here
    the object travels with its classes and is rebuilt once per worker.
    """

    def __init__(self, spark: SparkSession, value):
        self._sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        if not hasattr(self._sent, "rebuilt"):
            self._sent.rebuilt = pickle.loads(self._sent.value)
        return self._sent.rebuilt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, folds: int = 5, held_out: int = 0):
    """(text, label) of at most ``rows`` labelled documents outside fold ``held_out``, taken in the order of a hash of the id.

    The bound is what a classifier is fitted on; the join carries ids first, so only the chosen texts move.
    Rows without an id, a text or a label take no part.
    """
    known = labels.select(F.col("doc_id").alias("l_id"), F.col(label).cast("double").alias("y")).where("y is not null and l_id is not null")
    known = known.where(fold(F.col("l_id"), folds) != held_out).groupBy("l_id").agg(F.max("y").alias("y"))
    chosen = cut(known.orderBy(F.xxhash64("l_id"), "l_id").limit(rows), "labelled")
    texts = docs.select(F.col("doc_id").alias("l_id"), F.col("text").alias("t")).where("t is not null")
    return cut(texts.join(F.broadcast(chosen), "l_id"), "labelled-texts")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang a node's larger (or smaller) neighbours on the least node among it and its neighbours."""
    if large:
        both = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("w")), F.struct(F.col("b").alias("u"), F.col("a").alias("w")))
        s = edges.select(F.explode(both).alias("e")).select("e.u", "e.w")
    else:
        s = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("w"))
    least = s.groupBy("u").agg(F.least(F.min("w"), F.col("u")).alias("least"))
    moved = s.join(least, "u")
    if large:
        moved = moved.where("w > u").select(F.col("w").alias("a"), F.col("least").alias("b"))
    else:
        moved = moved.where("w != least").select(F.col("w").alias("a"), F.col("least").alias("b"))
        moved = moved.unionByName(least.select(F.col("u").alias("a"), F.col("least").alias("b")))
    return moved.where("a != b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(v, root) for every node of (a, b) that has a link: root is the least node it reaches.

    Alternating large-star and small-star operations (Kiveris et al., 2014), each
    one aggregation and one join whose hub rows AQE can split. Every round is a
    written table, so neither the lineage nor the driver grows with the graph.
    """
    edges = cut(edges.select("a", "b").where("a != b").distinct(), "edges")
    before = None
    while True:
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before or after[0] == 0:
            break
        before = after
        edges = cut(_star(cut(_star(edges, True), "stars"), False), "stars")
    # small stars point from the larger node to the smaller one
    centres = edges.select(F.col("b").alias("v")).distinct().withColumn("root", F.col("v"))
    return edges.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(centres)
