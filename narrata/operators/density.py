"""Cluster numbers from the merge tree of ``hierarchy``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.shared import cut


def numbered(clusters: DataFrame) -> DataFrame:
    """(run, v, cluster_label): clusters numbered from 0 by their first node, noise -1.

    The numbers come from a range sort and one row count per partition, so no
    task sees all clusters.
    """
    spark = clusters.sparkSession
    clusters = cut(clusters, "clusters")
    firsts = clusters.where(F.col("cluster").isNotNull()).groupBy("run", "cluster").agg(F.min("v").alias("first"))
    ordered = firsts.repartitionByRange("run", "first").sortWithinPartitions("run", "first")
    ordered = cut(ordered.withColumn("_id", F.monotonically_increasing_id()), "order")
    place = ordered.select("run", "cluster", F.shiftright("_id", 33).cast("int").alias("part"), (F.col("_id") % (1 << 33)).alias("pos"))
    counts = place.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()
    starts, total = [], 0
    for r in counts:
        starts.append((r.part, total))
        total += r.n
    offsets = F.broadcast(spark.createDataFrame(starts, "part int, start bigint"))
    place = place.join(offsets, "part").select("run", "cluster", (F.col("start") + F.col("pos")).alias("number"))
    base = F.broadcast(place.groupBy("run").agg(F.min("number").alias("base")))
    place = place.join(base, "run").select("run", "cluster", (F.col("number") - F.col("base")).cast("int").alias("cluster_label"))
    return clusters.join(place, ["run", "cluster"], "left").select("run", "v", F.coalesce("cluster_label", F.lit(-1)).alias("cluster_label"))
