"""Connected components of an edge table, one graph per key."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.shared import cut, drop

SMALL = 50_000  # edge lists up to this many rows are resolved on the driver
TASK_EDGES = 2_000_000  # graphs of up to so many edges are resolved by one task each


def small_table(spark: SparkSession, rows: pd.DataFrame, schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows.itertuples(index=False)], schema)


def merge_ids(edges: pd.DataFrame, key: str) -> pd.DataFrame:
    """(key, v, root) of a short edge list (key, a, b): union by smallest id."""
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for k, a, b in edges[[key, "a", "b"]].itertuples(index=False):
        ra, rb = find((k, a)), find((k, b))
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    rows = [(k, v, find((k, v))[1]) for k, v in list(parent)]
    return pd.DataFrame(rows, columns=[key, "v", "root"])


def _star(edges: DataFrame, key: str, large: bool) -> DataFrame:
    """One star operation: hang a node's larger (or smaller) neighbours on the smallest one."""
    if large:
        ends = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("w")), F.struct(F.col("b").alias("u"), F.col("a").alias("w")))
        s = edges.select(key, F.explode(ends).alias("e")).select(key, "e.u", "e.w")
    else:
        s = edges.select(key, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("w"))
    least = s.groupBy(key, "u").agg(F.least(F.min("w"), F.col("u")).alias("least"))
    moved = s.join(least, [key, "u"])
    if large:
        moved = moved.where(F.col("w") > F.col("u")).select(key, F.col("w").alias("a"), F.col("least").alias("b"))
    else:
        moved = moved.where(F.col("w") != F.col("least")).select(key, F.col("w").alias("a"), F.col("least").alias("b"))
        moved = moved.unionByName(least.select(key, F.col("u").alias("a"), F.col("least").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of an edge list, and the smallest node of each one's component: roots hang on smaller ones until none can."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    up = np.arange(len(names))
    while True:
        a, b = up[a], up[b]
        apart = a != b
        a, b = a[apart], b[apart]
        if not len(a):
            return names, names[up]
        up[np.maximum(a, b)] = np.minimum(a, b)
        while not np.array_equal(up, up[up]):
            up = up[up]


def connected_components(edges: DataFrame, key: str, small: int = SMALL, task: int = TASK_EDGES) -> DataFrame:
    """(key, v, root): the smallest node of every node's component.

    Where no graph has more than ``task`` edges, one task resolves each. Else
    alternating large-star and small-star operations (Kiveris et al., 2014) turn
    every component into a star; each is one aggregation and one join whose
    hub rows AQE can split. Edge lists known to be short skip the rounds.
    """
    edges = edges.select(key, "a", "b")
    if edges.limit(small + 1).count() <= small:
        roots = merge_ids(edges.toPandas(), key)
        return small_table(edges.sparkSession, roots, f"{key} int, v bigint, root bigint")
    if (edges.groupBy(key).count().agg(F.max("count")).first()[0] or 0) <= task:

        def resolve(x: pa.Table) -> pa.Table:
            v, root = roots_of(x.column("a").to_numpy(), x.column("b").to_numpy())
            return pa.table({"key": pa.array(np.full(len(v), x.column(key)[0].as_py()), pa.int32()), "v": v, "root": root})

        return edges.groupBy(key).applyInArrow(resolve, "key int, v bigint, root bigint").withColumnRenamed("key", key)
    before, last = None, None
    while True:
        edges = cut(_star(_star(edges, key, True), key, False), "stars")
        drop(last)
        last = edges
        after = edges.agg(F.count("*"), F.sum(F.xxhash64(key, "a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    centres = edges.select(key, F.col("b").alias("v")).distinct().withColumn("root", F.col("v"))
    return edges.select(key, F.col("a").alias("v"), F.col("b").alias("root")).unionByName(centres)
