"""Near-duplicate vectors by sorted projection passes.

In each pass a vector's key is the concatenation of the signs of its products with random directions. The rows are
sorted by (label, key), so close vectors tend to stand close, and each is compared with the next ``window`` rows. The order is cut
into blocks of equal size, each with the head of the next one, so a crowded key or label is many
tasks. Links found in any pass are united into components. The number of passes follows from the largest label's size: a pair at
the threshold must fail to meet in all passes with a probability of at most ``miss``.

A window may be too short for a crowd of close vectors, so the links of a
vector are counted exactly inside its component: components are cut into blocks, every two blocks are compared in one
task, and only counts leave it. Links join members of one component only.

Defined results: vectors that are null, zero or hold null or non-finite components, and vectors without a
label, have no links and are their own component. Vectors of different lengths never link. Rows that repeat an id are
compared like other rows; they share a component's name. Rows without an id never name a component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.llm.base import connected_components
from narrata.shared import cut

BITS = 48
BLOCK = 2048  # rows of a block of the sorted order
GROUP = 1024  # rows of a block of a component
SEED = 9


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: finite components, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(rows) -> np.ndarray:
    """Vectors of one length as rows of length one, in double precision."""
    x = np.stack([np.asarray(r, np.float64) for r in rows])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _keys(dims: int, passes: int):
    """The sort key of every row in every pass."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(SEED).normal(size=(passes, dims, BITS))
        powers = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(batch.column("v").to_pylist())
            n = len(x)
            for p in range(passes):
                key = ((x @ planes[p]) > 0) @ powers
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, p, np.int32)), batch.column("label"), pa.array(key), batch.column("rid"), batch.column("v")], names=["turn", "label", "key", "rid", "v"])

    return of


def _compare_block(threshold: float, window: int):
    def of(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        x, rid, at = unit(rows["v"]), rows["rid"].to_numpy(), rows["at"].to_numpy()
        turn, label = rows["turn"].to_numpy(), rows["label"].to_numpy()
        own = at // BLOCK == rows["block"].iloc[0]
        a, b = [], []
        for k in range(1, min(window, len(rows) - 1) + 1):
            near = own[:-k] & (turn[:-k] == turn[k:]) & (label[:-k] == label[k:])
            near &= (np.einsum("ij,ij->i", x[:-k], x[k:]) >= threshold)
            a.append(rid[:-k][near])
            b.append(rid[k:][near])
        a, b = np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return of


def passes_needed(rows: int, window: int, threshold: float, miss: float) -> int:
    """Two vectors at the threshold stay together for as many key bits as it takes to thin ``rows`` to a window."""
    bits = max(1.0, math.log2(max(rows, 2) / window))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return max(4, math.ceil(math.log(miss) / math.log(1 - min(meet, 0.9))))


def found_links(rows: DataFrame, dims: int, threshold: float, window: int, miss: float) -> DataFrame:
    """(a, b) of rids compared in some pass and close enough. ``rows``: (rid, label, v), vectors of ``dims`` components."""
    largest = rows.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    keyed = rows.mapInArrow(_keys(dims, passes_needed(largest, window, threshold, miss)), "turn int, label bigint, key bigint, rid bigint, v array<double>")
    order = ["turn", "label", "key", "rid"]
    placed = cut(keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "sorted-vectors")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    # one row per partition of the sort
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect())
    shifts, total = [], 0
    for part, n in sizes:
        shifts.append((part, total - (part << 33)))
        total += n
    shift = F.broadcast(rows.sparkSession.createDataFrame(shifts, "part bigint, shift bigint"))
    placed = placed.join(shift, "part").select("turn", "label", "rid", "v", (F.col("at") + F.col("shift")).alias("at"))
    block = F.floor(F.col("at") / BLOCK)
    head = (F.col("at") % BLOCK < window) & (block > 0)
    dealt = placed.withColumn("block", F.explode(F.when(head, F.array(block, block - 1)).otherwise(F.array(block))))
    return dealt.groupBy("block").applyInPandas(_compare_block(threshold, window), "a bigint, b bigint")


def _count_pair(threshold: float):
    def of(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"rid": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64")})
        near = np.einsum("id,jd->ij", unit(left["v"]), unit(right["v"])) >= threshold
        near &= left["rid"].to_numpy()[:, None] != right["rid"].to_numpy()[None, :]
        return pd.DataFrame({"rid": left["rid"].to_numpy(), "n": near.sum(1)})

    return of


def _count_small(threshold: float):
    """Members of several small components, each counted inside its own."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in rows.groupby("root"):
            x = unit(own["v"])
            near = np.einsum("id,jd->ij", x, x) >= threshold
            np.fill_diagonal(near, False)
            out.append(pd.DataFrame({"rid": own["rid"].to_numpy(), "n": near.sum(1)}))
        return pd.concat(out)

    return of


def count_links(members: DataFrame, threshold: float) -> DataFrame:
    """(rid, n_links): for each of (rid, root, v) how many other members of its component are close enough."""
    sizes = members.groupBy("root").agg(F.count("*").alias("size"))
    sized = cut(members.join(sizes, "root"), "members")
    few = sized.where(F.col("size") <= GROUP).withColumn("bin", F.pmod(F.xxhash64("root"), F.lit(max(1, sized.count() // GROUP))))
    small = few.select("bin", "root", "rid", "v").groupBy("bin").applyInPandas(_count_small(threshold), "rid bigint, n bigint")
    parts = F.ceil(F.col("size") / GROUP).cast("int")
    many = sized.where(F.col("size") > GROUP).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    left = many.select("root", F.col("part").alias("i"), F.explode(every).alias("j"), "rid", "v")
    right = many.select("root", F.explode(every).alias("i"), F.col("part").alias("j"), "rid", "v")
    keys = ["root", "i", "j"]
    large = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_count_pair(threshold), "rid bigint, n bigint")
    return small.unionByName(large).groupBy("rid").agg(F.sum("n").alias("n_links"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, window: int = 32, miss: float = 1e-3) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of (vec_id, embedding, label)."""
    v = F.col("embedding").cast("array<double>")
    own = vectors.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), v.alias("v"))
    own = cut(own.withColumn("ok", usable(F.col("v")) & F.col("label").isNotNull()), "vectors")
    links = None
    for r in own.where("ok").select(F.size("v").alias("dims")).distinct().collect():
        rows = own.where(F.col("ok") & (F.size("v") == r["dims"])).select("rid", "label", "v")
        some = found_links(rows, r["dims"], threshold, window, miss)
        links = some if links is None else links.unionByName(some)
    if links is None:
        alone = own.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
        return alone.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    roots = cut(connected_components(links).select(F.col("v").alias("rid"), "root"), "roots")
    counts = count_links(own.select("rid", "v").join(roots, "rid"), threshold)
    named = own.select("rid", "vec_id").join(roots, "rid").groupBy("root").agg(F.min("vec_id").alias("component_id"))
    out = own.select("rid", "vec_id").join(roots, "rid", "left").join(named, "root", "left").join(counts, "rid", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
