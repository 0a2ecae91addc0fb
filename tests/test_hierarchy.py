"""The merge tree in bands: the same clusters wherever it is cut, and few cuts whatever its shape."""

from __future__ import annotations

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from narrata.operators import hierarchy


def frames(spark, n, edges):
    tree = spark.createDataFrame([(1, int(a), int(b), float(w)) for a, b, w in edges], "ms int, a bigint, b bigint, w double")
    cores = spark.range(n).select(F.lit(1).alias("ms"), F.col("id").alias("v"), F.lit(1).cast("bigint").alias("m"), F.lit(0.0).alias("core"))
    return tree, cores


def clusters(rows, run=0):
    found = {}
    for r in rows:
        if r.run == run and r.cluster is not None:
            found.setdefault(r.cluster, set()).add(r.v)
    return {frozenset(m) for m in found.values()}


def random_tree(seed, n, weights):
    rng = np.random.default_rng(seed)
    shape = rng.choice(["chain", "star", "any"])
    ends = [(v - 1 if shape == "chain" else 0 if shape == "star" else int(rng.integers(0, v)), v) for v in range(1, n)]
    names = rng.permutation(n)
    return [(names[a], names[b], float(rng.choice(weights)) if weights else float(rng.random())) for a, b in ends]


@pytest.mark.parametrize("seed, weights, bound", [(1, [1, 2, 3, 4], 4), (3, None, 9), (4, [5], 6), (5, [1, 2, 3, 4, 5, 6, 7, 8, 9], 2)])
def test_clusters_equal_brute_force_wherever_the_tree_is_cut(spark, seed, weights, bound):
    n = 60
    edges = random_tree(seed, n, weights)
    runs = [(0, 2, 1), (1, 3, 1), (2, 6, 1)]
    w = brute.path_maxima(n, edges)
    rows = hierarchy.condense(*frames(spark, n, edges), runs, part_edges=bound).collect()
    assert len(rows) == n * len(runs)
    for run, least, _ in runs:
        assert clusters(rows, run) == set(brute.labels_of(w, least))


def test_a_long_chain_takes_few_cuts(spark):
    """100,000 edges of growing weight, which one node swallows one by one, with three dense ends."""
    n = 100_001
    w = np.arange(1, n, dtype=float)
    w[40_000:40_040] = w[70_000:70_100] = 0.5
    tree, cores = frames(spark, n, [])
    tree = spark.createDataFrame([(1, i, i + 1, float(w[i])) for i in range(n - 1)], "ms int, a bigint, b bigint, w double")
    parts, joined, _ = hierarchy.bands(tree, cores, 30_000)
    sizes = [r["count"] for r in parts.groupBy("part").count().collect()]
    assert max(sizes) <= 30_000 and joined.select("part").distinct().count() <= 8
    assert sum(sizes) + joined.count() - joined.select("part").distinct().count() == n - 1
    runs = [(0, 5, 1), (1, 60, 1)]
    cut = hierarchy.condense(tree, cores, runs, part_edges=30_000)
    whole = hierarchy.condense(tree, cores, runs, part_edges=n)
    pairs = cut.join(whole.withColumnRenamed("cluster", "other"), ["run", "v"]).where("cluster is not null or other is not null")
    got = pairs.groupBy("run", "cluster", "other").agg(F.count("*").alias("n"), F.min("v").alias("first"), F.max("v").alias("last")).collect()
    assert got and all(r.cluster is not None and r.other is not None for r in got)  # the same points, in the same groups
    assert len({(r.run, r.cluster) for r in got}) == len({(r.run, r.other) for r in got}) == len(got)
    assert (40_000, 40_040) in {(r["first"], r["last"]) for r in got if r.run == 0}


def test_values_settle_in_few_rounds(spark):
    """A spine of clusters, each with a leaf: raking alone would take a round per cluster."""
    rng = np.random.default_rng(6)
    n = 60
    rows, parent, kids = [], {}, {}
    for i in range(n):
        for c in (2 * i, 2 * i + 1):  # even ones are the spine
            parent[c] = None if c == 0 else 2 * i if c % 2 else 2 * i - 2
            kids.setdefault(parent[c], []).append(c)
            rows.append((0, c, parent[c], float(rng.random() * (n - i if c % 2 == 0 else 1)), 0.0))
    got = {r.c: r.chosen for r in hierarchy._settled(spark.createDataFrame(rows, "run int, c bigint, parent bigint, stability double, inner double")).collect()}
    worth, want = {}, {}
    for _, c, p, s, _ in sorted(rows, key=lambda r: -r[1]):
        inside = sum(worth[k] for k in kids.get(c, []))
        worth[c], want[c] = max(s, inside), p is not None and s >= inside
    assert got == want
    chosen = spark.createDataFrame([(0, c, p, got[c]) for _, c, p, _, _ in rows], "run int, c bigint, parent bigint, chosen boolean")
    for r in hierarchy._outermost(chosen).collect():
        up, best = r.c, None
        while up is not None:
            best, up = up if got[up] else best, parent[up]
        assert r.best == best


def test_no_edges(spark):
    tree, cores = frames(spark, 1, [])
    assert [tuple(r) for r in hierarchy.condense(tree, cores, [(0, 2, 1)]).collect()] == [(0, 0, None)]


@pytest.mark.parametrize("small", [0, 1000])
def test_values_settle_on_the_driver_and_by_rounds(spark, small):
    """By definition, for random trees of clusters in two runs."""
    rng = np.random.default_rng(12)
    rows, want = [], {}
    for run in (0, 1):
        n = 40
        parent = [None] + [int(rng.integers(max(0, c - 4), c)) for c in range(1, n)]
        values = [(float(s), float(i)) for s, i in zip(rng.random(n), rng.random(n) * 0.2)]
        inside = [i for _, i in values]
        for c in reversed(range(n)):
            want[run, c] = parent[c] is not None and values[c][0] >= inside[c]
            if parent[c] is not None:
                inside[parent[c]] += max(values[c][0], inside[c])
        rows += [(run, c, parent[c], *values[c]) for c in range(n)]
    df = spark.createDataFrame(rows, "run int, c bigint, parent bigint, stability double, inner double")
    assert {(r.run, r.c): r.chosen for r in hierarchy._settled(df, small).collect()} == want
