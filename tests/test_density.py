"""Density clustering against brute force, with blocks small enough to take every path."""

from __future__ import annotations

import brute
import numpy as np
import pyarrow as pa
import pytest

from narrata.operators import blocks, spanning
from narrata.operators.blocks import BlockSettings
from narrata.operators.components import connected_components
from narrata.plans.density import cluster_points

TINY = BlockSettings(pivot_rows=6, block_rows=8, first=2)


def frame(spark, x, order=None):
    rows = [(f"p{i:04d}", v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame([rows[i] for i in (order if order is not None else range(len(rows)))], "post_id string, vec array<double>")


def clusters(rows, run=0):
    found = {}
    for r in rows:
        if r.run == run and r.cluster_label >= 0:
            found.setdefault(r.cluster_label, set()).add(int(r.post_id[1:]))
    return found


def blobs(seed, n=30):
    rng = np.random.default_rng(seed)
    return np.vstack([rng.normal(c, 0.3, (n, 2)) for c in ((0, 0), (4, 4), (0, 5))] + [rng.uniform(-2, 7, (n, 2))])


@pytest.mark.parametrize("seed", [1, 2])
def test_labels_equal_brute_force(spark, seed):
    x = blobs(seed)
    grid = [(10, 5), (5, 5), (15, 3)]
    rows = cluster_points(frame(spark, x), grid, TINY).collect()
    assert len(rows) == len(x) * len(grid)
    for run, (size, samples) in enumerate(grid):
        got = clusters(rows, run)
        assert {frozenset(m) for m in got.values()} == set(brute.labels(x, size, samples))
        firsts = [min(got[c]) for c in sorted(got)]
        assert sorted(got) == list(range(len(got))) and firsts == sorted(firsts)


def test_copies(spark):
    """Many copies of one vector, fewer than min_samples and more."""
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, 1, (40, 3)), np.repeat([[9.0, 9, 9]], 12, 0), np.repeat([[-7.0, 2, 2]], 4, 0), np.repeat([[2.0, -8, 1]], 6, 0)])
    grid = [(10, 5), (5, 10), (4, 3)]
    rows = cluster_points(frame(spark, x), grid, TINY).collect()
    for run, (size, samples) in enumerate(grid):
        assert {frozenset(m) for m in clusters(rows, run).values()} == set(brute.labels(x, size, samples))


def test_distributed_rounds_and_tiers(spark):
    """No driver-side shortcut and several tiers give the same clusters."""
    x = blobs(7, 14)
    rows = cluster_points(frame(spark, x), [(5, 3)], TINY, part_edges=15, small=0).collect()
    assert {frozenset(m) for m in clusters(rows).values()} == set(brute.labels(x, 5, 3))


def test_a_row_moves_once_for_each_group_and_lot(spark):
    """Every block paired with every other one: rows are sent to few tasks, not to one for every pair, and no pair is left out."""
    x = np.random.default_rng(5).normal(size=(240, 12))
    index = blocks.build_index(frame(spark, x), BlockSettings(pivot_rows=6, block_rows=8, first=2, fan=3))
    names = index.blocks.select("block")
    assert names.count() > 20
    pairs = names.crossJoin(names.withColumnRenamed("block", "other")).where("block != other")

    def seen(q, x):
        of = [x.column("v").to_pylist()] * q.num_rows
        return pa.table({"v": q.column("v"), "of": pa.array(of, pa.list_(pa.int64()))})

    nodes = index.nodes.select("v", "block")
    keyed = blocks.compare(index, pairs, nodes, nodes, [], seen, "v bigint, of array<bigint>").collect()
    of_block = {r.v: r.block for r in nodes.collect()}
    met = [(r.v, o) for r in keyed for o in r.of]
    assert sorted(met) == sorted((a, b) for a in of_block for b in of_block if of_block[a] != of_block[b])

    def sides(q, x):
        names = q.column("lot").to_pylist() + x.column("lot").to_pylist()
        groups = q.column("group").to_pylist() + x.column("group").to_pylist()
        return pa.table({"v": pa.concat_arrays([*q.column("v").chunks, *x.column("v").chunks]), "group": pa.array(groups, pa.int64()), "lot": pa.array(names, pa.int64())})

    sent = blocks.compare(index, pairs, nodes, nodes, [], sides, "v bigint, group bigint, lot bigint").distinct()
    assert max(r["count"] for r in sent.groupBy("v").count().collect()) <= 2 * 6  # groups and lots are dealt by hash, about 3 of each


def test_row_order_does_not_matter(spark):
    x = np.round(blobs(3, 20), 1)  # many equal distances
    one = cluster_points(frame(spark, x), [(8, 4)], TINY).collect()
    order = np.random.default_rng(0).permutation(len(x))
    two = cluster_points(frame(spark, x, order).repartition(5), [(8, 4)], BlockSettings()).collect()
    assert sorted(one) == sorted(two)


def test_too_few_points(spark):
    with pytest.raises(ValueError, match="too few"):
        cluster_points(frame(spark, np.eye(3)), [(10, 5)])
    rows = cluster_points(frame(spark, np.eye(6)), [(10, 5)]).collect()
    assert [r.cluster_label for r in rows] == [-1] * 6
    rows = cluster_points(frame(spark, np.ones((20, 2))), [(10, 5)]).collect()  # one vector only: the root
    assert [r.cluster_label for r in rows] == [-1] * 20


def test_neighbours_cores_and_tree_weight(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(0, 1, (50, 8)), rng.normal(6, 0.1, (50, 8))])  # half of all points in a tiny ball
    index = blocks.build_index(frame(spark, x), TINY)
    near = blocks.nearest_neighbours(index, 6)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    place = {r.v: int(r.rep[1:]) for r in index.nodes.select("v", "rep").collect()}
    for r in near.collect():
        assert place[r.b] == int(np.argsort(d[place[r.a]])[r["rank"] - 1])
    cores = blocks.core_distances(index, near, 6, [3, 5])
    for r in cores.collect():
        assert abs(r.core - brute.core_distances(x, r.ms)[place[r.v]]) < 1e-12
    tree = spanning.spanning_edges(index, near, cores).toPandas()
    for ms in (3, 5):
        t = tree[tree.ms == ms]
        assert len(t) == len(x) - 1
        assert abs(t.w.sum() - brute.tree_weight(brute.reachability(x, ms))) < 1e-9


@pytest.mark.parametrize("shift, scale, decimals", [(0.0, 1.0, 9), (0.0, 1.0, 0), (1e4, 1e-3, 9), (0.0, 1e-30, 40), (0.0, 1e18, 0)])
def test_lists_of_rows_that_pass_by(spark, shift, scale, decimals):
    """One list for each node, whatever task its neighbours lie in, also where distances are equal or too close for single precision."""
    x = np.round(shift + np.random.default_rng(6).normal(size=(300, 5)) * scale, decimals)
    index = blocks.build_index(frame(spark, x), BlockSettings(pivot_rows=20, block_rows=30, first=2, stream_rows=40))
    k = 7
    rows = blocks.neighbour_lists(index, k).collect()
    of = {r.v: r for r in index.nodes.select("v", "m", "vec").collect()}
    assert sorted(r.v for r in rows) == sorted(of)
    names = np.array(sorted(of))
    vec = np.array([of[v].vec for v in names])
    for r in rows:
        d = np.sqrt(((vec - of[r.v].vec) ** 2).sum(1))
        near = [j for j in np.lexsort((names, d)) if names[j] != r.v][:k]
        assert r.b == names[near].tolist() and r.d == d[near].tolist() and r.mb == [of[b].m for b in r.b]


def test_forest_keeps_the_least_edges(spark, monkeypatch):
    """Of what the neighbour lists hold only a forest goes into the rounds, and the tree is that of all of it."""
    x = np.round(blobs(5, 25), 1)
    index = blocks.build_index(frame(spark, x), TINY)
    near = blocks.nearest_neighbours(index, 12)
    cores = blocks.core_distances(index, near, 12, [3, 5]).cache()
    monkeypatch.setattr(spanning, "_BIN_EDGES", 300)
    kept = spanning._listed_forest(near, cores).toPandas()
    core = {(r.ms, r.v): r.core for r in cores.collect()}
    every = {(min(r.a, r.b), max(r.a, r.b)): r.d for r in near.collect()}
    for ms in (3, 5):
        some = kept[kept.ms == ms]
        assert len(some) < len(every) / 2
        lo, hi = np.array(list(every)).T
        w = np.array([max(d, core[ms, a], core[ms, b]) for (a, b), d in every.items()])
        least = spanning.forest_of(lo, hi, w).tolist()
        assert {(lo[i], hi[i], w[i]) for i in least} <= set(zip(some.a, some.b, some.w))
    tree = spanning.spanning_edges(index, near, cores).toPandas()
    vec = np.array([r.vec for r in index.nodes.orderBy("v").collect()])
    for ms in (3, 5):
        d = np.sqrt(((vec[:, None] - vec[None]) ** 2).sum(-1))
        c = np.array([core[ms, v] for v in sorted(v for m, v in core if m == ms)])
        assert abs(tree[tree.ms == ms].w.sum() - brute.tree_weight(np.maximum(d, np.maximum(c[:, None], c[None])))) < 1e-9


def test_forest_of_equal_weights():
    """By definition: an edge is kept unless edges before it join its ends already."""
    rng = np.random.default_rng(9)
    lo, hi = (np.array(x) for x in zip(*{tuple(sorted(e)) for e in rng.integers(0, 60, (400, 2)).tolist() if e[0] != e[1]}))
    w = rng.integers(0, 5, len(lo)).astype(float)
    kept, root = set(), list(range(60))

    def find(v):
        return v if root[v] == v else find(root[v])

    for i in np.lexsort((hi, lo, w)).tolist():
        if find(lo[i]) != find(hi[i]):
            root[find(lo[i])] = find(hi[i])
            kept.add(i)
    assert sorted(spanning.forest_of(lo, hi, w).tolist()) == sorted(kept)


def test_few_blobs_far_apart(spark):
    """No neighbour list leaves its blob, so the driver's rounds know no edge between components."""
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 0.1, (40, 2)) for c in (0, 50, 200)])
    rows = cluster_points(frame(spark, x), [(5, 3)], TINY).collect()
    assert {frozenset(m) for m in clusters(rows).values()} == set(brute.labels(x, 5, 3))


@pytest.mark.parametrize("task", [0, 1000])
def test_components_by_task_and_by_rounds(spark, task):
    rng = np.random.default_rng(1)
    edges = [(run, int(a), int(b)) for run in (0, 1) for a, b in rng.integers(0, 80, (60, 2)) if a != b]
    want = {}
    for run in (0, 1):
        known = {v: v for r, a, b in edges if r == run for v in (a, b)}
        for _ in known:
            for r, a, b in edges:
                if r == run:
                    known[a] = known[b] = min(known[a], known[b])
        want |= {(run, v): root for v, root in known.items()}
    df = spark.createDataFrame(edges, "run int, a bigint, b bigint")
    assert {(r.run, r.v): r.root for r in connected_components(df, "run", 0, task).collect()} == want


@pytest.mark.parametrize("small", [0, 1000])
def test_components(spark, small):
    rng = np.random.default_rng(2)
    edges = [(0, int(a), int(a) + 1) for a in range(30)] + [(0, 100, b) for b in range(101, 140)] + [(1, 5, 900), (1, 900, 7)]
    rng.shuffle(edges)
    df = spark.createDataFrame([tuple(map(int, e)) for e in edges], "run int, a bigint, b bigint")
    got = {(r.run, r.v): r.root for r in connected_components(df, "run", small).collect()}
    want = {(0, v): 0 for v in range(31)} | {(0, v): 100 for v in range(100, 140)} | {(1, v): 5 for v in (5, 7, 900)}
    assert got == want
