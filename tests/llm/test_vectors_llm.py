"""Nearest neighbours and near-duplicate vectors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from narrata.llm import ann, embedding_dedup

SF = "/root/testdata/sf0.1"
SCHEMA = "vec_id bigint, embedding array<float>, label int, rid string, n string, v string, root int"
NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, "r", "n", "v", 1) for i, v, y in rows], SCHEMA)


EDGES = [
    (0, [1.0, 0.0], 1), (20, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (4, [0.0, 0.0], 1), (5, None, 1), (6, [NAN, 1.0], 1), (7, [INF, 1.0], 1),
    (8, [None, 1.0], 1), (None, [1.0, 0.0], 1), (9, [1.0, 0.0], None), (10, [0.0, 1.0], 2), (10, [0.0, 1.0], 2), (11, [1.0, 0.0, 0.0], 1), (12, [-1.0, 0.1], 1),
]


def clustered(n=1500, dims=16, seed=5):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(n // 3, dims))
    x = np.concatenate([centres, centres[: n // 3] + draw.normal(scale=0.12, size=(n // 3, dims)), centres[0] + draw.normal(scale=0.15, size=(n // 3, dims))])
    return [(i, [float(f) for f in np.float32(v)], int(i % 2)) for i, v in enumerate(x)]


def brute_links(rows, threshold):
    x = np.array([v for _, v, _ in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.array([y for *_, y in rows])
    near = (x @ x.T >= threshold) & (y[:, None] == y[None, :])
    np.fill_diagonal(near, False)
    group = np.arange(len(rows))
    while True:
        new = np.minimum(group, np.where(near, group[None, :], len(rows)).min(1))
        if (new == group).all():
            return near.sum(1), group
        group = new


@pytest.mark.parametrize("group", [1024, 64])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(embedding_dedup, "GROUP", group)
    rows = clustered()
    links, groups = brute_links(rows, 0.93)
    assert links.max() > 100
    got = sorted(embedding_dedup.near_duplicates(table(spark, rows)).collect())
    assert [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got] == [(i, links[i], groups[i], groups[i] == i) for i in range(len(rows))]


def test_near_duplicates_edges(spark):
    got = sorted(repr((r["vec_id"], r["n_links"], r["component_id"], r["kept"])) for r in embedding_dedup.near_duplicates(table(spark, EDGES)).collect())
    expected = [(0, 3, 0, True), (20, 3, 0, False), (3, 3, 0, False), (None, 3, 0, False), (10, 1, 10, True), (10, 1, 10, True)]
    expected += [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 11, 12)]
    assert got == sorted(map(repr, expected))
    assert embedding_dedup.near_duplicates(table(spark, [])).collect() == []


def exact(rows, k):
    use = [(i, np.array(v, np.float64)) for i, v, _ in rows]
    out = []
    for n, (q, x) in enumerate(use):
        if q % 20 == 0:
            best = sorted((-float(ann.exact_scores(x[None], y[None])[0]), i) for m, (i, y) in enumerate(use) if m != n)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_search_edges(spark):
    fine = [e for e in EDGES if e[0] in (0, 20, 3, 9, 10, 12)]
    got = sorted(tuple(r) for r in ann.search(table(spark, EDGES), "vec_id", "embedding", F.col("vec_id") % 20 == 0).collect())
    assert got == exact(fine, 20)
    assert ann.search(table(spark, []), "vec_id", "embedding", F.col("vec_id") % 20 == 0).collect() == []


def test_recall_and_hot_lists(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 100)
    rows = clustered(1200) + [(5000 + i, [0.5] * 16, 0) for i in range(600)]
    got = ann.search(table(spark, rows), "vec_id", "embedding", F.col("vec_id") % 20 == 0, probes=16).collect()
    expected = exact(rows, 20)
    assert len(got) == len(expected)
    assert len({(r["query_id"], r["vec_id"]) for r in got} & {(q, i) for q, _, i, _ in expected}) / len(expected) > 0.9


def test_recall_on_the_table(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], 0) for r in vectors.collect()]
    got = ann.search(vectors, "vec_id", "embedding", F.col("vec_id") % 20 == 0).collect()
    x = np.array([v for _, v, _ in rows], np.float64)
    hits = 0
    found: dict[int, set] = {}
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    for n, (q, _, _) in enumerate(rows):
        if q % 20 == 0:
            s = x @ x[n]
            s[n] = -np.inf
            hits += len(found[q] & {rows[i][0] for i in np.argsort(-s)[:20]})
    assert hits / (20 * len(found)) >= 0.9


def test_graph_walk_finds_the_nearest_centroids():
    x = np.random.default_rng(1).normal(size=(4000, 8))
    index = ann.Index(ann.balanced_centroids(x, 300), np.zeros(0), np.zeros(0), 1.0)
    index.links, index.entries = ann.build_graph(index.centroids), np.arange(4)
    q = x[:200].astype(np.float32)
    nodes, _ = index.nearest(q, 32)
    true = np.argsort(((q[:, None] - index.centroids) ** 2).sum(2), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(nodes.tolist(), true.tolist())]) > 0.95
    sizes = np.bincount(np.argmin(((x[:, None] - index.centroids) ** 2).sum(2), axis=1), minlength=300)
    assert sizes.max() < 10 * 4000 / 300
