"""Nearest neighbours by largest inner product from balanced posting lists.

The largest inner product is the smallest distance once every vector has one more component that makes all norms equal
(queries get none and are scaled to that norm). A bounded sample is split in halves, always across its
longest spread and at the median, until the leaves have the list size asked for: balanced lists, whose means are the centroids. A
graph over the centroids (near neighbours, pruned where a closer one lies in the same direction) is searched best first in memory, many
vectors at a time. Every row goes to its nearest list, and to further ones whose centroid is at most ``1 + spill`` times as far,
unless a chosen centroid is nearer to that centroid than ``shade`` times as far as the row is. A query visits the lists within ``1 + reach`` times its nearest
distance, at most ``probes`` or that ``share`` of all lists, and more until they hold enough rows. Lists are dealt in blocks of bounded size, and so are the queries of a list;
a block is scored exactly in double precision on the original vectors.

There are about ``2 sqrt(n)`` lists, at most ``most_lists``, so the centroids that are broadcast have a bound.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor do those
with another length than most vectors. Equal scores rank the smaller id first. Rows without an id take no part. Repeated rows are
candidates each. Only the id and the vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from narrata.llm.base import Sent
from narrata.llm.embedding_dedup import usable
from narrata.shared import cut

BATCH = 256  # vectors that walk the graph together
BLOCK = 2048  # rows, or queries, of a list that one task scores


@dataclass
class Index:
    centroids: np.ndarray  # one more component than the vectors
    links: np.ndarray  # neighbours in the graph, padded with the node itself
    entries: np.ndarray  # nodes a walk starts from
    norm: float

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))
        return np.column_stack([x, rest]).astype(np.float32)

    def scaled(self, q: np.ndarray) -> np.ndarray:
        size = np.sqrt((q * q).sum(1, keepdims=True))
        return np.column_stack([q / size * self.norm, np.zeros(len(q))]).astype(np.float32)

    def nearest(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, squared distances) of about the ``beam`` nearest centroids of each row, nearest first."""
        parts = [self._walk(x[i : i + BATCH], min(beam, len(self.centroids))) for i in range(0, len(x), BATCH)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _walk(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n, k = len(x), len(self.centroids)
        rows = np.arange(n)[:, None]
        size = (self.centroids**2).sum(1)
        own = (x * x).sum(1)[:, None]

        def distance(nodes):
            return own + size[nodes] - 2 * np.einsum("nd,nkd->nk", x, self.centroids[nodes])

        start = np.broadcast_to(self.entries, (n, len(self.entries)))
        seen = np.zeros((n, k), bool)
        seen[rows, start] = True
        nodes, dist = start, distance(start)
        done = np.zeros(nodes.shape, bool)
        while True:
            order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
            nodes, dist, done = nodes[rows, order], dist[rows, order], done[rows, order]
            open_ = np.where(done | ~np.isfinite(dist), np.inf, dist)
            pick = np.argsort(open_, axis=1)[:, :4]  # the nearest nodes not yet left
            live = np.isfinite(open_[rows, pick])
            if not live.any():
                return nodes, dist
            done[rows, pick] = True
            around = self.links[nodes[rows, pick]].reshape(n, -1)
            fresh = ~seen[rows, around] & np.repeat(live, self.links.shape[1], axis=1)
            seen[rows, around] |= np.repeat(live, self.links.shape[1], axis=1)
            far = np.where(fresh, distance(around), np.inf)
            order = np.argsort(around, axis=1, kind="stable")  # a node met twice in one step counts once
            twice = np.zeros_like(fresh)
            by_node = around[rows, order]
            twice[rows, order] = np.concatenate((np.zeros((n, 1), bool), by_node[:, 1:] == by_node[:, :-1]), axis=1)
            far[twice] = np.inf
            nodes, dist = np.concatenate((nodes, around), axis=1), np.concatenate((dist, far), axis=1)
            done = np.concatenate((done, np.zeros(around.shape, bool)), axis=1)


def balanced_centroids(x: np.ndarray, lists: int) -> np.ndarray:
    """Means of ``lists`` parts of nearly equal size."""
    out = []
    stack = [(np.arange(len(x)), max(1, min(lists, len(x))))]
    while stack:
        own, parts = stack.pop()
        if parts == 1:
            out.append(x[own].mean(0))
            continue
        centred = x[own] - x[own].mean(0)
        axis = centred[int(np.argmax((centred**2).sum(1)))]
        for _ in range(8):  # power iteration
            axis = centred.T @ (centred @ axis)
            axis = axis / (np.linalg.norm(axis) + 1e-30)
        order = own[np.argsort(centred @ axis, kind="stable")]
        half = parts // 2
        at = len(own) * half // parts
        stack += [(order[:at], half), (order[at:], parts - half)]
    return np.array(out, np.float32)


def build_graph(c: np.ndarray, degree: int = 24, pool: int = 64) -> np.ndarray:
    """Near neighbours of every centroid, without those that a kept one is nearer to, and a ring so that all are reached."""
    n = len(c)
    size = (c * c).sum(1)
    links = np.repeat(np.arange(n)[:, None], degree + 2, axis=1)
    links[:, degree], links[:, degree + 1] = np.roll(np.arange(n), 1), np.roll(np.arange(n), -1)
    for at in range(0, n, 1024):
        block = np.arange(at, min(n, at + 1024))
        dist = size[block][:, None] + size - 2 * c[block] @ c.T
        dist[np.arange(len(block)), block] = np.inf
        near = np.argsort(dist, axis=1)[:, : min(pool, n - 1)]
        for i, row in zip(block, near):
            kept: list[int] = []
            for j in row.tolist():
                if len(kept) == degree:
                    break
                d = dist[i - at, j]
                if not kept or (((c[kept] - c[j]) ** 2).sum(1) > d).all():
                    kept.append(j)
            for j in row.tolist():  # fill up with the nearest left out
                if len(kept) == degree:
                    break
                if j not in kept:
                    kept.append(j)
            links[i, : len(kept)] = kept
    return links


def fit(rows: DataFrame, total: int, sample: int, most_lists: int) -> Index:
    """The index from at most ``sample`` rows of (id, v), taken in the order of a hash of the id."""
    norm = rows.agg(F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()[0]
    taken = rows.select("v").orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    x = np.array([r["v"] for r in taken], np.float64)
    index = Index(np.zeros((1, x.shape[1] + 1), np.float32), np.zeros((1, 1), np.int64), np.zeros(1, np.int64), float(norm))
    lists = int(min(most_lists, max(1, 2 * round(total**0.5)), len(x)))
    index.centroids = balanced_centroids(index.lifted(x), lists)
    index.links = build_graph(index.centroids)
    index.entries = np.unique(np.linspace(0, len(index.centroids) - 1, 8).astype(np.int64))
    return index


def _postings(send, spill: float, copies: int, shade: float):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = send.value
        c = index.centroids
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes, dist = index.nearest(index.lifted(np.array(batch.column("v").to_pylist(), np.float64)), 4 * copies)
            close = dist <= (1 + spill) ** 2 * np.maximum(dist[:, :1], 0)
            chosen = np.zeros(nodes.shape, bool)
            chosen[:, 0] = True
            for k in range(1, nodes.shape[1]):
                apart = ((c[nodes] - c[nodes[:, k]][:, None]) ** 2).sum(2)
                shaded = (chosen & (apart < shade**2 * dist[:, k : k + 1])).any(1)
                chosen[:, k] = close[:, k] & ~shaded & (chosen.sum(1) < copies)
            row, at = np.nonzero(chosen)
            took = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes[row, at]), pa.array(at == 0), batch.column("rid").take(took), batch.column("id").take(took), batch.column("v").take(took)], names=["list", "first", "rid", "id", "v"]
            )

    return of


def _visits(send, reach: float, probes: int, need: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, held = send.value
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes, dist = index.nearest(index.scaled(np.array(batch.column("v").to_pylist(), np.float64)), probes)
            before = np.cumsum(held[nodes], axis=1) - held[nodes]
            go = (dist <= (1 + reach) ** 2 * np.maximum(dist[:, :1], 0)) | (before < need)
            short = np.where(go, held[nodes], 0).sum(1) < need
            row, at = np.nonzero(go & ~short[:, None])
            lists = nodes[row, at]
            if short.any():  # hardly any rows near by: all lists
                row = np.concatenate((row, np.repeat(np.flatnonzero(short), len(held))))
                lists = np.concatenate((lists, np.tile(np.arange(len(held)), int(short.sum()))))
            took = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(lists), batch.column("rid").take(took), batch.column("id").take(took), batch.column("v").take(took)], names=["list", "rid", "id", "v"])

    return of


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed in the order of the components, so equal vectors score alike."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * x[:, d]
    return out


def _best(k: int):
    def of(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            q, x = np.array(queries["v"].tolist(), np.float64), np.array(rows["v"].tolist(), np.float64)
            ids, rids = rows["id"].to_numpy(), rows["rid"].to_numpy()
            for at in range(0, len(q), 256):
                part = slice(at, at + 256)
                rough = q[part] @ x.T
                rough[rids[None, :] == queries["rid"].to_numpy()[part][:, None]] = -np.inf
                last = np.partition(rough, -min(k, len(x)), axis=1)[:, -min(k, len(x))]
                i, j = np.nonzero(np.isfinite(rough) & (rough >= (last - 1e-9 * (1 + np.abs(last)))[:, None]))
                found = pd.DataFrame({"q_rid": queries["rid"].to_numpy()[part][i], "query_id": queries["id"].to_numpy()[part][i], "rid": rids[j], "vec_id": ids[j], "score": exact_scores(q[part][i], x[j])})
                found = found.sort_values(["q_rid", "score", "vec_id", "rid"], ascending=[True, False, True, True])
                out.append(found.groupby("q_rid").head(k))
        empty = pd.DataFrame({"q_rid": [], "query_id": [], "rid": [], "vec_id": [], "score": []}).astype({"q_rid": "int64", "query_id": "int64", "rid": "int64", "vec_id": "int64"})
        return pd.concat([empty, *out])

    return of


def search(
    vectors: DataFrame, vec_id: str, embedding: str, queries: Column, k: int = 20, sample: int = 16_384, most_lists: int = 1 << 16, spill: float = 0.15, copies: int = 4, shade: float = 0.5, reach: float = 0.3, probes: int = 128, share: float = 0.25
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``queries`` holds, the ``k`` rows of largest inner product found, but itself."""
    spark = vectors.sparkSession
    v = F.col(embedding).cast("array<double>")
    own = vectors.select(F.monotonically_increasing_id().alias("rid"), F.col(vec_id).cast("bigint").alias("id"), v.alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    own = cut(own.where(usable(F.col("v")) & F.col("id").isNotNull()), "vectors")
    dims = own.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if dims is None:
        return own.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    own = own.where(F.size("v") == dims["d"])
    index = fit(own, dims["n"], sample, most_lists)
    send = partial(Sent, spark)
    lists = cut(own.mapInArrow(_postings(send(index), spill, copies, shade), "list bigint, first boolean, rid bigint, id bigint, v array<double>"), "postings")
    sizes = lists.groupBy("list").agg(F.count("*").alias("n"), F.sum(F.col("first").cast("int")).alias("own")).collect()  # at most most_lists rows
    held = np.zeros(len(index.centroids), np.int64)
    for r in sizes:
        held[r["list"]] = r["own"]
    asked = cut(own.where("asks").mapInArrow(_visits(send((index, held)), reach, max(probes, round(share * len(held))), k + 1), "list bigint, rid bigint, id bigint, v array<double>"), "visits")
    visits = asked.groupBy("list").agg(F.count("*").alias("m"))
    parts = F.broadcast(lists.groupBy("list").agg(F.count("*").alias("n")).join(visits, "list").select("list", F.ceil(F.col("n") / BLOCK).cast("int").alias("x"), F.ceil(F.col("m") / BLOCK).cast("int").alias("y")))
    mine = F.pmod(F.xxhash64("rid"), F.col("x")).cast("int"), F.pmod(F.xxhash64("rid"), F.col("y")).cast("int")
    rows = lists.join(parts, "list").select("list", mine[0].alias("i"), F.explode(F.sequence(F.lit(0), F.col("y") - 1)).alias("j"), "rid", "id", "v")
    asks = asked.join(parts, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("x") - 1)).alias("i"), mine[1].alias("j"), "rid", "id", "v")
    keys = ["list", "i", "j"]
    best = asks.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(_best(k), "q_rid bigint, query_id bigint, rid bigint, vec_id bigint, score double")
    once = best.groupBy("q_rid", "query_id", "rid", "vec_id").agg(F.max("score").alias("score"))  # a row may be in several lists
    order = Window.partitionBy("q_rid").orderBy(F.desc("score"), "vec_id", "rid")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
