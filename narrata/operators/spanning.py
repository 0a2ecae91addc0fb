"""Exact minimum spanning trees of mutual reachability, by Boruvka rounds.

Several ``min_samples`` values are handled at once: every table carries ``ms``.
Neighbour lists give the least edge out of a component for as long as it is
provably the least; after that the blocks are searched again, only for nodes and
cells whose bounds leave room for a lighter edge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.operators.blocks import Index, block_pairs, compare, exact, matrix, slices, squared, values
from narrata.operators.components import SMALL, connected_components, merge_ids, small_table
from narrata.shared import cut, own_columns

_SLACK = 1 - 1e-9
_BIN_EDGES = 2_000_000  # edges of one task
_RUSH = 4  # merge without searching while at least one in this many components is sure


def forest_of(lo: np.ndarray, hi: np.ndarray, w: np.ndarray, ends: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Places of the edges of a minimum spanning forest; the order is (weight, smaller node, larger node).

    ``ends`` are what the edges join, where it is not their nodes.
    """
    order = np.lexsort((hi, lo, w))
    names, ends = np.unique(np.concatenate([e[order] for e in ends or (lo, hi)]), return_inverse=True)
    a, b = ends[: len(lo)], ends[len(lo) :]
    at = np.arange(len(order))
    kept = [at[:0]]
    while len(at):
        least = np.full(len(names), len(order))
        for end in (a, b):  # the last one written is the lightest
            lightest = np.full(len(names), len(order))
            lightest[end[::-1]] = np.arange(len(at))[::-1]
            least = np.minimum(least, lightest)
        joins = np.flatnonzero(least < len(order))
        least = least[joins]
        kept.append(at[np.unique(least)])
        up = np.arange(len(names))
        up[joins] = np.where(a[least] == joins, b[least], a[least])
        mutual = (up[up] == np.arange(len(names))) & (up > np.arange(len(names)))
        up[mutual] = np.flatnonzero(mutual)
        while not np.array_equal(up, up[up]):
            up = up[up]
        a, b = up[a], up[b]
        apart = a != b
        a, b, at = a[apart], b[apart], at[apart]
    return order[np.concatenate(kept)]


def _bin(bins: int) -> Column:
    return F.pmod(F.xxhash64("lo", "hi"), F.lit(bins)).alias("bin")


def _listed_forest(neighbours: DataFrame, cores: DataFrame) -> DataFrame:
    """(ms, a, b, w): edges of the neighbour lists, of which all but those that close a cycle of lighter ones may be left out.

    The lightest edge of the lists out of any set of nodes closes no such cycle, so none that a round can ask for is lost.
    Edges are dealt into bins of about ``_BIN_EDGES``, whose forests are dealt into fewer bins while that leaves out many.
    """
    samples = sorted(r.ms for r in cores.select("ms").distinct().collect())
    names = [f"w{i}" for i in range(len(samples))]
    wide = cores.groupBy("v").agg(F.max("kd").alias("kd"), *[F.max(F.when(F.col("ms") == ms, F.col("core"))).alias(n) for ms, n in zip(samples, names)])
    wide = cut(wide, "cores")
    ends = [own_columns(wide).withColumnsRenamed({"v": e, "kd": f"kd_{e}"} | {n: f"{n}_{e}" for n in names}) for e in ("a", "b")]
    rows = neighbours.select("a", "b", "d").join(ends[0].drop("kd_a"), "a").join(ends[1], "b")
    # Of two nodes that are both in the other's list one edge is enough.
    rows = rows.where("a < b or (kd_b is not null and d >= kd_b)")
    weights = [F.greatest("d", f"{n}_a", f"{n}_b").alias(n) for n in names]
    rows = rows.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), *weights)
    schema = "ms int, lo bigint, hi bigint, w double"

    def table(ms: int, lo: np.ndarray, hi: np.ndarray, w: np.ndarray) -> pa.Table:
        kept = forest_of(lo, hi, w)
        return pa.table({"ms": pa.array(np.full(len(kept), ms), pa.int32()), "lo": lo[kept], "hi": hi[kept], "w": w[kept]})

    def of_all(x: pa.Table) -> pa.Table:
        return pa.concat_tables([table(ms, values(x, "lo"), values(x, "hi"), values(x, n)) for ms, n in zip(samples, names)])

    def of_one(x: pa.Table) -> pa.Table:
        return table(x.column("ms")[0].as_py(), values(x, "lo"), values(x, "hi"), values(x, "w"))

    n = neighbours.count()
    bins = max(1, -(-n // _BIN_EDGES))
    found = cut(rows.groupBy(_bin(bins)).applyInArrow(of_all, schema), "forests")
    while bins > 1:
        before, n = n, max([r["count"] for r in found.groupBy("ms").count().collect()], default=0)
        if n > 0.8 * before:
            break
        bins = max(1, -(-n // _BIN_EDGES))
        found = cut(found.groupBy("ms", _bin(bins)).applyInArrow(of_one, schema), "forests")
    return found.select("ms", F.col("lo").alias("a"), F.col("hi").alias("b"), "w")


def _outgoing(edges: DataFrame) -> DataFrame:
    """Least edge out of each component, from the neighbour lists read both ways."""
    both = F.array(
        F.struct(F.col("ca").alias("c"), F.col("cb").alias("other")), F.struct(F.col("cb").alias("c"), F.col("ca").alias("other"))
    )
    rows = edges.where(F.col("ca") != F.col("cb")).select(
        "ms", "w", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), F.explode(both).alias("e")
    )
    return rows.groupBy("ms", "e.c").agg(F.min(F.struct("w", "lo", "hi", "e.other")).alias("edge"))


def _status(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per component: size, how far its lists reach, and its least known edge."""
    comps = labels.groupBy("ms", "c").agg(F.count("*").alias("size"), F.min("kd").alias("reach"))
    out = comps.join(_outgoing(edges), ["ms", "c"], "left")
    # Beyond ``reach`` an unlisted edge may exist; at equality it could win the tie.
    sure = F.col("edge").isNotNull() & (F.col("reach").isNull() | (F.col("edge.w") < F.col("reach") * _SLACK))
    return out.withColumn("sure", sure)


_EDGE = "ms int, c bigint, w double, lo bigint, hi bigint, other bigint"
_EDGE_FIELDS = ("ms", "c", "w", "lo", "hi", "other")
_EDGE_TYPES = (pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())


def _least_edges(q: pa.Table, x: pa.Table) -> pa.Table:
    """Least mutual-reachability edge between two blocks for each component of the queries."""
    if not q.num_rows or not x.num_rows:
        return pa.table({f: pa.array([], t) for f, t in zip(_EDGE_FIELDS, _EDGE_TYPES)})
    qm, xm, qv, xv = matrix(q), matrix(x), values(q, "v"), values(x, "v")
    qc, xc, qr, xr = values(q, "c"), values(x, "c"), values(q, "core"), values(x, "core")
    names, at = np.unique(qc, return_inverse=True)
    best: dict[int, tuple] = {}
    step = max(1, 2_000_000 // max(1, len(xv)))
    for s in range(0, len(qv), step):
        rows = slice(s, s + step)
        d2, tolerance = squared(qm[rows], xm)
        w2 = np.maximum(d2, np.maximum(qr[rows, None] ** 2, xr[None, :] ** 2))
        w2[qc[rows, None] == xc[None, :]] = np.inf
        least = np.full(len(names), np.inf)
        np.minimum.at(least, at[rows], w2.min(1))
        i, j = np.nonzero((w2 <= least[at[rows]][:, None] + tolerance) & np.isfinite(w2))
        i = i + s
        w = np.maximum(exact(qm[i], xm[j]), np.maximum(qr[i], xr[j]))
        lo, hi = np.minimum(qv[i], xv[j]), np.maximum(qv[i], xv[j])
        order = np.lexsort((hi, lo, w, at[i]))
        for o in order[np.unique(at[i][order], return_index=True)[1]]:
            found = (w[o], lo[o], hi[o], xc[j[o]])
            best[at[i[o]]] = min(best.get(at[i[o]], found), found)
    ms = q.column("ms")[0].as_py()
    rows = [(ms, names[c], *e) for c, e in best.items()]
    columns = list(zip(*rows)) if rows else [[]] * 6
    return pa.table({f: pa.array(list(c), t) for f, c, t in zip(_EDGE_FIELDS, columns, _EDGE_TYPES)})


def _top_edges(index: Index, labels: DataFrame, seekers: DataFrame) -> DataFrame:
    """For components without any listed edge: a bound from edges to tops, which are nodes too."""
    known = labels.where(F.col("v").isin(index.top_ids.tolist())).select("ms", "v", "c", "core").toPandas()
    place = {v: i for i, v in enumerate(index.top_ids.tolist())}
    per_ms = {
        ms: (index.tops[[place[v] for v in g.v]], g.c.to_numpy(), g.core.to_numpy()) for ms, g in known.groupby("ms")
    }

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            qm, ms, c, core = matrix(batch), values(batch, "ms"), values(batch, "c"), values(batch, "core")
            out = np.full(len(c), np.inf)
            for one, (pm, pc, pr) in per_ms.items():
                rows = np.nonzero(ms == one)[0]
                if len(rows):
                    d2, tolerance = squared(qm[rows], pm)
                    w = np.maximum(np.sqrt(d2 + tolerance), np.maximum(core[rows, None], pr[None, :]))
                    w[c[rows, None] == pc[None, :]] = np.inf
                    out[rows] = w.min(1)
            yield pa.record_batch({"ms": batch.column("ms"), "c": batch.column("c"), "bound": pa.array(out)})

    found = seekers.select("ms", "c", "core", "vec").mapInArrow(bound, "ms int, c bigint, bound double")
    return found.groupBy("ms", "c").agg(F.min("bound").alias("bound"))


def _search_least(index: Index, labels: DataFrame, bounds: DataFrame) -> DataFrame:
    """Exact least edge of each component in ``bounds`` (ms, c, limit); null is no limit."""
    nodes = index.nodes.select("v", "vec", "off")
    seekers = labels.join(bounds, ["ms", "c"]).where(
        F.col("limit").isNull() | F.col("kd").isNull() | (F.col("kd") * _SLACK <= F.col("limit"))
    ).join(nodes, "v")
    seekers = cut(seekers.select("ms", "v", "c", "core", "block", "off", "limit", "vec"), "seekers")
    blind = seekers.where(F.col("limit").isNull())
    if not blind.isEmpty():
        extra = _top_edges(index, labels, blind)
        seekers = seekers.join(extra, ["ms", "c"], "left").withColumn("limit", F.coalesce("limit", "bound")).drop("bound")
        seekers = cut(seekers, "seekers")
    # A node whose own core distance is beyond the limit has no lighter edge.
    seekers = seekers.where(F.col("limit").isNull() | (F.col("core") * _SLACK <= F.col("limit")))
    keys = ["ms", "block"]
    asked = seekers.groupBy(*keys).agg(
        F.when(F.count("*") == F.count("limit"), F.max(F.col("off") + F.col("limit"))).alias("reach"), F.min("c").alias("q0"), F.max("c").alias("q1")
    )
    asked = cut(asked, "asked")
    pairs = block_pairs(index, asked.select("ms", "block", "reach"), ["ms"])
    # Blocks whose nodes all belong to the seekers' one component hold no edge out of it.
    whole = labels.groupBy("ms", F.col("block").alias("other")).agg(F.min("c").alias("x0"), F.max("c").alias("x1"))
    pairs = pairs.join(own_columns(asked.select("ms", "block", "q0", "q1")), keys).join(own_columns(whole), ["ms", "other"])
    pairs = cut(pairs.where("not (q0 = q1 and x0 = x1 and q0 = x0)").select("ms", "block", "other"), "pairs")
    data = labels.select("ms", "v", "c", "core", "block").join(nodes.drop("off"), "v")
    asking = seekers.select("ms", "v", "c", "core", "vec", "block")
    found = compare(index, pairs, asking, data, ["ms"], _least_edges, _EDGE)
    return found.groupBy("ms", "c").agg(F.min(F.struct("w", "lo", "hi", "other")).alias("edge"))


_TREE = "ms int, lo bigint, hi bigint, w double"


def _round(index: Index, labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(ms, c, edge): the edges one round adds to the tree.

    While many components are sure of their least edge, those are merged. Then
    the others are searched for, except that the largest component may wait: all
    others reach out, so the number of components at least halves.
    """
    status = cut(_status(labels, edges), "status")
    counts = status.groupBy("ms").agg(F.count("*").alias("n"), F.count_if("sure").alias("sure")).collect()
    active = [r for r in counts if r.n > 1]
    rows = status.where(F.col("ms").isin([r.ms for r in active]))
    if all(_RUSH * r.sure >= r.n for r in active):
        return rows.where("sure").select("ms", "c", "edge")
    last = status.groupBy("ms").agg(F.max_by("c", F.struct("size", "c")).alias("last"))
    rest = rows.join(F.broadcast(last), "ms").where("c <> last or sure")
    found = _search_least(index, labels, rest.where("not sure").select("ms", "c", F.col("edge.w").alias("limit")))
    known = rest.where(F.col("edge").isNotNull()).select("ms", "c", "edge")
    return known.unionByName(found).groupBy("ms", "c").agg(F.min("edge").alias("edge"))


def _between(edges: DataFrame) -> DataFrame:
    """Of the edges between few components those that close no cycle of lighter ones: fewer than there are components.

    Edges are dealt into bins of about ``_BIN_EDGES``; what each leaves is dealt again until one bin takes it.
    """
    found = edges.where("ca <> cb").select("ms", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "w", "ca", "cb")

    def least(x: pa.Table) -> pa.Table:
        kept = forest_of(values(x, "lo"), values(x, "hi"), values(x, "w"), (values(x, "ca"), values(x, "cb")))
        return x.select(["ms", "lo", "hi", "w", "ca", "cb"]).take(pa.array(kept))

    last = None
    while True:
        most = found.groupBy("ms").count().agg(F.max("count")).first()[0] or 0
        bins = max(1, -(-most // _BIN_EDGES))
        dealt = found.groupBy("ms", _bin(bins))
        found = cut(dealt.applyInArrow(least, "ms int, lo bigint, hi bigint, w double, ca bigint, cb bigint"), "between")
        if bins == 1 or (last and bins >= last):
            return found
        last = bins


def _least_known(between: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
    """(ms, c, w, lo, hi, other): the least known edge out of each component; ``base`` (ms, v, c) tells what is in them now."""
    roots = base.set_index(["ms", "v"])["c"]
    now = [roots.loc[pd.MultiIndex.from_frame(between[["ms", e]])].to_numpy() for e in ("ca", "cb")]
    both = [between.assign(c=now[i], other=now[1 - i]) for i in (0, 1)]
    rows = pd.concat(both).query("c != other").sort_values(["w", "lo", "hi"])
    return rows.drop_duplicates(["ms", "c"])[["ms", "c", "w", "lo", "hi", "other"]]


def _short_rounds(index: Index, labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The remaining rounds once the components are few.

    The component list lives on the driver (its length has been checked), and so do the listed edges between them, of
    which about as many are left; the points stay in Spark and are relabelled by a broadcast map.
    """
    spark = labels.sparkSession
    base = labels.groupBy("ms", F.col("c").alias("v")).agg(F.count("*").alias("size"), F.min("kd").alias("reach")).toPandas()
    base["c"], base["reach"] = base["v"], base["reach"].astype(float).fillna(np.inf)
    between = _between(edges).toPandas()
    tree: list[pd.DataFrame] = []
    while True:
        comps = base.groupby(["ms", "c"], as_index=False).agg(size=("size", "sum"), reach=("reach", "min"))
        comps = comps[comps.groupby("ms")["c"].transform("count") > 1]
        if comps.empty:
            break
        comps = comps.merge(_least_known(between, base), on=["ms", "c"], how="left")
        comps["sure"] = comps["w"].notna() & (comps["w"] < comps["reach"] * _SLACK)
        if (comps.groupby("ms")["sure"].mean() * _RUSH >= 1).all():
            chosen = comps[comps["sure"]]
        else:
            last = comps.sort_values(["size", "c"]).groupby("ms")["c"].transform("last").reindex(comps.index)
            rest = comps[(comps["c"] != last) | comps["sure"]]
            unsure = rest[~rest["sure"]]
            limits = [(int(r.ms), int(r.c), None if np.isnan(r.w) else float(r.w)) for r in unsure.itertuples()]
            bounds = F.broadcast(spark.createDataFrame(limits, "ms int, c bigint, limit double"))
            roots = F.broadcast(small_table(spark, base[["ms", "v", "c"]], "ms int, v bigint, root bigint"))
            now_labels = _relabel(labels, roots, ["c"]) if tree else labels
            found = _search_least(index, now_labels, bounds).select("ms", "c", "edge.*").toPandas()
            chosen = pd.concat([rest[rest["w"].notna()][found.columns], found])
            chosen = chosen.sort_values(["w", "lo", "hi"]).drop_duplicates(["ms", "c"])
        chosen = chosen.astype({"lo": "int64", "hi": "int64", "other": "int64"})
        tree.append(chosen[["ms", "lo", "hi", "w"]])
        merged = merge_ids(chosen.rename(columns={"c": "a", "other": "b"}), "ms").rename(columns={"v": "c"})
        base = base.merge(merged, on=["ms", "c"], how="left")
        base["c"] = base.pop("root").fillna(base["c"]).astype("int64")
    rows = pd.concat(tree) if tree else pd.DataFrame(columns=["ms", "lo", "hi", "w"])
    return small_table(spark, rows, _TREE)


def _relabel(df: DataFrame, roots: DataFrame, columns: list[str]) -> DataFrame:
    for name in columns:
        m = roots.select("ms", F.col("v").alias(name), F.col("root").alias("_root"))
        df = df.join(m, ["ms", name], "left").withColumn(name, F.coalesce("_root", name)).drop("_root")
    return df


def spanning_edges(index: Index, neighbours: DataFrame, cores: DataFrame, small: int = SMALL) -> DataFrame:
    """(ms, a, b, w): the minimum spanning tree of the nodes for each ``ms``.

    Ties are broken by (weight, smaller node, larger node), so trees do not depend
    on row order.
    """
    labels = cut(cores.withColumn("c", F.col("v")).select("ms", "v", "core", "kd", "block", "c"), "components")
    forest = _listed_forest(neighbours, cores)
    edges = cut(forest.select("ms", "a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb")), "edges")
    trees = []
    while (n := labels.agg(F.count_distinct("ms", "c")).first()[0]) > small and n > labels.select("ms").distinct().count():
        chosen = cut(_round(index, labels, edges), "chosen")
        trees.append(chosen.select("ms", "edge.lo", "edge.hi", "edge.w"))
        roots = connected_components(chosen.select("ms", F.col("c").alias("a"), F.col("edge.other").alias("b")), "ms", small)
        labels = cut(_relabel(labels, roots, ["c"]), "components")
        edges = cut(_relabel(edges, roots, ["ca", "cb"]).where("ca <> cb"), "edges")
    tree = _short_rounds(index, labels, edges)
    for t in trees:
        tree = tree.unionByName(t)
    # Two components may have chosen the same edge.
    return tree.distinct().select("ms", F.col("lo").alias("a"), F.col("hi").alias("b"), "w")
