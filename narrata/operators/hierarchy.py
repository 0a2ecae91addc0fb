"""The merge tree of a minimum spanning tree, and its clusters for any number of least cluster sizes.

**Bands.** A tree with more edges than one task should hold is cut at its median weight. What lighter edges join becomes
one node, what edges of just that weight join then becomes one node, and the heavier edges form a tree of those nodes. The
three parts can be worked on at the same time and are cut again until every part fits a task, so there are about
log2(edges / bound) cuts whatever the shape of the tree, and equal weights never stand in two parts. A node that stands for
others is named by the last edge inside it, which no other node has: ``-1 - e``.

**Segments.** A task merges its part once and then walks the merges from the bottom up for each least size. A merge that
two or more large children meet in ends their clusters and starts a new one; a single large child is carried on. The sizes
of nodes are known, but not what lies in them, so the run of a cluster through a part is a *segment*: it starts at a merge
or goes on from a node, and it ends at a merge or at the part's last one. A segment that starts and ends inside a part,
with all clusters in it, is settled there: only its value is handed up. The others are rows.

**Contraction.** Segments that go on from one another are summed into clusters. The value of a cluster, the larger of its
stability and its inner clusters' values together, is settled by rounds of raking leaves and splicing out clusters with a
single open one inside, so the rounds grow with the logarithm of the number of clusters. A cluster is chosen when its
stability is at least the value inside it; the outermost chosen one counts, and the root is never chosen.

References: Campello et al. (2013); McInnes and Healy (2017); Miller and Reif (1985).
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.operators.blocks import values
from narrata.operators.components import SMALL, connected_components
from narrata.shared import cut, drop, own_columns

PART_EDGES = 100_000  # bound on the edges of a part, and so of a task
_FLOOR = 1e-12  # least merge distance, so copies have a finite density

# Segments and clusters are named by the node they start at, or go on from.
_START, _ON = 0, 1
_ROW = (
    "kind string, run int, id bigint, below bigint, at bigint, mass double, inner double, size bigint, birth double, "
    "parent bigint, top bigint, open bigint"
)


# ---------------------------------------------------------------------------------------------------------------- bands


def _ends(edges: DataFrame, *keys: str) -> DataFrame:
    return edges.select(*keys, F.explode(F.array("a", "b")).alias("v")).distinct()


def _contracted(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(member, new node) of what ``edges`` join, the new nodes, and the edges with the new node around them."""
    comps = connected_components(edges, "ms", 0)
    placed = edges.join(comps.withColumnsRenamed({"v": "a"}), ["ms", "a"])
    names = placed.groupBy("ms", "root").agg((-1 - F.max("e")).alias("name"))
    members = cut(comps.join(names, ["ms", "root"]).select("ms", "v", "name"), "members")
    made = members.join(nodes, ["ms", "v"]).groupBy("ms", F.col("name").alias("v")).agg(F.sum("m").alias("m"), F.lit(0.0).alias("core"))
    return members, made, placed.join(names, ["ms", "root"]).drop("root")


def _moved(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges between what their ends lie in now."""
    for end in ("a", "b"):
        edges = edges.join(members.withColumnRenamed("v", end), ["ms", end], "left")
        edges = edges.withColumn(end, F.coalesce("name", end)).drop("name")
    return edges


def bands(tree: DataFrame, cores: DataFrame, part_edges: int = PART_EDGES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts of the tree (ms, a, b, w) over the nodes ``cores`` (ms, v, m, core).

    Gives (ms, part, a, b, w, e) with at most ``part_edges`` edges a part, (ms, part, v, m, core, w) of the ends of edges of
    equal weight that were merged as a whole, and all nodes (ms, v, m, core).
    """
    ordered = tree.repartitionByRange("w", "a", "b").sortWithinPartitions("w", "a", "b")
    edges = cut(ordered.withColumn("e", F.monotonically_increasing_id()), "tree")
    roots = edges.groupBy("ms").agg((-1 - F.max("e")).alias("part"))
    edges = edges.join(F.broadcast(roots), "ms")  # one row per tree
    nodes = cores.select("ms", "v", "m", "core")
    parts, level = [], []
    while True:
        sizes = cut(edges.groupBy("ms", "part").agg(F.count("*").alias("n"), F.percentile_approx("w", 0.5, 1000).alias("middle")), "sizes")
        large = sizes.where(F.col("n") > part_edges).select("ms", "part", "middle")
        if large.isEmpty():
            break
        parts.append(edges.join(large, ["ms", "part"], "left_anti"))
        rest = cut(edges.join(large, ["ms", "part"]), "rest")
        inside, made, light = _contracted(rest.where("w < middle"), nodes)
        nodes = nodes.unionByName(made)
        rest = cut(_moved(rest.where("w >= middle"), inside), "moved")
        inside, made, equal = _contracted(rest.where("w = middle"), nodes)
        level.append(_ends(equal.select("ms", F.col("name").alias("part"), "a", "b", "w"), "ms", "part", "w").join(nodes, ["ms", "v"]))
        known = equal.where("name = part").select("ms", F.col("name").alias("v")).distinct()  # a whole part, which is a node already
        nodes = cut(nodes.unionByName(made.join(known, ["ms", "v"], "left_anti")), "nodes")
        heavy = _moved(rest.where("w > middle"), inside)
        columns = ["ms", "part", "a", "b", "w", "e"]
        edges = cut(light.withColumn("part", F.col("name")).select(*columns).unionByName(heavy.select(*columns)), "edges")
    for p in parts:
        edges = edges.unionByName(p)
    joined = nodes.select("ms", F.lit(0).cast("bigint").alias("part"), "v", "m", "core", F.lit(0.0).alias("w")).limit(0)
    for x in level:
        joined = joined.unionByName(x.select(*joined.columns))
    return edges, joined, nodes


# ------------------------------------------------------------------------------------------------------- inside a part


@dataclass
class _Merges:
    """The merges of a part, lightest first: each joins children, which are its nodes (0 to n - 1) and earlier merges."""

    ids: np.ndarray  # of the nodes
    size: list[int]
    weight: list[float]
    name: list[int]
    children: list[list[int]]


def merge_part(edges: pa.Table, nodes: pa.Table) -> _Merges:
    order = np.argsort(values(nodes, "v"))
    ids, m, core = (values(nodes, c)[order] for c in ("v", "m", "core"))
    n = len(ids)
    a, b = np.searchsorted(ids, values(edges, "a")), np.searchsorted(ids, values(edges, "b"))
    w, e = values(edges, "w"), values(edges, "e")
    order = np.lexsort((e, w))
    a, b, w, e = a[order].tolist(), b[order].tolist(), w[order], e[order].tolist()
    root, at = list(range(n)), list(range(n))  # union-find over nodes; ``at``: what a root's set is now
    out = _Merges(ids, m.tolist(), core.tolist(), ids.tolist(), [[] for _ in range(n)])

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = v = root[root[v]]
        return v

    starts = np.nonzero(np.diff(w, prepend=-1.0))[0].tolist()
    for start, stop in zip(starts, [*starts[1:], len(w)]):
        met: dict[int, list[int]] = {}  # edges of equal weight act at once
        last: dict[int, int] = {}
        for i in range(start, stop):
            x, y = find(a[i]), find(b[i])
            kids = met.pop(x, None) or [at[x]]
            kids += met.pop(y, None) or [at[y]]
            last.pop(x, None), last.pop(y, None)
            root[y] = x
            met[x], last[x] = kids, e[i]
        for x, kids in met.items():
            at[x] = len(out.size)
            out.size.append(sum(out.size[k] for k in kids))
            out.weight.append(float(w[start]))
            out.name.append(-1 - last[x])
            out.children.append(kids)
    return out


@dataclass
class _Segment:
    name: int
    below: int | None  # the node it goes on from
    mass: float = 0.0
    inner: float = 0.0
    whole: bool = True  # all clusters inside are settled
    parent: int | None = None  # the segment it ends in
    size: int = 0
    birth: float = 0.0
    chosen: bool = False


def _walk(t: _Merges, part: int, least: int, run: int) -> list[tuple]:
    """Rows of a part for one least cluster size, in the order of ``_ROW``."""
    n = len(t.ids)
    segments: list[_Segment] = []
    of: dict[int, int] = {}  # large child or merge -> its segment
    rows: list[tuple] = []
    if t.size[-1] < least:
        return [("lift", run, int(v), None, part, *(None,) * 7) for v in t.ids]
    falls: list[int | None] = [None] * len(t.size)

    def begin(name: int, kind: int, below: int | None, mass: float) -> int:
        segments.append(_Segment(2 * name + kind, below, mass, whole=kind == _START))
        return len(segments) - 1

    for g in range(n, len(t.size)):
        if t.size[g] < least:
            continue
        density = 1.0 / max(t.weight[g], _FLOOR)
        large = []
        for k in t.children[g]:
            if k in of:
                large.append(k)
            elif k < n and t.size[k] >= least:
                v, core = t.name[k], t.weight[k]
                if v < 0:
                    of[k] = begin(v, _ON, v, 0.0)
                    large.append(k)
                elif core < t.weight[g]:  # enough copies of one vector, up to where they meet others
                    of[k] = begin(v, _START, None, t.size[k] / max(core, _FLOOR))
                    falls[k] = of[k]
                    large.append(k)
        if len(large) == 1:
            s = of[large[0]]
            segments[s].mass += (t.size[g] - t.size[large[0]]) * density
        else:
            s = begin(t.name[g], _START, None, t.size[g] * density)
            for k in large:
                ended = segments[of[k]]
                ended.parent, ended.size, ended.birth = s, t.size[k], density
                if ended.whole:
                    stability = ended.mass - ended.size * density
                    ended.chosen = stability >= ended.inner
                    segments[s].inner += max(stability, ended.inner)
                else:
                    segments[s].whole = False
        of[g] = s
        for k in t.children[g]:
            if k not in of:
                falls[k] = s
    # From the top down: where small parts fall, and the outermost chosen settled cluster around each segment.
    for g in range(len(t.size) - 1, n - 1, -1):
        if g not in of:
            for k in t.children[g]:
                falls[k] = falls[g]
    top: list[int | None] = [None] * len(segments)
    open_ = [0] * len(segments)
    for s in range(len(segments) - 1, -1, -1):
        x = segments[s]
        if x.parent is not None and x.whole:
            top[s] = top[x.parent] if top[x.parent] is not None else x.name if x.chosen else None
            open_[s] = open_[x.parent]
        else:
            open_[s] = s
            parent = None if x.parent is None else segments[x.parent].name
            at = part if x.parent is None else None
            rows.append(("segment", run, x.name, x.below, at, x.mass, x.inner, x.size, x.birth, parent, None, None))
    for k in range(n):
        if falls[k] is not None:
            s = falls[k]
            rows.append(("fall", run, t.name[k], None, None, None, None, None, None, None, top[s], segments[open_[s]].name))
    return rows


def _merge_all(edges: pa.Table, nodes: pa.Table, runs: dict[int, list[tuple[int, int]]]) -> pa.Table:
    """Rows of all parts of a bin, for every run with their ``ms``."""
    rows: list[tuple] = []
    ep, np_ = values(edges, "part"), values(nodes, "part")
    eo, no = np.argsort(ep, kind="stable"), np.argsort(np_, kind="stable")
    names, starts = np.unique(ep[eo], return_index=True)
    edges, nodes = edges.take(pa.array(eo)), nodes.take(pa.array(no))
    low, high = np.searchsorted(np_[no], names), np.searchsorted(np_[no], names, "right")
    for name, start, stop, x, y in zip(names.tolist(), starts, [*starts[1:], len(eo)], low, high):
        merges = merge_part(edges.slice(start, stop - start), nodes.slice(x, y - x))
        for run, least in runs[edges.column("ms")[0].as_py()]:
            rows += _walk(merges, name, least, run)
    fields = [c.split() for c in _ROW.split(", ")]
    types = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
    columns = list(zip(*rows)) if rows else [[]] * len(fields)
    return pa.table({n: pa.array(list(c), types[t]) for (n, t), c in zip(fields, columns)})


def _merge_equal(joined: DataFrame, grid: DataFrame) -> DataFrame:
    """Rows of the parts whose edges all weigh the same: one merge of any number of children."""
    x = joined.join(grid, "ms").withColumn("density", 1.0 / F.greatest("w", F.lit(_FLOOR)))
    node = F.col("v") < 0
    large = (F.col("m") >= F.col("least")) & (node | (F.col("core") < F.col("w")))
    x = x.withColumn("child", F.when(large, 2 * F.col("v") + F.when(node, _ON).otherwise(_START)))
    x = x.withColumn("born", F.when(large & ~node, F.col("m") / F.greatest("core", F.lit(_FLOOR))).otherwise(0.0))
    merges = x.groupBy("run", "part").agg(
        F.sum("m").alias("size"), F.max("least").alias("least"), F.max("density").alias("density"), F.count("child").alias("n_large"),
        F.sum(F.when(large, F.col("m"))).alias("held"), F.max("child").alias("only"), F.max(F.when(large & node, F.col("v"))).alias("below"),
        F.sum("born").alias("born"),
    )
    merges = cut(merges, "equal")
    own = F.when(F.col("n_large") == 1, F.col("only")).otherwise(2 * F.col("part") + _START)
    big = merges.where(F.col("size") >= F.col("least")).withColumn("own", own)
    none = F.lit(None)
    one = F.col("n_large") == 1
    mass = F.col("density") * (F.col("size") - F.when(one, F.col("held")).otherwise(0)) + F.when(one, F.col("born")).otherwise(0.0)
    columns = [c.split() for c in _ROW.split(", ")]

    def rows(df: DataFrame, kind: str, **given: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), "run", *[given.get(n, none).cast(t).alias(n) for n, t in columns[2:]])

    zero = F.lit(0.0)
    tops = rows(big, "segment", id=F.col("own"), below=F.when(one, F.col("below")), at=F.col("part"), mass=mass, inner=zero, size=F.lit(0), birth=zero)
    inside = x.drop("density").join(big.select("run", "part", "own", "n_large", F.col("density")), ["run", "part"])
    ended = inside.where("child is not null and n_large > 1")
    ends = rows(
        ended, "segment", id=F.col("child"), below=F.when(node, F.col("v")), mass=F.col("born"), inner=zero, size=F.col("m"),
        birth=F.col("density"), parent=F.col("own"),
    )
    falling = inside.where("child is null or v >= 0")
    falls = rows(falling, "fall", id=F.col("v"), open=F.coalesce("child", "own"))
    lifted = x.join(merges.where(F.col("size") < F.col("least")).select("run", "part"), ["run", "part"])
    return tops.unionByName(ends).unionByName(falls).unionByName(rows(lifted, "lift", id=F.col("v"), at=F.col("part")))


# ------------------------------------------------------------------------------------------------------- between parts


def _settled_here(clusters: pd.DataFrame) -> list[tuple[int, int, bool]]:
    """(run, c, chosen) of a short list of clusters (run, c, parent, stability, inner)."""
    rows = {(r.run, r.c): r for r in clusters.itertuples()}
    up = {k: None if pd.isna(r.parent) else (r.run, int(r.parent)) for k, r in rows.items()}
    inner = {k: float(r.inner) for k, r in rows.items()}
    waiting = Counter(p for p in up.values() if p is not None)
    ready = [k for k in rows if not waiting[k]]
    for k in ready:  # grows: a cluster follows the last one inside it
        if (p := up[k]) in rows:
            inner[p] += max(float(rows[k].stability), inner[k])
            waiting[p] -= 1
            if not waiting[p]:
                ready.append(p)
    return [(int(k[0]), int(k[1]), up[k] is not None and bool(rows[k].stability >= inner[k])) for k in ready]


def _settled(clusters: DataFrame, small: int = SMALL) -> DataFrame:
    """(run, c, chosen) of ``clusters`` (run, c, parent, stability, inner); a null parent is the root, never chosen.

    A cluster is the function x -> max(stability, inner + x) of what its open inner clusters are worth; what a cluster is
    worth reaches its parent through y -> max(low, add + y). Leaves hand their worth up; a cluster with a single open one
    inside is spliced out: its function joins the inner one's way up, and is kept to look its own worth up in the end. Of
    neighbours on such a way only those are spliced out whose hash is less than the one below. Up to ``small`` clusters are
    settled on the driver.
    """
    if clusters.limit(small + 1).count() <= small:
        rows = _settled_here(clusters.select("run", "c", "parent", "stability", "inner").toPandas())
        return clusters.sparkSession.createDataFrame(rows, "run int, c bigint, chosen boolean")
    low, add = F.lit(float("-inf")).alias("low"), F.lit(0.0).alias("add")
    live = cut(clusters.select("*", low, add), "live")
    worth = []  # (run, c, worth), the worth inside it
    spliced = []
    while True:
        inside = live.where("parent is not null").groupBy("run", F.col("parent").alias("c")).agg(F.count("*").alias("n"), F.max("c").alias("only"))
        counted = cut(live.join(inside, ["run", "c"], "left").withColumn("n", F.coalesce("n", F.lit(0))), "counted")
        leaves = counted.where("n = 0").withColumn("worth", F.greatest("stability", "inner"))
        leaves = cut(leaves, "leaves")
        if leaves.isEmpty():
            break
        worth.append(leaves.select("run", "c", "worth", "inner", "stability", "parent"))
        given = leaves.where("parent is not null").groupBy("run", F.col("parent").alias("c")).agg(F.sum(F.greatest("low", F.col("add") + F.col("worth"))).alias("given"))
        live = counted.where("n > 0").join(given, ["run", "c"], "left").withColumn("inner", F.col("inner") + F.coalesce("given", F.lit(0.0)))
        live = cut(live.drop("n", "only", "given"), "live")
        # Splice: c has one open cluster d inside, and a parent.
        inside = live.where("parent is not null").groupBy("run", F.col("parent").alias("c")).agg(F.count("*").alias("n"), F.max("c").alias("d"))
        single = live.join(inside.where("n = 1").select("run", "c", "d"), ["run", "c"]).where("parent is not null")
        single = cut(single, "single")
        draw = F.xxhash64("run", "c")
        below = own_columns(single.select("run", F.col("c").alias("d"), draw.alias("under")))
        above = own_columns(single.select("run", F.col("d").alias("c"), draw.alias("over")))
        out = single.join(below, ["run", "d"], "left").join(above, ["run", "c"], "left")
        out = out.where((F.col("under").isNull() | (draw < F.col("under"))) & (F.col("over").isNull() | (draw < F.col("over"))))
        out = cut(out.select("run", "c", "d", "parent", "stability", "inner", "low", "add"), "spliced")
        if out.isEmpty():
            continue
        ways = live.select("run", F.col("c").alias("d"), F.col("low").alias("d_low"), F.col("add").alias("d_add"))
        spliced.append(cut(out.join(ways, ["run", "d"]).select("run", "c", "d", "stability", "inner", "d_low", "d_add", "parent"), "ways"))
        # y -> max(low, add + max(stability, inner + max(d_low, d_add + y)))
        up = out.select(
            "run", F.col("d").alias("c"), F.col("parent").alias("p"), F.col("stability").alias("s"), F.col("inner").alias("i"),
            F.col("low").alias("l"), F.col("add").alias("x"),
        )
        live = live.join(out.select("run", "c"), ["run", "c"], "left_anti").join(up, ["run", "c"], "left")
        changed = F.col("p").isNotNull()
        live = cut(live.select(
            "run", "c", F.when(changed, F.col("p")).otherwise(F.col("parent")).alias("parent"), "stability", "inner",
            F.when(changed, F.greatest("l", F.col("x") + F.col("s"), F.col("x") + F.col("i") + F.col("low"))).otherwise(F.col("low")).alias("low"),
            F.when(changed, F.col("x") + F.col("i") + F.col("add")).otherwise(F.col("add")).alias("add"),
        ), "live")
    known = worth[0] if worth else clusters.select("run", "c", "stability", "inner", "parent").withColumn("worth", F.lit(0.0)).limit(0)
    for w in worth[1:]:
        known = known.unionByName(w)
    columns = ["run", "c", "worth", "inner", "stability", "parent"]
    known = cut(known.select(*columns), "known")
    for s in reversed(spliced):
        found = s.join(known.select("run", F.col("c").alias("d"), F.col("worth").alias("y")), ["run", "d"])
        found = found.withColumn("inner", F.col("inner") + F.greatest("d_low", F.col("d_add") + F.col("y")))
        known = cut(known.unionByName(found.withColumn("worth", F.greatest("stability", "inner")).select(*columns)), "known")
    return known.select("run", "c", (F.col("parent").isNotNull() & (F.col("stability") >= F.col("inner"))).alias("chosen"))


def _outermost(clusters: DataFrame) -> DataFrame:
    """(run, c, best): the outermost chosen cluster on the way up from each, itself included, by pointer doubling."""
    ways = cut(clusters.select("run", "c", F.col("parent").alias("up"), F.when(F.col("chosen"), F.col("c")).alias("best")), "ways")
    while not ways.where("up is not null").isEmpty():
        above = own_columns(ways.select("run", F.col("c").alias("up"), F.col("up").alias("up2"), F.col("best").alias("best2")))
        last, ways = ways, ways.join(above, ["run", "up"], "left").select("run", "c", F.col("up2").alias("up"), F.coalesce("best2", "best").alias("best"))
        ways = cut(ways, "ways")
        drop(last)
    return ways.select("run", "c", "best")


def _landed(rows: DataFrame) -> DataFrame:
    """(run, v, top, open) of all points: those of small parts fall where the node that stands for the part falls."""
    falls = rows.where("kind = 'fall'").select("run", F.col("id").alias("v"), "top", "open")
    points = falls.where("v >= 0")
    ways = rows.where("kind = 'lift'").select("run", F.col("id").alias("v"), F.col("at").alias("up"))
    if ways.isEmpty():
        return points
    ends = falls.where("v < 0").withColumn("up", F.lit(None).cast("bigint"))
    nodes = cut(ends.unionByName(ways.where("v < 0").select("run", "v", F.lit(None).cast("bigint").alias("top"), F.lit(None).cast("bigint").alias("open"), "up")), "nodes")

    def followed(df: DataFrame) -> DataFrame:
        above = own_columns(nodes.select("run", F.col("v").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"), F.col("open").alias("open2")))
        df = df.join(above, ["run", "up"], "left")
        return df.select("run", "v", F.coalesce("top", "top2").alias("top"), F.coalesce("open", "open2").alias("open"), F.col("up2").alias("up"))

    while not nodes.where("up is not null").isEmpty():
        last, nodes = nodes, cut(followed(nodes), "nodes")
        drop(last)
    lifted = ways.where("v >= 0").select("run", "v", F.lit(None).cast("bigint").alias("top"), F.lit(None).cast("bigint").alias("open"), "up")
    return points.unionByName(followed(lifted).drop("up"))


def condense(
    tree: DataFrame, cores: DataFrame, runs: list[tuple[int, int, int]], part_edges: int = PART_EDGES, small: int = SMALL
) -> DataFrame:
    """(run, v, cluster): the chosen cluster of every node, null for noise.

    ``runs`` are (run, min_cluster_size, min_samples). The merges of a tree are found once for all runs that share it.
    """
    spark = tree.sparkSession
    per_ms: dict[int, list[tuple[int, int]]] = {}
    for run, least, ms in runs:
        per_ms.setdefault(ms, []).append((run, least))
    grid = F.broadcast(spark.createDataFrame([(run, least, ms) for run, least, ms in runs], "run int, least bigint, ms int"))
    edges, joined, nodes = bands(tree, cores, part_edges)
    edges = cut(edges, "bands")
    bins = max(1, -(-edges.count() // part_edges))

    def dealt(df: DataFrame) -> DataFrame:
        return own_columns(df.withColumn("bin", F.pmod(F.xxhash64("ms", "part"), F.lit(bins)))).groupBy("ms", "bin")

    def merge(left: pa.Table, right: pa.Table) -> pa.Table:
        return _merge_all(left, right, per_ms)

    ends = _ends(edges, "ms", "part").join(nodes, ["ms", "v"])
    rows = dealt(edges).cogroup(dealt(ends)).applyInArrow(merge, _ROW)
    rows = cut(rows.unionByName(_merge_equal(joined, grid)), "segments")
    points = cores.join(grid, "ms").select("run", "v")
    landed = _landed(rows)
    segments = rows.where("kind = 'segment'").drop("kind", "top", "open")
    # A segment that goes on from a node is the same cluster as the one that stays open in the part the node stands for.
    on = segments.where("below is not null").select("run", F.col("below").alias("at"), F.col("id").alias("b"))
    chain = segments.where("at is not null").select("run", "at", F.col("id").alias("a")).join(on, ["run", "at"]).select("run", "a", "b")
    if chain.isEmpty():
        named = segments.select("run", "id", F.col("id").alias("c"))
    else:
        roots = connected_components(cut(chain, "chain"), "run", 0).withColumnsRenamed({"v": "id", "root": "c"})
        named = cut(segments.select("run", "id").join(roots, ["run", "id"], "left").select("run", "id", F.coalesce("c", "id").alias("c")), "named")
    clusters = segments.join(named, ["run", "id"]).groupBy("run", "c").agg(
        F.sum("mass").alias("mass"), F.sum("inner").alias("inner"), F.max("size").alias("size"), F.max("birth").alias("birth"), F.max("parent").alias("id")
    )
    up = own_columns(named.select("run", "id", F.col("c").alias("parent")))
    clusters = clusters.join(up, ["run", "id"], "left").withColumn("stability", F.col("mass") - F.col("size") * F.col("birth"))
    clusters = cut(clusters.select("run", "c", "parent", "stability", "inner"), "clusters")
    if clusters.where("parent is not null").isEmpty():  # all clusters were settled inside their part
        found = landed.select("run", "v", F.col("top").alias("cluster"))
    else:
        chosen = clusters.select("run", "c", "parent").join(_settled(clusters, small), ["run", "c"])
        best = _outermost(chosen).join(named, ["run", "c"]).select("run", F.col("id").alias("open"), "best")
        found = landed.join(best, ["run", "open"], "left").select("run", "v", F.coalesce("best", "top").alias("cluster"))
    return points.join(found, ["run", "v"], "left")
