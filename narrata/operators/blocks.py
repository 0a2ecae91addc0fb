"""Exact nearest-neighbour search over blocks of vectors.

Every so many rows, by hash, one is a *pivot*, so pivots lie as densely as the rows and their number grows with them. About
the square root of that many *tops* are broadcast; a row looks for its pivot only among those of the nearest top. The rows
of a pivot are a *block*, divided by hash if it is crowded. All that is known of a block is one row: its pivot, the largest
distance of a row from it, and its size.

A search first looks into each row's own block, which bounds how far its other neighbours can be. A pair of blocks can
then be ruled out by the triangle inequality: no row of a block is nearer to a row of another than the distance of their
pivots less what both rows lie off them. Tops rule out all their blocks at once. The nearest blocks are compared first;
what they bring shrinks the bounds, and only pairs that are left are compared after them. Blocks that ask are dealt into
groups, and what a group is compared with into lots, so a row moves at most once for each group or lot, however many pairs
of blocks it is compared in. There are about ``fan`` groups and lots until a side of a task would exceed ``task_rows``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.operators.ranking import first_per_group
from narrata.shared import cut, own_columns


@dataclass(frozen=True)
class BlockSettings:
    pivot_rows: int = 1024  # a pivot for every so many rows
    block_rows: int = 16_384  # bound on rows of a block
    first: int = 4  # blocks that are compared before bounds are tightened
    task_rows: int = 65_536  # about the most rows of one side in one task of a comparison
    fan: int = 8  # groups, and lots, of a comparison of everything with everything
    stream_rows: int = 32_768  # about the most queries of a task in the search for neighbours


@dataclass(frozen=True)
class Index:
    """Distinct vectors with their block, the blocks' geometry, and that of the tops."""

    nodes: DataFrame  # v, rep, m, vec, block, off: the distance from the block's pivot
    blocks: DataFrame  # block, top, pivot, radius, n
    n: int  # distinct vectors
    total: int  # vectors
    tops: np.ndarray
    top_ids: np.ndarray
    top_radius: np.ndarray
    settings: BlockSettings


def matrix(table: pa.Table | pa.RecordBatch, name: str = "vec") -> np.ndarray:
    column = table.column(name)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def values(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    return table.column(name).to_numpy() if isinstance(table, pa.Table) else table.column(name).to_numpy(zero_copy_only=False)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a rows x cells matrix stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def squared(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances by matrix product, and a bound on their rounding error."""
    qq, xx = (q * q).sum(1), (x * x).sum(1)
    d2 = qq[:, None] + xx[None, :] - 2.0 * (q @ x.T)
    return np.maximum(d2, 0.0), 1e-12 * float(qq.max(initial=0.0) + xx.max(initial=0.0))


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of paired rows; the same to the last bit in either direction."""
    return np.sqrt(((q - x) ** 2).sum(1))


_WIDEN = 1 + 1e-9  # bounds give way to rounding


def _sample(nodes: DataFrame, n: int, wanted: int) -> pa.Table:
    """About ``wanted`` nodes by hash; no task sends more than its share of them."""
    few = nodes.where(F.pmod(F.xxhash64("rep"), F.lit(max(1, n))) < 2 * wanted + 32).select("v", "vec", "rep")
    rows = few.orderBy(F.xxhash64("rep"), "v").limit(wanted).select("v", "vec").toArrow()
    return rows if rows.num_rows else nodes.select("v", "vec").limit(1).toArrow()


def build_index(points: DataFrame, settings: BlockSettings) -> Index:
    """Index of ``points`` (post_id, vec).

    Equal vectors become one node with a count, so a group of copies of any size
    is one row from here on. Node numbers follow the order of post ids, which
    makes every later tie-break independent of how rows are laid out.
    """
    nodes = points.groupBy("vec").agg(F.min("post_id").alias("rep"), F.count("*").alias("m"))
    ordered = nodes.repartitionByRange("rep").sortWithinPartitions("rep")
    nodes = cut(ordered.select(F.monotonically_increasing_id().alias("v"), "rep", "m", "vec"), "nodes")
    n, total = nodes.agg(F.count("*"), F.coalesce(F.sum("m"), F.lit(0))).first()
    sample = _sample(nodes, n, int(max(1, np.ceil(np.sqrt(n / settings.pivot_rows)))))
    tops, top_ids = matrix(sample) if n else np.zeros((1, 1)), values(sample, "v")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            d2, tolerance = squared(matrix(batch), tops)
            top = d2.argmin(1)
            reach = np.sqrt(d2[np.arange(len(top)), top] + tolerance)
            yield batch.append_column("top", pa.array(top, pa.int32())).append_column("reach", pa.array(reach))

    schema = "v bigint, rep string, m bigint, vec array<double>, top int, reach double"
    nodes = cut(nodes.mapInArrow(place, schema), "tops")
    top_radius = np.zeros(len(tops))
    for row in nodes.groupBy("top").agg(F.max("reach").alias("r")).collect():  # one row per top
        top_radius[row.top] = row.r
    nodes, blocks = _blocks(nodes.drop("reach"), top_ids, settings)
    return Index(nodes, blocks, n, total, tops, top_ids, top_radius, settings)


def _blocks(nodes: DataFrame, top_ids: np.ndarray, s: BlockSettings) -> tuple[DataFrame, DataFrame]:
    """Nodes with their block and distance from its pivot, and the blocks."""
    chosen = (F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(s.pivot_rows)) == 0) | F.col("v").isin(top_ids.tolist())
    pivots = own_columns(nodes.where(chosen).select("top", "v", "vec"))
    parts = nodes.groupBy("top").agg(F.ceil(F.count("*") / s.block_rows).cast("int").alias("parts"))
    rows = nodes.join(parts, "top").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")).drop("parts")
    spread = pivots.join(own_columns(parts), "top").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left.append_column("cell", pa.array([], pa.int64())).append_column("off", pa.array([], pa.float64())).drop_columns(["part"])
        order = np.argsort(values(right, "v"))
        pm, pv = matrix(right)[order], values(right, "v")[order]
        qm = matrix(left)
        cell, off = np.empty(len(qm), np.int64), np.empty(len(qm))
        for start in range(0, len(qm), 1024):
            rows = slice(start, start + 1024)
            found = squared(qm[rows], pm)[0].argmin(1)
            cell[rows], off[rows] = pv[found], exact(qm[rows], pm[found])
        return left.append_column("cell", pa.array(cell)).append_column("off", pa.array(off)).drop_columns(["part"])

    schema = "v bigint, rep string, m bigint, vec array<double>, top int, cell bigint, off double"
    rows = rows.select("v", "rep", "m", "vec", "top", "part")
    placed = rows.groupBy("top", "part").cogroup(spread.groupBy("top", "part")).applyInArrow(nearest, schema)
    placed = cut(placed, "cells")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / s.block_rows).cast("int").alias("parts"))
    placed = placed.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("v", F.lit(2)), F.col("parts")).cast("int"))
    blocks = placed.groupBy("top", "cell", "part").agg(F.max("off").alias("radius"), F.count("*").alias("n"))
    centres = own_columns(pivots.select(F.col("v").alias("cell"), F.col("vec").alias("pivot")))
    blocks = cut(blocks.withColumn("block", F.monotonically_increasing_id()).join(centres, "cell"), "blocks")
    names = own_columns(blocks.select("cell", "part", "block"))
    nodes = cut(placed.join(names, ["cell", "part"]).select("v", "rep", "m", "vec", "block", "off"), "nodes")
    return nodes, blocks.select("block", "top", "pivot", "radius", "n")


def block_pairs(index: Index, asked: DataFrame, on: list[str]) -> DataFrame:
    """(on, block, other, far): the blocks that ``asked`` (on, block, reach) cannot rule out.

    ``reach`` is how far from the block's pivot anything of interest can be, and null for no bound; ``far`` is the least
    distance of a row of the other block from the pivot.
    """
    tops, radius = index.tops, index.top_radius
    asked = asked.join(index.blocks.select("block", "pivot"), "block").select(*on, "block", F.coalesce("reach", F.lit(float("inf"))).alias("reach"), "pivot")

    def near_tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            d2, tolerance = squared(matrix(batch, "pivot"), tops)
            low = np.sqrt(d2) - np.sqrt(tolerance) - radius
            at, top = np.nonzero(low <= values(batch, "reach")[:, None] * _WIDEN + 1e-9)
            yield batch.take(pa.array(at)).append_column("top", pa.array(top, pa.int32()))

    kinds = dict(asked.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in asked.columns)
    wide = asked.mapInArrow(near_tops, f"{schema}, top int")
    others = own_columns(index.blocks.select("top", F.col("block").alias("other"), F.col("pivot").alias("pivot2"), "radius"))
    apart = F.sqrt(F.aggregate(F.zip_with("pivot", "pivot2", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x))
    pairs = wide.join(others, "top").select(*on, "block", "other", "reach", (apart - F.col("radius")).alias("far"))
    return pairs.where(F.col("far") <= F.col("reach") * _WIDEN + 1e-9).drop("reach")


def compare(
    index: Index, pairs: DataFrame, queries: DataFrame, data: DataFrame, on: list[str],
    find: Callable[[pa.Table, pa.Table], pa.Table], schema: str,
) -> DataFrame:
    """Run ``find`` on the ``queries`` of each block and the ``data`` of the blocks it is paired with in ``pairs`` (on,
    block, other).

    Asking blocks are dealt into groups and the blocks that a group is compared with into lots. Rows follow their block to
    the groups or lots that it has pairs in, once each; the pairs come along, so only paired blocks are compared.
    """
    s = index.settings
    bound = min(s.task_rows, max(s.pivot_rows, -(-index.n // s.fan)))
    asking = queries.groupBy(*on).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    sizes = own_columns(index.blocks.select(F.col("block").alias("other"), "n"))
    group = F.pmod(F.xxhash64("block", F.lit(3)), F.lit(max(1, -(-asking // bound)))).cast("int").alias("group")
    pairs = cut(pairs.select(*on, group, "block", "other"), "asked")
    wanted = pairs.select(*on, "group", "other").distinct().join(sizes, "other")
    lots = wanted.groupBy(*on, "group").agg(F.ceil(F.sum("n") / bound).cast("int").alias("lots"))
    lot = F.pmod(F.xxhash64("other"), F.col("lots")).cast("int").alias("lot")
    pairs = cut(pairs.join(own_columns(lots), [*on, "group"]).select(*on, "group", lot, "block", "other"), "dealt")
    keys = [*on, "group", "lot"]
    q = own_columns(queries).join(own_columns(pairs.select(*keys, "block").distinct()), [*on, "block"])
    x = own_columns(data.withColumnRenamed("block", "other")).join(own_columns(pairs.select(*keys, "other").distinct()), [*on, "other"])
    x = x.unionByName(own_columns(pairs), allowMissingColumns=True)  # a pair is a row without a node

    def paired(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, asked = right.filter(pc.is_valid(right.column("v"))), right.filter(pc.is_null(right.column("v")))
        of_row, of_query = values(rows, "other"), values(left, "block")
        order = np.argsort(of_row, kind="stable")
        of_row, rows = of_row[order], rows.take(pa.array(order))
        others: dict[int, list[int]] = {}
        for block, other in zip(asked.column("block").to_pylist(), asked.column("other").to_pylist()):
            others.setdefault(block, []).append(other)
        alike: dict[tuple, list[int]] = {}  # blocks paired with the same ones are compared together
        for block, found in others.items():
            alike.setdefault(tuple(sorted(found)), []).append(block)
        out = [find(left.slice(0, 0), rows.slice(0, 0))]
        for found, blocks in alike.items():
            out.append(find(left.filter(pa.array(np.isin(of_query, blocks))), rows.filter(pa.array(np.isin(of_row, found)))))
        return pa.concat_tables(out)

    return own_columns(q).groupBy(*keys).cogroup(own_columns(x).groupBy(*keys)).applyInArrow(paired, schema)


_LISTS = "group int, v bigint, m bigint, block bigint, off double, vec array<double>, b array<bigint>, d array<double>, mb array<bigint>"
_NONE = np.iinfo(np.int64).max  # an empty place in a list


def _places(mask: np.ndarray) -> np.ndarray:
    """As ``flatnonzero``, for masks of few true cells: eight are looked at together."""
    flat = mask.reshape(-1)
    if flat.size % 8:
        return np.flatnonzero(flat)
    eights = np.flatnonzero(flat.view(np.uint64))
    of, at = np.nonzero(flat.reshape(-1, 8)[eights])
    return eights[of] * 8 + at


class _Lists:
    """The queries of a group and the ``k`` nearest rows each has met, while the rows of the group pass by.

    ``take`` gets the group's rows in order: queries (kind 0), the pairs of their blocks with others (1), data by block (2).
    """

    def __init__(self, k: int, group: int):
        self.k, self.group = k, group
        self.given: list[pa.RecordBatch] = []
        self.asked: list[tuple[np.ndarray, np.ndarray]] = []
        self.passing: list[tuple[np.ndarray, ...]] = []  # (block, vectors, names, counts) not yet compared
        self.queries: pa.Table | None = None

    def take(self, rows: pa.RecordBatch) -> None:
        cuts = np.searchsorted(values(rows, "kind"), [0, 1, 2, 3])
        queries, pairs, data = (rows.slice(x, y - x) for x, y in zip(cuts, cuts[1:]))
        if queries.num_rows:
            self.given.append(queries)
        if pairs.num_rows:
            self.asked.append((values(pairs, "other"), values(pairs, "block")))
        if data.num_rows:
            self.passing.append((values(data, "other"), matrix(data), values(data, "v"), values(data, "m")))
            if sum(len(x[0]) for x in self.passing) >= 4096:
                self._compare_passing()

    def _begin(self) -> None:
        self.queries = pa.Table.from_batches(self.given).combine_chunks()
        self.given = []
        self.x, self.v, self.block = matrix(self.queries), values(self.queries, "v"), values(self.queries, "block")
        self.square = (self.x * self.x).sum(1)
        self.wide = np.hstack([self.x, np.ones((len(self.x), 1))])
        with np.errstate(over="ignore"):
            self.wide32 = self.wide.astype(np.float32)
        n, k = len(self.v), self.k
        self.d, self.b, self.m = np.full((n, k), np.inf), np.full((n, k), _NONE), np.zeros((n, k), np.int64)
        known = self.queries.column("b").combine_chunks()
        at = np.arange(k)[None, :] < known.value_lengths().to_numpy(zero_copy_only=False)[:, None]
        for name, place in (("d", self.d), ("b", self.b), ("mb", self.m)):
            place[at] = self.queries.column(name).combine_chunks().flatten().to_numpy()
        self.found: list[tuple[np.ndarray, ...]] = []
        self.n_found = 0
        other, block = (np.concatenate(x) for x in zip(*self.asked)) if self.asked else (np.array([], np.int64),) * 2
        asking: dict[int, list[int]] = {}
        for o, a in zip(other.tolist(), block.tolist()):
            asking.setdefault(o, []).append(a)
        self.asking = {o: tuple(sorted(a)) for o, a in asking.items()}
        self.all = tuple(np.unique(self.block).tolist())

    def _compare_passing(self) -> None:
        if self.queries is None:
            self._begin()
        of, x, v, m = (np.concatenate(c) for c in zip(*self.passing))
        self.passing = []
        alike: dict[tuple, list[int]] = {}  # blocks that the same blocks ask for are compared together
        for other in np.unique(of).tolist():
            alike.setdefault(self.asking[other], []).append(other)
        for asking, others in alike.items():
            rows = np.isin(of, others)
            at = np.arange(len(self.v)) if asking == self.all else np.flatnonzero(np.isin(self.block, asking))
            self._compare(at, x[rows], v[rows], m[rows])

    def _compare(self, at: np.ndarray, x: np.ndarray, v: np.ndarray, m: np.ndarray) -> None:
        for start in range(0, len(v), 2048):
            some = slice(start, start + 2048)
            short = np.isinf(self.d[at, -1])
            if short.any():  # their lists are not full yet, so nothing bounds them
                self._tiles(at[short], x[some], v[some], m[some], short=True)
            if not short.all():
                self._tiles(at[~short], x[some], v[some], m[some], short=False)
            if short.any():
                self._merge()

    def _tiles(self, at: np.ndarray, x: np.ndarray, v: np.ndarray, m: np.ndarray, short: bool) -> None:
        """Candidates among ``x`` for the lists of the queries ``at``, whose products fit a processor's cache."""
        square = (x * x).sum(1)
        most = float(self.square[at].max(initial=0.0) + square.max(initial=0.0))
        wide = np.hstack([x, -0.5 * square[:, None]])  # q x - x x / 2, which is larger the nearer x is
        single = not short and most < 1e30
        wide32 = wide.astype(np.float32) if single else None
        room, mask = np.empty((512, len(v)), np.float32), np.empty((512, len(v)), bool)
        rough = 1.2e-7 * (wide.shape[1] + 8) * most + 1e-36  # bounds on rounding errors
        fine = 1e-12 * most
        last = min(self.k, len(v)) - 1
        for start in range(0, len(at), 512):
            rows = at[start : start + 512]
            limit = self.d[rows, -1] ** 2 * _WIDEN
            hits = None
            if single:
                floor = ((self.square[rows] - limit - rough) / 2).astype(np.float32)
                near = np.matmul(self.wide32[rows], wide32.T, out=room[: len(rows)])
                hits = _places(np.greater_equal(near, floor[:, None], out=mask[: len(rows)]))
                if len(hits) > 65_536:
                    hits = None  # too close together for single precision
            if hits is None:
                near = self.wide[rows] @ wide.T
                if short:
                    d2 = self.square[rows, None] - 2.0 * near
                    d2[self.v[rows, None] == v[None, :]] = np.inf
                    limit = np.partition(d2, last, axis=1)[:, last]
                # Rounding may swap close candidates, so take all that could be among the k.
                hits = np.flatnonzero(near >= ((self.square[rows] - limit - fine) / 2)[:, None])
            for some in range(0, len(hits), 65_536):
                i, j = np.divmod(hits[some : some + 65_536], len(v))
                i = rows[i]
                other = self.v[i] != v[j]
                i, j = i[other], j[other]
                d = exact(self.x[i], x[j])
                keep = np.isfinite(d) & (d <= self.d[i, -1])
                self.found.append((i[keep], d[keep], v[j[keep]], m[j[keep]]))
                self.n_found += int(keep.sum())
                if self.n_found > max(65_536, self.d.size):
                    self._merge()

    def _merge(self) -> None:
        i, d, b, m = (np.concatenate(c) for c in zip(*self.found)) if self.found else (np.array([], np.int64),) * 4
        self.found, self.n_found = [], 0
        changed, i = np.unique(i, return_inverse=True)
        n, k = len(changed), self.k
        i = np.concatenate([np.repeat(np.arange(n), k), i])
        d, b, m = (np.concatenate([old[changed].ravel(), new]) for old, new in ((self.d, d), (self.b, b), (self.m, m)))
        order = np.argsort(d)
        order = order[np.argsort(i[order].astype(np.uint16 if n < 1 << 16 else np.int64), kind="stable")]
        if (np.isfinite(d[order[1:]]) & (d[order[1:]] == d[order[:-1]]) & (i[order[1:]] == i[order[:-1]])).any():
            order = np.lexsort((b, d, i))  # equal distances, by name
        i = i[order]
        order = order[np.arange(len(i)) - np.searchsorted(i, i) < k]
        self.d[changed], self.b[changed], self.m[changed] = (c[order].reshape(n, k) for c in (d, b, m))

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.passing:
            self._compare_passing()
        if self.queries is None:
            self._begin()
        self._merge()
        for start in range(0, len(self.v), 4096):
            part = self.queries.slice(start, 4096)
            some = slice(start, start + 4096)
            full = self.b[some] != _NONE
            ends = pa.array(np.concatenate([[0], np.cumsum(full.sum(1))]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(c[some][full])) for c in (self.b, self.d, self.m)]
            kept = [part.column(c).combine_chunks() for c in ("group", "v", "m", "block", "off", "vec")]
            yield pa.RecordBatch.from_arrays(kept + lists, names=["group", "v", "m", "block", "off", "vec", "b", "d", "mb"])


def _met(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pass_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = None
        for batch in batches:
            group = values(batch, "group")
            starts = np.flatnonzero(np.diff(group, prepend=-1)).tolist() if len(group) else []
            for start, stop in zip(starts, [*starts[1:], len(group)]):
                if lists is None or lists.group != group[start]:
                    if lists is not None:
                        yield from lists.rows()
                    lists = _Lists(k, int(group[start]))
                lists.take(batch.slice(start, stop - start))
        if lists is not None:
            yield from lists.rows()

    return pass_by


def neighbour_lists(index: Index, k: int) -> DataFrame:
    """(v, m, block, b, d, mb): the ``k`` nearest other nodes of every node as arrays, nearest first, exactly.

    Queries lie in groups of at most about ``stream_rows`` rows. The data of the blocks that a group is compared with pass
    by them once, so a task holds its queries and their lists, and a row moves once for each group. The distance of the
    k-th one found so far bounds the blocks a block is compared with next.
    """
    s = index.settings
    groups = max(1, -(-index.n // s.stream_rows), min(2 * s.fan, -(-index.n // s.pivot_rows)))
    empty = [F.array().cast(t).alias(c) for c, t in (("b", "array<bigint>"), ("d", "array<double>"), ("mb", "array<bigint>"))]
    dealt = index.nodes.repartitionByRange(groups, "block", "v")  # even groups of neighbouring blocks
    asked = cut(dealt.select(F.spark_partition_id().alias("group"), "v", "m", "block", "off", "vec", *empty), "asked")
    final = ["v", "m", "block", "b", "d", "mb"]
    if k < 1:
        return asked.select(*final)
    asking = cut(asked.select("group", "block").distinct(), "asking")
    data = index.nodes.select("v", "m", "vec", F.col("block").alias("other"))

    def search(asked: DataFrame, pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs.select("block", "other").join(own_columns(asking), "block"), "pairs")
        rows = asked.withColumns({"kind": F.lit(0), "other": F.col("block")})
        rows = rows.unionByName(own_columns(pairs).withColumn("kind", F.lit(1)), allowMissingColumns=True)
        sent = own_columns(data).join(own_columns(pairs.select("group", "other").distinct()), "other").withColumn("kind", F.lit(2))
        rows = rows.unionByName(sent, allowMissingColumns=True)
        rows = rows.repartitionById(groups, "group").sortWithinPartitions("group", "kind", "other")
        return rows.mapInArrow(_met(k), _LISTS)

    own = index.blocks.select("block", F.col("block").alias("other"))
    found = search(asked, own)
    if index.blocks.count() == 1:
        return cut(found.select(*final), "neighbours")
    pairs = None
    for last in (False, True):
        found = cut(found, "found")
        bound = F.when(F.size("d") == k, F.get("d", F.lit(k - 1)))
        reach = found.groupBy("block").agg(F.when(F.count("*") == F.count(bound), F.max(F.col("off") + bound)).alias("reach"))
        if not last:
            pairs = cut(block_pairs(index, reach, []).where("block != other"), "pairs")
            near = cut(first_per_group(pairs, ["block"], [F.asc("far"), F.asc("other")], s.first), "near")
            found = search(found, near)
            continue
        left = pairs.join(own_columns(near.select("block", "other")), ["block", "other"], "left_anti").join(own_columns(reach), "block")
        left = left.where(F.col("reach").isNull() | (F.col("far") <= F.col("reach") * _WIDEN + 1e-9))
        found = search(found, left)
    return cut(found.select(*final), "neighbours")


def listed(lists: DataFrame) -> DataFrame:
    """(a, b, d, mb, rank) of ``neighbour_lists``: a row for each neighbour."""
    rows = lists.select(F.col("v").alias("a"), F.posexplode(F.arrays_zip("b", "d", "mb")).alias("rank", "x"))
    return rows.select("a", "x.b", "x.d", "x.mb", (F.col("rank") + 1).alias("rank"))


def nearest_neighbours(index: Index, k: int) -> DataFrame:
    """(a, b, d, mb, rank): the ``k`` nearest other nodes of every node, exactly."""
    return listed(neighbour_lists(index, k))


def core_distances(index: Index, neighbours: DataFrame, k: int, samples: list[int]) -> DataFrame:
    """(ms, v, m, block, core, kd) for each ``ms`` in ``samples``, from the rows of ``nearest_neighbours``."""
    # At most k rows per node, so each node's list is a small array.
    near = F.array_sort(F.collect_list(F.struct("d", "b", "mb")))
    lists = neighbours.groupBy(F.col("a").alias("v")).agg(near.alias("near"))
    lists = lists.select("v", *[F.col(f"near.{c}").alias(c) for c in ("b", "d", "mb")])
    return list_cores(index, index.nodes.select("v", "m", "block").join(lists, "v", "left"), k, samples)


def list_cores(index: Index, lists: DataFrame, k: int, samples: list[int]) -> DataFrame:
    """(ms, v, m, block, core, kd) for each ``ms`` in ``samples``, from ``neighbour_lists``.

    The core distance reaches the ms-th point, the node itself and all copies
    counted; ``kd`` is the distance beyond which the neighbour list knows nothing,
    null when the list holds every other node.
    """
    reached = F.aggregate(
        "near",
        F.struct(F.col("m").alias("n"), F.when(F.col("m") >= F.col("ms"), F.lit(0.0)).alias("core")),
        lambda acc, x: F.struct(
            (acc["n"] + x["mb"]).alias("n"),
            F.coalesce(acc["core"], F.when(acc["n"] + x["mb"] >= F.col("ms"), x["d"])).alias("core"),
        ),
    )
    whole = F.lit(index.n - 1 <= k)
    return (
        lists.withColumn("near", F.coalesce(F.arrays_zip("d", "b", "mb"), F.array().cast("array<struct<d:double,b:bigint,mb:bigint>>")))
        .withColumn("ms", F.explode(F.array(*[F.lit(x) for x in samples])))
        .withColumn("core", reached["core"])
        .select("ms", "v", "m", "block", "core", F.when(~whole, F.get("near", F.size("near") - 1)["d"]).alias("kd"))
    )
