"""Density clustering of vectors, for one or several parameter pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.operators import blocks, density, hierarchy, spanning
from narrata.operators.blocks import BlockSettings
from narrata.operators.components import SMALL
from narrata.shared import cut


def cluster_points(
    points: DataFrame, grid: list[tuple[int, int]], settings: BlockSettings = BlockSettings(),
    part_edges: int = hierarchy.PART_EDGES, small: int = SMALL,
) -> DataFrame:
    """(run, post_id, cluster_label) of ``points`` (post_id, vec) for every
    (min_cluster_size, min_samples) in ``grid``; ``run`` is the pair's position.

    Neighbours are searched once for all pairs, trees built once per min_samples.
    """
    points = cut(points, "points")
    index = blocks.build_index(points, settings)
    samples = sorted({ms for _, ms in grid})
    if index.total < max(samples):
        raise ValueError(f"{index.total} points are too few for min_samples={max(samples)}")
    # Longer lists than the core distance needs settle most tree edges without another search.
    k = max(2 * max(samples), 16)
    lists = blocks.neighbour_lists(index, k)
    cores = cut(blocks.list_cores(index, lists, k, samples), "cores")
    tree = spanning.spanning_edges(index, blocks.listed(lists), cores, small)
    runs = [(i, mcs, ms) for i, (mcs, ms) in enumerate(grid)]
    found = density.numbered(hierarchy.condense(tree, cores, runs, part_edges, small))
    if index.total == index.n:
        members = index.nodes.select("v", F.col("rep").alias("post_id"))
    else:
        members = points.join(index.nodes.select("vec", "v"), "vec").select("v", "post_id")
    return members.join(found, "v").select("run", "post_id", "cluster_label")
