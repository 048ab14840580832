"""Connected components of an edge table: union-find inside blocks of edges, then star rounds across blocks.

1. Blocks of some BLOCK_EDGES edges, whatever their nodes, are contracted where they lie: a block's edges
   become stars around the least nodes of its own components, at most one edge a node.
2. While there are several blocks, a round of large-star and small-star, two grouped minima and two joins on
   the edges' ends, joins the blocks' stars. When it leaves the edges as they were (their count and a sum of
   their hashes), they are stars around the least nodes of all.

Edges are written to the shared folder between steps, so that the plan stays short and a lost executor costs
one step. A step never raises the least node that a node is linked to, so rounds end, and they grow with the
logarithm of the longest chain of blocks. A node with very many edges is spread over blocks by its edges, and
pre-aggregated for its minimum.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Edges that one task contracts at once.
BLOCK_EDGES = 1_000_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def least_reachable(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of the nodes 0 to n - 1 the least that the edges u-v reach."""
    least = np.arange(n)
    while len(u):
        a, b = least[u], least[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))  # a and b are the least of their own parts
        while not np.array_equal(shorter := least[least], least):
            least = shorter
    return least


def _contracted(edges: DataFrame, blocks: int) -> DataFrame:
    """The edges of each block as stars around its components' least nodes; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        ends = pa.chunked_array([*table.column(0).chunks, *table.column(1).chunks])
        nodes = ends.unique()
        nodes = nodes.take(pc.sort_indices(nodes))
        place = pc.index_in(ends, nodes).to_numpy()
        least = least_reachable(place[: table.num_rows], place[table.num_rows :], len(nodes))
        moved = np.flatnonzero(least != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([nodes.take(pa.array(moved)), nodes.take(pa.array(least[moved]))], names=["a", "b"])

    return edges.coalesce(blocks).mapInArrow(run, edges.schema)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for each node with an edge; component is the smallest node reachable.

    `edges` has a and b of one whole-number or string type. Null ends and loops are dropped; repeated edges
    count once; an empty table gives no rows.
    """
    a, b = edges.columns[:2]
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = scratch.table(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a != b"), "edges")
    while n := now.count():
        blocks = math.ceil(n / BLOCK_EDGES)
        stars = scratch.table(_contracted(now, blocks), "stars")
        scratch.drop(now)
        now = stars
        if blocks == 1:
            break
        joined = scratch.table(_small_star(_large_star(stars)), "edges")
        same = state(joined) == state(stars)
        scratch.drop(stars)
        now = joined
        if same:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
