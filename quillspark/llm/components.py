"""Connected components of an edge table by alternating stars, without gathering a component anywhere.

Each node's neighbours are hooked to the least of them, first the larger neighbours (large star), then the smaller ones
(small star). Repeated, this turns every component into a star around its least node, in a number of rounds that grows
with the logarithm of its size. Minima are partial sums before the shuffle; they are written and joined back, so that a
node with very many edges is split over tasks by adaptive skew joins. Before the first round each task contracts its own
edges, at most TASK_EDGES, which leaves little to do where few tasks hold them. It ends when all edges are stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch


#: Edges that a task contracts by itself; up to so many edges, one task gives the components.
TASK_EDGES = 500_000


def _least_neighbour(scratch: Scratch, edges: DataFrame, node: str, other: str) -> DataFrame:
    return scratch.keep(edges.groupBy(node).agg(F.min(other).alias("least")))


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least of the rows 0 to n - 1 that each one reaches by pairs, by minima and pointer jumping."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        for at in (left, right, label[left], label[right]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (x, y) of the same components: within each task's edges, every node points to the least it reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        nodes, at = np.unique(np.concatenate([t["x"].to_numpy(), t["y"].to_numpy()]), return_inverse=True)
        root = local_roots(len(nodes), at[: t.num_rows], at[t.num_rows :])
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        for k in range(0, len(moved), 50_000):
            some = moved[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(nodes[some], t.schema.field("x").type), pa.array(nodes[root[some]], t.schema.field("x").type)], ["x", "y"])

    return edges.mapInArrow(run, edges.schema)


def _are_stars(edges: DataFrame) -> bool:
    """Has every node one edge, to a node that has none?"""
    row = edges.agg(F.count("*").alias("n"), F.count_distinct("x").alias("d")).collect()[0]
    return row.n == row.d and edges.join(edges.select(F.col("x").alias("y")), "y", "left_semi").isEmpty()


def connected(scratch: Scratch, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(uid, component): the least node that each node with a link reaches. Nodes may be of any type that has an order."""
    edges = scratch.keep(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).distinct())
    tasks = max(1, -(-edges.count() // TASK_EDGES))
    edges = scratch.keep(contracted(edges.coalesce(tasks)))
    while tasks > 1 and not _are_stars(edges):
        both = edges.select(F.col("x").alias("u"), F.col("y").alias("v")).unionByName(edges.select(F.col("y").alias("u"), F.col("x").alias("v")))
        least = _least_neighbour(scratch, both, "u", "v")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("x"), F.least("u", "least").alias("y")).distinct()
        large = scratch.keep(large)
        least = _least_neighbour(scratch, large, "x", "y")
        small = large.join(least, "x").select(F.col("y").alias("x"), F.col("least").alias("y")).where("x != y")
        edges = scratch.keep(small.unionByName(least.select("x", F.col("least").alias("y"))).distinct())
    out = edges.select(F.col("x").alias("uid"), F.col("y").alias("component"))
    return out.unionByName(edges.select(F.col("y").alias("uid"), F.col("y").alias("component")).distinct())
