"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Links that one task takes at most (32 MB).
FEW = 1 << 21


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all links (u, v) of ``batches``."""
    found = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    if not found:
        return
    u, v = map(np.concatenate, zip(*found, strict=True))
    del found
    nodes = np.concatenate([u, v])
    nodes.sort()
    nodes = nodes[np.append(True, nodes[1:] != nodes[:-1])]
    u, v = (np.searchsorted(nodes, x).astype(np.int32) for x in (u, v))
    root = np.arange(len(nodes), dtype=np.int32)
    while len(u):
        np.minimum.at(root, np.maximum(root[u], root[v]), np.minimum(root[u], root[v]))
        while ((further := root[root]) != root).any():
            root = further
        apart = root[u] != root[v]
        u, v = u[apart], v[apart]
    for low in range(0, len(nodes), 1 << 16):
        own = slice(low, low + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], names=["node", "root"])


def connected_components(links: DataFrame, max_rounds: int = 200, few: int = FEW) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b), two columns of longs; root: the smallest node reachable.

    Each round draws a new order of the nodes by hashes, lets every node go to the first of itself and its neighbours (a minimum,
    combined before the shuffle), and keeps the links between those that are left; so links shrink by a share in every round whatever the graph, small
    components are done after the first, and nothing but whether links are left reaches the driver. The lineage is cut by reliable checkpoints. Nulls and
    links of a node with itself count for nothing; no links give no rows. As soon as only ``few`` different links are left, at once or after some rounds,
    they go through one task instead, which spares the driver the jobs of all further rounds.
    """
    edges = checkpoint(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    steps = []
    while (n := edges.count()) > few:
        if len(steps) == max_rounds:
            raise RuntimeError("the components have not settled")
        place = lambda c, k=len(steps): F.xxhash64(c, F.lit(k))
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min(place("v")).alias("h"), F.min_by("v", place("v")).alias("v"))
        step = near.select(F.col("u").alias("node"), F.when(place("u") <= F.col("h"), F.col("u")).otherwise(F.col("v")).alias("to"))
        steps.append(step := checkpoint(step, False))
        left = edges.join(step.select(F.col("node").alias("u"), F.col("to").alias("x")), "u").join(step.select(F.col("node").alias("v"), F.col("to").alias("y")), "v")
        left = left.where(F.col("x") != F.col("y")).select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
        edges = checkpoint(left.distinct())
    rest = edges.coalesce(1).mapInArrow(_in_one_task, "node long, root long")
    if not steps:
        return rest
    ends = steps.pop()
    if n:  # what the last round has left is in its table too, as places that nodes go to
        steps.append(ends)
        ends = checkpoint(rest.withColumnRenamed("root", "to"), False)
    while steps:  # from the last round to the first, each table of which holds all nodes that the later ones hold
        later = ends.select(F.col("node").alias("to"), F.col("to").alias("end"))
        ends = steps.pop().join(later, "to", "left").select("node", F.coalesce("end", "to").alias("to"))
    ends = checkpoint(ends)
    lows = checkpoint(ends.groupBy("to").agg(F.min("node").alias("root")), False)
    return ends.join(lows, "to").select("node", "root")
