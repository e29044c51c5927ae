"""Connected components of a graph given by edges, as Spark joins.

Rounds of contraction: every node takes its smallest neighbour (or itself) as parent, the
parents form trees, pointer doubling finds the roots, and the edges between different roots
go to the next round.  Each round at least halves the nodes that still have edges.  Nothing
but emptiness checks reaches the driver; every round's tables are written to the shared
folder, so lineage stays short.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import stored


def local_roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node reachable from each of ``n`` nodes, in one task."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        going = label[u] != label[v]
        u, v = u[going], v[going]
    return label


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root: smallest node of its part.
    Self-loops make a node known; an empty input gives an empty result."""
    edges = stored(edges.select("u", "v").distinct(), f"{name}-edges")
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    live = edges.where("u <> v")
    steps = []
    while not live.isEmpty():
        both = live.union(live.select("v", "u"))
        roots = stored(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low"))
                       .select("node", F.least("node", "low").alias("root")), f"{name}-parents")
        while True:
            up = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
            higher = stored(roots.join(up, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")),
                            f"{name}-jump")
            moved = not higher.where("moved").isEmpty()
            roots = higher.select("node", "root")
            if not moved:
                break
        steps.append(roots)
        a = roots.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        b = roots.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        live = stored(live.join(a, "u").join(b, "v").where("ru <> rv")
                      .select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct(), f"{name}-live")
    out = nodes.select("node", F.col("node").alias("root"))
    for roots in steps:
        up = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
        out = out.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return out
