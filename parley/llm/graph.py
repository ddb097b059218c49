"""Connected components of a graph given as a table of links, without gathering it anywhere.

Each round hooks every node to its smallest neighbour if that is smaller, flattens the forest by pointer
jumping, and contracts the links to those between different roots. A component loses at least half of
its remaining nodes each round, so rounds grow with the logarithm of its size, chains included. Once at
most SHARE links are left, one task joins them by union and find, whatever their shape."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: The most links, of 16 bytes, that one task joins.
SHARE = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots): the smallest node that each node with links a - b reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        open_ = low != high
        x, y, low, high = x[open_], y[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return nodes, nodes[root]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [np.zeros((2, 0), np.int64)]
    for x in batches:
        parts.append(np.stack([x.column("a").to_numpy(), x.column("b").to_numpy()]))
    nodes, roots = forest(*np.concatenate(parts, axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["node", "component"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links(a, b): component is the smallest node reachable. links is read several
    times, so it should be a written table.

    Links are undirected; repeats, both directions and links of a node with itself are allowed. Nodes that
    only link with themselves are not returned, nor are rows with a null end: such nodes are their own. Without links
    nothing is returned."""
    edges = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    maps: list[DataFrame] = []  # node to root of each round
    while (n := edges.count()) > SHARE:
        edges = materialise(edges.distinct(), "cc-links")
        # a < b in every link, so the smallest neighbour of b that is smaller is an a
        parent = materialise(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "cc-parents")
        while True:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = materialise(parent.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "cc-jump")
            parent = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        maps.append(parent)
        root_a = parent.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        root_b = parent.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = edges.join(root_a, "a", "left").join(root_b, "b", "left").select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"))
        edges = materialise(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), "cc-links")
    if n or not maps:
        last = materialise(edges.repartition(1).mapInArrow(_joined, "node bigint, component bigint"), "cc")
        if not maps:
            return last
        maps.append(last.where("node <> component").withColumnRenamed("component", "root"))
    out = maps[0].withColumnRenamed("root", "component")
    for later in maps[1:]:
        out = extended(out, later.withColumnRenamed("root", "component"))
    roots = out.select(F.col("component").alias("node"), "component").distinct()
    return materialise(out.unionByName(roots), "cc")


def extended(parts: DataFrame, later: DataFrame) -> DataFrame:
    """The components (node, component) of parts once those that later links have joined are one: `later` has the
    components of components, and of nodes that had no link before."""
    step = later.select(F.col("node").alias("component"), F.col("component").alias("next"))
    moved = parts.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    return moved.unionByName(later.join(parts.select("node"), "node", "left_anti").select("node", "component"))
