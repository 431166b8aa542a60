"""Connected components of an edge table by alternating stars, in rounds of
joins and minima until a task can hold what is left (``CHUNK`` edges at most)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import materialize

#: Edges that a task contracts at once.
CHUNK = 1 << 20


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b) and the smallest node of each one's component."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same connections with one edge (node, smallest node) for each node of a chunk."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out():
        nodes, roots = local_roots(*(np.concatenate(x) for x in zip(*held)))
        keep = nodes != roots
        return nodes[keep], roots[keep]

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(x) for x, _ in held) >= CHUNK:
            held = [out()]
            if len(held[0][0]) >= CHUNK // 2:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], ["u", "v"])
    if held and sum(len(x) for x, _ in held):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out()], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of ``edges`` (two long columns, no nulls) that is
    not itself the smallest of its component; root is that smallest node.

    Fewer than ``CHUNK`` edges are contracted by one task. More take large-star and
    small-star rounds (each node's larger, then smaller neighbours join the smallest
    one) until so few are left or every node has one edge, to a node that has none. Minima are taken by partial aggregation and joined back, so
    a hub's edges may be split over tasks. Self loops count as no edge.
    """
    a, b = (F.col(f"`{c}`").cast("long") for c in edges.columns[:2])
    edges = edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = materialize(edges.mapInArrow(_contract, "u long, v long").distinct(), "stars")
    while True:
        if edges.count() < CHUNK:
            edges = materialize(edges.coalesce(1).mapInArrow(_contract, "u long, v long"), "roots")
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        busy = edges.groupBy("u").count().filter("count > 1").select("u").limit(1).unionAll(edges.select("v").join(edges.select(F.col("u").alias("v")), "v", "left_semi").limit(1))
        if busy.isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionAll(least.select("u", F.col("m").alias("v")))
        edges = materialize(small.mapInArrow(_contract, "u long, v long").distinct(), "stars")
