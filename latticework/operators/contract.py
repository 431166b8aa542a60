"""Connected components of numbered nodes, contracted until a task can hold what is left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions.tables import counted, keep

#: Edges that a task contracts at once.
CHUNK = 1 << 20


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b) and the smallest node of each one's component."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, new = np.minimum(root[x], root[y]), root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _contract(batches: Iterator[pa.RecordBatch], names: tuple[str, str] = ("u", "v")) -> Iterator[pa.RecordBatch]:
    """The same connections with one edge (node, smallest node) for each node of a chunk."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> tuple[np.ndarray, np.ndarray]:
        nodes, roots = local_roots(*(np.concatenate(x) for x in zip(*held)))
        return nodes[nodes != roots], roots[nodes != roots]

    batch_of = lambda pair: pa.RecordBatch.from_arrays([pa.array(x) for x in pair], list(names))
    n = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= CHUNK:
            held = [out()]
            n = len(held[0][0])
            if n >= CHUNK // 2:
                yield batch_of(held.pop())
                n = 0
    if n:
        yield batch_of(out())


def roots(edges: DataFrame) -> DataFrame:
    """(node, root) of nodes of the edges (u, v: numbers in no order that the graph
    knows); a node without a row is its own root.

    Each round takes every node to the smallest node among itself and its neighbours,
    and goes on with the edges between these: as the numbers are as good as random,
    no chain lasts, and no round is larger than the one before. ``CHUNK`` edges at
    most go to one task. The maps of all rounds then follow each other.
    """
    contracted = lambda e: e.filter("u <> v").mapInArrow(_contract, "u long, v long")
    edges, n = counted(contracted(edges), "links")
    maps: list[DataFrame] = []
    while n > CHUNK:
        near = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v"))
        low = keep(near.select("node", F.least("node", "v").alias("root")), "lows")
        maps.append(low)
        to = lambda c: low.select(F.col("node").alias(c), F.col("root").alias(f"{c}_low"))  # noqa: B023, E731
        moved = edges.join(to("u"), "u").join(to("v"), "v").select(F.col("u_low").alias("u"), F.col("v_low").alias("v"))
        edges, n = counted(contracted(moved), "links")
    found = keep(edges.coalesce(1).mapInArrow(lambda batches: _contract(batches, ("node", "root")), "node long, root long"), "roots")
    for low in reversed(maps):
        further = found.select(F.col("node").alias("root"), F.col("root").alias("last"))
        found = keep(low.join(further, "root", "left").select("node", F.coalesce("last", "root").alias("root")), "roots")
    return found
