"""Louvain communities of a weighted graph of files.

Moves follow node order and weigh against the whole graph's weight, but never look
beyond a connected component: components are found first, and each is one group,
run on arrays. So one task holds a component of files, never all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions.tables import keep
from latticework.operators.traverse import label_components

#: Smallest gain that moves a node; passes of a level and levels at most.
LEAST_GAIN, PASSES, LEVELS = 1e-9, 100, 50
#: A community of more files than this share of all, and than that number, is split again.
SHARE, LARGE = 12, 40


#: Entries of neighbour lists that are worked on at once.
AT_ONCE = 1 << 21


class _Level:
    """A graph as sorted neighbour lists (compressed rows), its loops and strengths.

    The lists hold 4 bytes for a neighbour and 4 for a weight that fits in them (else
    8); all that is made beside them is made for ``AT_ONCE`` entries at a time.
    """

    def __init__(self, start: np.ndarray, near: np.ndarray, weight: np.ndarray, loop: np.ndarray):
        self.n, self.start, self.near, self.weight, self.loop = len(start) - 1, start, near, weight, loop
        self.strength = 2.0 * loop
        for rows, at, row in self.runs():
            self.strength[rows] += np.bincount(row, weight[at], rows.stop - rows.start)

    def runs(self):
        """Slices of rows, of their entries, and each entry's row from the first of them."""
        low = 0
        while low < self.n:
            high = max(low + 1, int(np.searchsorted(self.start, self.start[low] + AT_ONCE, "right")) - 1)
            yield slice(low, high), slice(self.start[low], self.start[high]), np.repeat(np.arange(high - low), np.diff(self.start[low : high + 1]))
            low = high

    @classmethod
    def of_edges(cls, n: int, edges: list[tuple[int, int, float]]) -> _Level:
        a, b, w = (np.array(x) for x in zip(*edges)) if edges else (np.zeros(0, np.int64),) * 3
        good = w > 0
        a, b, w = a[good].astype(np.int64), b[good].astype(np.int64), w[good].astype(float)
        loop = np.bincount(a[a == b], w[a == b], n)
        a, b, w = a[a != b], b[a != b], w[a != b]
        key, place = np.unique(np.concatenate([a * n + b, b * n + a]), return_inverse=True)
        return cls._of_keys(n, key, np.bincount(place, np.tile(w, 2), len(key)), loop)

    @classmethod
    def _of_keys(cls, n: int, key: np.ndarray, w: np.ndarray, loop: np.ndarray) -> _Level:
        return cls(np.searchsorted(key, np.arange(n + 1) * n), (key % n).astype(np.int32), w, loop)

    def merged(self, home: np.ndarray) -> _Level:
        """The graph of communities (numbers from 0)."""
        n = int(home.max()) + 1
        loop, key, w, wait = np.bincount(home, self.loop, n), np.zeros(0, np.int64), np.zeros(0), []

        def joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(place, np.concatenate([x for _, x in parts]), len(keys))

        for rows, at, row in self.runs():
            wait.append(joined([(home[rows][row] * n + home[self.near[at]], self.weight[at])]))
            if sum(len(k) for k, _ in wait) > max(AT_ONCE, len(key)):
                (key, w), wait = joined([(key, w), *wait]), []
        key, w = joined([(key, w), *wait])
        inside = key // n == key % n
        np.add.at(loop, key[inside] // n, w[inside] / 2)
        return _Level._of_keys(n, key[~inside], w[~inside], loop)

    def part(self, inside: np.ndarray) -> _Level:
        """The graph among some nodes (sorted), numbered from 0."""
        at, count, near, weight = np.full(self.n, -1, np.int32), [], [], []
        at[inside] = np.arange(len(inside), dtype=np.int32)
        for rows, span, row in self.runs():
            held = (at[rows][row] >= 0) & (at[self.near[span]] >= 0)
            near.append(at[self.near[span][held]])
            weight.append(self.weight[span][held])
            count.append(np.bincount(row[held], minlength=rows.stop - rows.start)[at[rows] >= 0])
        start = np.concatenate([[0], np.cumsum(np.concatenate(count))])
        return _Level(start, np.concatenate(near), np.concatenate(weight), self.loop[inside])

    def moved(self, total: float, resolution: float) -> np.ndarray:
        """The community of each node after local moves in node order."""
        home, held = np.arange(self.n), self.strength.copy()
        for _ in range(PASSES):
            still = True
            for i in range(self.n):
                at = slice(self.start[i], self.start[i + 1])
                around, place = np.unique(home[self.near[at]], return_inverse=True)
                links = np.bincount(place, self.weight[at], len(around))
                own = home[i]
                held[own] -= self.strength[i]
                pull = resolution * self.strength[i] / (2 * total)
                here = links[around == own].sum() - pull * held[own]
                best = own
                for c, value in zip(around, links - pull * held[around]):  # the smallest number wins a tie
                    if value > here + LEAST_GAIN:
                        best, here = c, value
                held[best] += self.strength[i]
                if best != own:
                    home[i], still = best, False
            if still:
                break
        return home


def _numbered(labels: np.ndarray) -> np.ndarray:
    """Labels as numbers by first appearance."""
    _, first, inverse = np.unique(labels, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[inverse]


def _louvain(level: _Level, resolution: float = 1.0, total: float | None = None) -> np.ndarray:
    member = np.arange(level.n)
    total = float(level.strength.sum()) / 2 if total is None else total
    for _ in range(LEVELS if total > 0 else 0):
        home = level.moved(total, resolution)
        if (home == np.arange(level.n)).all():
            break
        home = _numbered(home)
        member = home[member]
        level = level.merged(home)
    return _numbered(member)


def _refined(level: _Level, cap: int, total: float) -> np.ndarray:
    labels, whole, fresh = _louvain(level, total=total), set(), level.n
    while True:
        large = [c for c, size in zip(*np.unique(labels, return_counts=True)) if size > cap and c not in whole]
        if not large:
            return _numbered(labels)
        for c in large:
            inside = np.flatnonzero(labels == c)
            part = _louvain(level.part(inside))
            if part.max() == 0:
                whole.add(c)
            else:
                labels[inside] = fresh + part
                fresh += int(part.max()) + 1


def louvain(n: int, edges: list[tuple[int, int, float]], resolution: float = 1.0, total: float | None = None) -> list[int]:
    """A community for each node, numbered by first appearance; edges without a
    positive weight don't count; ``total``: the weight of the graph that this is part of."""
    return _louvain(_Level.of_edges(n, edges), resolution, total).tolist() if n else []


def refined(n: int, edges: list[tuple[int, int, float]], cap: int, total: float) -> list[int]:
    """``louvain``, and again inside each community of more than ``cap`` nodes, until
    it is small enough or does not come apart."""
    return _refined(_Level.of_edges(n, edges), cap, total).tolist() if n else []


def _small(w: np.ndarray) -> np.ndarray:
    """Weights in 4 bytes where none loses anything."""
    low = w.astype(np.float32)
    return low if (low == w).all() else w


def _level_of_rows(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> _Level:
    """A component from its rows (node, neighbour, weight), sorted, each pair in both
    directions and a loop once; equal pairs add up. The parts are emptied."""
    n = int(parts[-1][0][-1]) + 1
    count, loop = np.zeros(n, np.int64), np.zeros(n)
    for i, (x, y, w) in enumerate(parts):
        mine = x == y
        np.add.at(loop, x[mine], w[mine])
        parts[i] = x[~mine], y[~mine], w[~mine]
        count += np.bincount(parts[i][0], minlength=n)
    start = np.concatenate([[0], np.cumsum(count)])
    near = np.empty(start[-1], np.int32)
    weight = np.empty(start[-1], np.float32 if all(p[2].dtype == np.float32 for p in parts) else np.float64)
    at, twice, last = 0, False, (-1, -1)
    for i, (x, y, w) in enumerate(parts):
        near[at : at + len(y)], weight[at : at + len(y)] = y, w
        if len(x):
            twice |= (int(x[0]), int(y[0])) == last or bool(((x[1:] == x[:-1]) & (y[1:] == y[:-1])).any())
            last = int(x[-1]), int(y[-1])
        at, parts[i] = at + len(y), None
    if twice:
        row = np.repeat(np.arange(n), count)
        key, place = np.unique(row * n + near, return_inverse=True)
        return _Level._of_keys(n, key, np.bincount(place, weight, len(key)), loop)
    return _Level(start, near, weight, loop)


def communities(pairs: DataFrame, refine: bool = False) -> DataFrame:
    """(path, community) of an undirected weighted graph (a, b, weight) of files; a
    community goes by its first path. ``refine``: large ones are split again.

    A task takes numbers, sorted, and holds one component's neighbour lists.
    """
    pairs = keep(pairs.filter("weight > 0").select("a", "b", "weight"), "files")
    roots = keep(label_components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "parts")
    total, files = pairs.agg(F.sum("weight")).first()[0] or 0.0, roots.count()
    cap = max(LARGE, files // SHARE)
    numbers = keep(roots.select("root").distinct().select("root", F.monotonically_increasing_id().alias("part")), "numbers")
    order = Window.partitionBy("part").orderBy("path")
    named = keep(roots.join(numbers, "root").select("part", F.col("id").alias("path")).withColumn("at", F.row_number().over(order) - 1), "named")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = [], None

        def out() -> pa.RecordBatch:
            level = _level_of_rows(held)
            label = _refined(level, cap, total) if refine else _louvain(level, total=total)
            first = np.unique(label, return_index=True)[1][label]
            columns = np.full(level.n, part, np.int64), np.arange(level.n, dtype=np.int32), first.astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "at", "first"])

        for batch in batches:
            of, x, y, w = (c.to_numpy() for c in batch.columns)
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1), len(of)]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                if held and of[low] != part:
                    yield out()
                    held = []
                part = int(of[low])
                held.append((x[low:high].copy(), y[low:high].copy(), _small(w[low:high])))
        if held:
            yield out()

    end = lambda c, a: named.select(F.col("path").alias(c), F.col("at").alias(a), *(["part"] if c == "a" else []))
    rows = pairs.join(end("a", "x"), "a").join(end("b", "y"), "b").select("part", "x", "y", "weight")
    rows = rows.unionAll(rows.filter("x <> y").select("part", F.col("y"), F.col("x"), "weight"))
    dealt = rows.repartition("part").sortWithinPartitions("part", "x", "y")
    found = keep(dealt.mapInArrow(run, "part long, at int, first int"), "communities")
    first = named.select("part", F.col("at").alias("first"), F.col("path").alias("community"))
    return found.join(named, ["part", "at"]).join(first, ["part", "first"]).select("path", "community")
