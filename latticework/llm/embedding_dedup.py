"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors are turned to their principal directions, put in the order of
their grid cells (edge epsilon) on the leading ones, and cut into blocks.
Intervals of that sequence are joined recursively: two intervals whose boxes
are further apart than epsilon are skipped with all they hold, the others are
split, down to pairs of blocks, which are compared exactly in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import join_keyed, materialize, new_folder, shuffle_width, with_position
from latticework.llm.components import components, local_roots
from latticework.llm.files import get, put_at

#: Vectors of a block, children of an interval, leading directions of the grid and of the boxes.
BLOCK, FAN, GRID_DIMS, BOX_DIMS = 1024, 16, 6, 16


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows (none zero) as doubles of unit length, very large and very small ones too."""
    x = x.astype(np.float64)
    square = np.einsum("ij,ij->i", x, x)
    far = ~((square > 1e-200) & (square < 1e200))
    if far.any():
        x[far] /= np.abs(x[far]).max(axis=1, keepdims=True)
        square[far] = np.einsum("ij,ij->i", x[far], x[far])
    return x / np.sqrt(square)[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length as doubles of unit length."""
    return _unit(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1))


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
    for d in np.unique(dims):
        yield int(d), batch.filter(pa.array(dims == d))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for d, part in _by_dim(batch):
            x = _matrix(part.column(part.schema.get_field_index("embedding")))
            sums[d] = sums.get(d, 0) + x.T @ x
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([m.tobytes() for m in sums.values()], pa.binary())], ["dim", "moment"])


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(m.as_py()) for m in table["moment"])
    return pa.table({"dim": pa.array([table["dim"][0].as_py()], pa.int32()), "moment": pa.array([total.tobytes()], pa.binary())})


def principal_directions(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Directions (as columns, leading first) of all vectors, by dimension; the
    driver gets at most 8 summed matrices for each dimension."""
    parts = vectors.select("dim", "embedding").mapInArrow(_moments, "dim int, moment binary")
    parts = parts.withColumn("slot", F.pmod(F.monotonically_increasing_id(), F.lit(7)) + F.pmod(F.shiftright(F.monotonically_increasing_id(), 33), F.lit(7)))
    parts = parts.withColumn("slot", F.pmod("slot", F.lit(8))).groupBy("dim", "slot").applyInArrow(_add, "dim int, moment binary")
    sums: dict[int, np.ndarray] = {}
    for dim, moment in parts.collect():
        sums[dim] = sums.get(dim, 0) + np.frombuffer(bytes(moment)).reshape(dim, dim)
    return {d: np.linalg.eigh(m)[1][:, ::-1] for d, m in sums.items()}


def _cells(epsilon: float, basis: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, part in _by_dim(batch):
                x = _matrix(part.column(part.schema.get_field_index("embedding"))) @ basis[d][:, :GRID_DIMS]
                cells = np.floor(x / epsilon).astype(np.int32)
                width = cells.shape[1]
                grid = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * width), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, grid, pa.array(x[:, 0])], [*part.schema.names, "cells", "lead"])

    return run


def _pack(basis: dict[int, np.ndarray], folder: str):
    """A block: its box and range of labels as a row, its vectors in a file."""

    def run(table: pa.Table) -> pa.Table:
        out = []
        for batch in table.combine_chunks().to_batches():
            for d, part in _by_dim(batch):
                x = _matrix(part["embedding"]) @ basis[d][:, :BOX_DIMS]
                labels = part["label"].to_numpy()
                raw = part["embedding"].flatten().to_numpy(zero_copy_only=False)
                columns = [part[c].to_numpy().astype("<i8") for c in ("vec_id", "label", "copies")]
                data = np.array([len(part), d, raw.itemsize], "<i8").tobytes() + b"".join(c.tobytes() for c in columns) + raw.tobytes()
                path = f"{folder}/{xxhash.xxh3_128_hexdigest(data)}"
                put_at(path, data)
                out.append({"block": part["block"][0].as_py(), "dim": d, "low": x.min(0).tolist(), "high": x.max(0).tolist(), "first": int(labels.min()), "last": int(labels.max()), "path": path})
        return pa.Table.from_pylist(out, pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("first", pa.int64()), ("last", pa.int64()), ("path", pa.string())]))

    return run


def _read_block(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels, multiplicities and unit vectors (in double precision) of a block."""
    data = get(path)
    n, d, width = np.frombuffer(data, "<i8", 3).tolist()
    ids, labels, copies = np.frombuffer(data, "<i8", 3 * n, 24).reshape(3, n)
    return ids, labels, copies, _unit(np.frombuffer(data, f"<f{width}", n * d, 24 + 24 * n).reshape(n, d))


_PACKED = "block long, dim int, low array<double>, high array<double>, first long, last long, path string"


def near_intervals(blocks: DataFrame, epsilon: float, count: int) -> DataFrame:
    """(dim, a, b) of blocks a <= b whose boxes are within epsilon, by splitting pairs of intervals."""
    levels = max(1, math.ceil(math.log(max(2, count), FAN)))
    box = blocks.select("block", "dim", "low", "high", "first", "last")
    fold = lambda lists, pick: F.aggregate(F.slice(lists, 2, FAN), F.element_at(lists, 1), lambda a, x: F.zip_with(a, x, lambda p, q: pick(p, q)))
    least, most = fold("lows", F.least), fold("highs", F.greatest)
    nodes = [box.withColumnRenamed("block", "node")]
    for _ in range(levels - 1):
        up = nodes[-1].groupBy("dim", F.expr(f"node div {FAN}").alias("node"))
        up = up.agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs"), F.min("first").alias("first"), F.max("last").alias("last"))  # FAN rows each
        nodes.append(materialize(up.select("node", "dim", least.alias("low"), most.alias("high"), "first", "last"), "intervals"))
    pairs = nodes[-1].select("dim", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).distinct()
    gap = lambda low, high: F.aggregate(F.zip_with(low, high, lambda p, q: F.greatest(p - q, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v * v)
    apart = gap("x_low", "y_high") + gap("y_low", "x_high")
    for level in reversed(nodes):
        side = lambda s: level.select("dim", F.expr(f"node div {FAN}").alias("a" if s == "x" else "b"), *[F.col(c).alias(f"{s}_{c}") for c in ("node", "low", "high", "first", "last")])  # noqa: E731, B023
        near = pairs.join(side("x"), ["dim", "a"]).join(side("y"), ["dim", "b"])
        near = near.filter((F.col("x_node") <= F.col("y_node")) & (F.col("x_first") <= F.col("y_last")) & (F.col("y_first") <= F.col("x_last")) & (apart <= epsilon * epsilon + 1e-9))
        pairs = near.select("dim", F.col("x_node").alias("a"), F.col("y_node").alias("b"))
    return pairs


def _compare(threshold: float):
    """Links and roots of the pairs of blocks (p, q); a block is read once for a run of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, None
        for batch in batches:
            for p, q in zip(batch["p"].to_pylist(), batch["q"].to_pylist()):
                if p != last:
                    last, x = p, _read_block(p)
                same = p == q
                y = x if same else _read_block(q)
                hit = (x[3] @ y[3].T >= threshold) & (x[1][:, None] == y[1][None, :])
                if same:
                    np.fill_diagonal(hit, False)
                a, b = np.nonzero(np.triu(hit) if same else hit)
                if not len(a):
                    continue
                nodes, roots = local_roots(x[0][a], y[0][b])
                counts = [(x[0], hit @ y[2])] + ([] if same else [(y[0], hit.T @ x[2])])
                n_ids, n_links = (np.concatenate(z) for z in zip(*counts))
                known = np.searchsorted(nodes, n_ids).clip(0, len(nodes) - 1)
                found = nodes[known] == n_ids
                yield pa.RecordBatch.from_arrays([pa.array(n_ids[found]), pa.array(n_links[found].astype(np.int64)), pa.array(roots[known[found]])], ["id", "links", "root"])

    return run


def _label_numbers(rows: DataFrame) -> DataFrame:
    """``label`` as a long: as it is where it is a whole number, else numbered in its order."""
    kind = dict(rows.dtypes)["label"]
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return rows.withColumn("number", F.col("label").cast("long"))
    known = with_position(rows.filter("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n")), [F.col("label")], name="number")
    named = join_keyed(rows.filter("label is not null"), known.select("label", "number", "n"), "label", "n")
    return named.unionByName(rows.filter("label is null").withColumn("number", F.lit(None).cast("long")))


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept, label.

    Two vectors link when their labels are equal and not null, their lengths
    are equal, and their cosine in double precision is at least ``threshold``.
    Vectors that are null, empty, zero, or hold nulls, NaN or infinities link
    with nothing (n_links 0, component_id = vec_id). Equal vectors of a label
    are compared once and counted with their multiplicity, so a hot vector
    costs one row. Rows that repeat a vec_id count as vectors of their own. An
    empty table gives an empty result; other columns are not carried. Labels may
    be of any type that has an order; vectors of doubles stay doubles. Blocks lie
    in files of the shared folder; pairs of them carry only their names.
    """
    epsilon = math.sqrt(max(0.0, 2 - 2 * threshold))
    kind = "array<float>" if vectors.select(vector_col).dtypes[0][1] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast(kind).alias("embedding"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~odd & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = _label_numbers(rows.withColumn("usable", usable)).withColumnsRenamed({"label": "own_label", "number": "label"})
    distinct = rows.filter("usable").groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"))
    distinct = materialize(distinct.withColumn("dim", F.size("embedding")), "vectors")
    basis = principal_directions(distinct)
    fields = f"label long, embedding {kind}, vec_id long, copies long, dim int"
    placed = distinct.mapInArrow(_cells(epsilon, basis), fields + ", cells array<int>, lead double")
    placed = with_position(placed, [F.col(c) for c in ("dim", "label", "cells", "lead", "vec_id")], group="dim")
    placed = placed.withColumn("block", F.expr(f"position div {BLOCK}"))
    blocks = materialize(placed.select("dim", "block", "label", "embedding", "vec_id", "copies").groupBy("dim", "block").applyInArrow(_pack(basis, new_folder(vectors.sparkSession, "blocks")), _PACKED), "blocks")
    count = (blocks.agg(F.max("block")).first()[0] or 0) + 1
    pairs = near_intervals(blocks, epsilon, count)
    side = lambda s, k: blocks.select("dim", F.col("block").alias(k), F.col("path").alias(s))
    both = pairs.join(side("p", "a"), ["dim", "a"]).join(side("q", "b"), ["dim", "b"]).select("p", "q", F.expr(f"b div {FAN}").alias("run"))
    both = both.repartition(shuffle_width(vectors.sparkSession), "p", "run").sortWithinPartitions("p", "q")
    found = materialize(both.select("p", "q").mapInArrow(_compare(threshold), "id long, links long, root long"), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select("id", "root"))
    class_of = distinct.select("label", "embedding", F.col("vec_id").alias("id"), "copies").join(links, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    key = F.struct("label", "embedding").alias("key")
    class_of = class_of.select(key, "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("root"))
    joined = join_keyed(rows.filter("usable").select(key, "vec_id", "own_label"), materialize(class_of, "roots"), "key", "copies").select("vec_id", "n_links", F.col("root").alias("component_id"), F.col("own_label").alias("label"))
    alone = rows.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("own_label").alias("label"))
    return joined.unionAll(alone).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"), "label")


def op1_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
