"""Quality scores by naive Bayes support vectors: indicators of n-grams scaled
by their class log-count ratios, and a linear hinge-loss model fitted on them
by dual coordinate descent."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm import words
from latticework.llm.common import materialize
from latticework.llm.labelled import held_out, labelled_sample

#: Bits of the hashed space of words and word pairs, and of character classes.
WORD_BITS, SHAPE_BITS = 18, 16
#: Longest n-gram of character classes.
SHAPE_N = 4
_RATES = 64
SIZE = (1 << WORD_BITS) + (1 << SHAPE_BITS) + _RATES

_CLASS = np.full(256, 1, np.uint64)  # letters beyond ASCII count as lower case
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[9, 10, 11, 12, 13]] = 4
_CLASS[32] = 5
_CLASS[:9] = _CLASS[14:32] = _CLASS[127] = 6
for _i, _c in enumerate(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _CLASS[_c] = 7 + _i
_STEPS = np.array([0.0, 0.01, 0.03, 0.1, 0.2, 0.35, 0.5, 0.75])


def _rates(*values: float) -> list[int]:
    base = (1 << WORD_BITS) + (1 << SHAPE_BITS)
    return [base + 9 * i + int(np.searchsorted(_STEPS, v, "left")) for i, v in enumerate(values)]


def _line_marks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lines with content of all texts, and where each text's begin."""
    edges = np.union1d(np.flatnonzero(data == 10) + 1, offsets)
    starts, ends = edges[:-1], edges[1:].copy()
    ends[data[ends - 1] == 10] -= 1
    full = ends > starts
    starts = starts[full]
    return words.hashes(data, starts, ends[full]), np.searchsorted(starts, offsets)


def indicators(column: pa.Array) -> Iterator[np.ndarray]:
    """Indices of the features of each text, each once: words, pairs of
    words, n-grams of character classes (a run counts as two at most), and how
    often words and lines repeat. A text without any has none."""
    for _, data, offsets in words.text_slices(column):
        starts, ends = words.bounds(data, offsets)
        h = words.hashes(data, starts, ends, lower=True)
        at = np.searchsorted(starts, offsets)
        pair = words.mix(h[:-1] * np.uint64(3) + h[1:])
        kind = _CLASS[data]
        marks, lines = _line_marks(data, offsets)
        for i in range(len(offsets) - 1):
            a, b, x, y = at[i], at[i + 1], offsets[i], offsets[i + 1]
            if a == b:
                yield np.zeros(0, np.int32)
                continue
            k = kind[x:y]
            keep = np.ones(len(k), bool)
            keep[2:] = (k[2:] != k[1:-1]) | (k[2:] != k[:-2])
            k = k[keep]
            found = [(h[a:b] & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)]
            if b - a > 1:
                found.append((pair[a : b - 1] & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64))
            code = np.zeros(len(k), np.uint64)
            for n in range(1, SHAPE_N + 1):
                if len(k) < n:
                    break
                code = code[: len(k) - n + 1] * np.uint64(64) + k[n - 1 :]
                found.append((1 << WORD_BITS) + (words.mix(code + np.uint64(n << 40)) >> np.uint64(64 - SHAPE_BITS)).astype(np.int64))
            again = float(np.mean(h[a + 1 : b] == h[a : b - 1])) if b - a > 1 else 0.0
            mine = marks[lines[i] : lines[i + 1]]
            copied = 1 - len(np.unique(mine)) / len(mine) if len(mine) > 1 else 0.0
            found.append(np.array(_rates(again, copied, float(np.mean(kind[x:y] == 2)), float(np.mean(kind[x:y] >= 7))), np.int64))
            yield np.unique(np.concatenate(found)).astype(np.int32)


@dataclass
class NbSvm:
    """margin = sum of ``weight`` over a text's features / norm of their ``scale`` + ``bias``;
    score = 1 / (1 + exp(-(slope * margin + shift)))."""

    weight: np.ndarray
    scale2: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, features: np.ndarray) -> float:
        norm = float(self.scale2[features].sum()) ** 0.5
        return (float(self.weight[features].sum()) / norm if norm else 0.0) + self.bias

    def score(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(features) + self.shift, -35, 35))))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """ln of the smoothed share of each feature in class 1 over that in class 0."""
    counts = [np.full(SIZE, smooth), np.full(SIZE, smooth)]
    for features, label in zip(rows, y):
        counts[int(label)][features] += 1
    return np.log((counts[1] / counts[1].sum()) / (counts[0] / counts[0].sum()))


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, size: int, epochs: int = 12, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear hinge-loss model; ``cost`` bounds each dual variable."""
    w, bias = np.zeros(size), 0.0
    sign = np.where(y == 1, 1.0, -1.0)
    alpha = np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for v in values])
    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in draw.permutation(len(rows)):
            gradient = sign[i] * (float(w[rows[i]] @ values[i]) + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, bias


def _calibrate(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through the margins (Newton steps, smoothed targets)."""
    ones, n = float(y.sum()), len(y)
    t = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (n - ones + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        d, s = p - t, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([d @ margins + 1e-3 * a, d.sum()])
        hess = np.array([[s @ margins**2 + 1e-3, s @ margins], [s @ margins, s.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if abs(step).max() < 1e-6:
            break
    return max(float(a), 1e-3), float(b)


def fit(rows: list[np.ndarray], y: np.ndarray, cost: float = 1.0) -> NbSvm:
    """Fit on four fifths of the rows and calibrate on the rest. With one class
    or no rows every score is that class's share (1/2 without rows)."""
    n = len(y)
    if n < 10 or len(set(y.tolist())) < 2:
        share = (float(y.sum()) + 1) / (n + 2)
        return NbSvm(np.zeros(SIZE), np.zeros(SIZE), 0.0, 1.0, float(np.log(share / (1 - share))))
    part = np.arange(n) % 5 == 0
    if len(set(y[~part].tolist())) < 2 or len(set(y[part].tolist())) < 2:
        part[:] = False
    learn = np.flatnonzero(~part)
    ratio = log_count_ratios([rows[i] for i in learn], y[learn])

    def scaled(features: np.ndarray) -> np.ndarray:
        v = ratio[features]
        norm = np.sqrt(v @ v)
        return v / norm if norm else v

    share = np.array([np.mean(y[learn] == c) for c in (0, 1)])
    costs = cost * 0.5 / share[y[learn].astype(int)]
    w, bias = dual_coordinate_descent([rows[i] for i in learn], [scaled(rows[i]) for i in learn], y[learn], costs, SIZE)
    model = NbSvm(w * ratio, ratio**2, bias, 1.0, 0.0)
    tested = np.flatnonzero(part) if part.any() else learn
    model.slope, model.shift = _calibrate(np.array([model.margin(rows[i]) for i in tested]), y[tested])
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = list(indicators(batch["text"]))
        yield pa.RecordBatch.from_arrays([batch["id"], batch["y"], pa.array(rows, pa.list_(pa.int32()))], ["id", "y", "features"])


def train_quality(docs: DataFrame, labels: DataFrame, most: int = 8000, most_features: int = 20_000_000, id_col: str = "doc_id", text_col: str = "text") -> NbSvm:
    """The model of ``labels.quality``, learned on the driver from labelled
    documents that are not held out: about ``most`` at most, and of these, in an
    order by hash of the id, as many as have ``most_features`` features together
    (four bytes each), so the driver's memory is bounded however long texts are."""
    sample = labelled_sample(docs, labels, "quality", most, id_col, text_col)
    rows = materialize(sample.mapInArrow(_features, "id long, y int, features array<int>").withColumn("draw", F.xxhash64("id", F.lit("order"))), "features")
    sizes = rows.select("draw", F.size("features").alias("n")).toArrow().sort_by("draw")  # two numbers for each of `most` rows
    fit_in = np.searchsorted(np.cumsum(sizes["n"].to_numpy()), most_features, "right")
    if fit_in < len(sizes):
        rows = rows.filter(F.col("draw") < sizes["draw"][int(fit_in)].as_py())
    found = rows.drop("draw").toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    column = found["features"].combine_chunks()
    column = column if not isinstance(column, pa.ChunkedArray) else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.int32()))
    flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return fit([flat[a:b] for a, b in zip(at[:-1], at[1:])], found["y"].to_numpy())


def _score(model: NbSvm):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([model.score(f) for f in indicators(batch["text"])], np.float64)
            rest = [c for c in batch.schema.names if c != "score"]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in rest], pa.array(scores)], [*rest, "score"])

    return run


def score_quality(docs: DataFrame, model: NbSvm, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    The whole text, however long, is the only input of the score; a null text
    counts as empty, and an empty one has the score of the bias. Equal texts have
    equal scores, and repeated rows are scored each; an empty table gives an empty
    result; other columns are not carried.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    scored = rows.mapInArrow(_score_ids(model), f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _score_ids(model: NbSvm):
    inner = _score(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in inner(batches):
            yield batch.select(["doc_id", "score"])

    return run


def keep_good(docs: DataFrame, model: NbSvm, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is predicted good."""
    schema = docs.schema
    return docs.mapInArrow(_filter(model, text_col), schema)


def _filter(model: NbSvm, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(f) >= 0.5 for f in indicators(batch[text_col])], pa.bool_()))

    return run


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_quality(docs, train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
