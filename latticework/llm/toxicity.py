"""Toxicity by cumulative-link ordinal regression.

Labels tell toxic from clean only, so grades beyond that are made here: 0
clean, 1 toxic, 2 toxic with more words of the vocabulary than the median toxic
document. The step from 0 to 1 is learned from labels alone; the one from 1 to 2
orders toxic documents by how much of them is toxic, and is no judgement from
outside. One weight for each term moves all thresholds alike:
P(grade >= k) = 1 / (1 + exp(threshold_k - score)); the expected severity is
the sum of these over k.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm import words
from latticework.llm.labelled import labelled_sample

#: Bytes of word beginnings that are terms beside the whole word; terms of the vocabulary at most.
BEGINNINGS, TERMS = (4, 5, 6, 7), 2048
#: How much more often a term must be in toxic than in clean documents.
LEAST_ODDS = 8.0

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:128] = 32
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of all words (a row for each kind of term; 0: none), and where each text's words start."""
    plain = _PLAIN[data]
    starts, ends = words.bounds(plain, offsets)
    out = [words.hashes(plain, starts, ends) | np.uint64(1)]
    for k in BEGINNINGS:
        h = words.mix(words.hashes(plain, starts, np.minimum(ends, starts + k)) + np.uint64(k)) | np.uint64(1)
        out.append(np.where(ends - starts > k, h, np.uint64(0)))
    return np.stack(out), np.searchsorted(starts, offsets)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, documents, toxic documents) of each slice of the sample."""
    for batch in batches:
        y = batch["y"].to_numpy()
        for at, data, offsets in words.text_slices(batch["text"]):
            terms, begin = _terms(data, offsets)
            each = [np.unique(terms[:, a:b]) for a, b in zip(begin[:-1], begin[1:])]
            size = np.array(list(map(len, each)))
            key, inverse = np.unique(np.concatenate([*each, np.zeros(0, np.uint64)]), return_inverse=True)
            toxic = np.bincount(inverse, np.repeat(y[at : at + len(size)], size), minlength=len(key)).astype(np.int64)
            seen = np.bincount(inverse, minlength=len(key)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(seen), pa.array(toxic)], ["term", "seen", "toxic"])


@dataclass
class Ordinal:
    """Sorted term hashes, a weight for each, and ascending thresholds."""

    terms: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def counts(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Of each text: indices of its terms, how many words have them, and words with any."""
        for _, data, offsets in words.text_slices(column):
            found, begin = _terms(data, offsets)
            if not len(self.terms):
                yield from ((np.zeros(0, np.int64), np.zeros(0, np.int64), 0) for _ in range(len(offsets) - 1))
                continue
            place = np.searchsorted(self.terms, found).clip(0, len(self.terms) - 1)
            hit = (self.terms[place] == found) & (found != 0)
            kind, word = np.nonzero(hit)
            text = np.searchsorted(begin, word, "right") - 1
            index = place[kind, word]
            order = np.argsort(text, kind="stable")
            cut = np.searchsorted(text[order], np.arange(len(offsets)))
            for a, b in zip(cut[:-1], cut[1:]):
                mine = order[a:b]
                key, n = np.unique(index[mine], return_counts=True)
                yield key, n, len(np.unique(word[mine]))

    def chances(self, index: np.ndarray, count: np.ndarray) -> np.ndarray:
        score = float(self.weights[index] @ (1 + np.log(count))) if len(index) else 0.0
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -35, 35)))


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grade: np.ndarray, size: int, grades: int = 3, decay: float = 1e-6, steps: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the largest penalised likelihood (Adam, all rows each step)."""
    owner = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    index = np.concatenate([*[i for i, _ in rows], np.zeros(0, np.int64)]).astype(np.int64)
    value = np.concatenate([*[1 + np.log(c) for _, c in rows], np.zeros(0)])
    # thresholds: the first one, and logarithms of the steps to the next ones
    p = np.zeros(size + grades - 1)
    p[size] = 2.0
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        cuts = np.cumsum(np.concatenate([p[size : size + 1], np.exp(p[size + 1 :])]))
        score = np.bincount(owner, p[index] * value, minlength=len(rows))
        above = 1 / (1 + np.exp(np.clip(cuts[None, :] - score[:, None], -35, 35)))  # P(grade >= k)
        edge = np.concatenate([np.ones((len(rows), 1)), above, np.zeros((len(rows), 1))], axis=1)
        slope = edge * (1 - edge)
        who = np.arange(len(rows))
        chance = np.maximum(edge[who, grade] - edge[who, grade + 1], 1e-12)
        by_score = -(slope[who, grade] - slope[who, grade + 1]) / chance
        by_cut = np.zeros((len(rows), grades + 1))
        by_cut[who, grade] += slope[who, grade] / chance
        by_cut[who, grade + 1] -= slope[who, grade + 1] / chance
        to_cut = by_cut[:, 1:-1].sum(0)
        g = np.zeros_like(p)
        g[:size] = np.bincount(index, by_score[owner] * value, minlength=size)
        g[size] = to_cut.sum()
        for k in range(1, grades - 1):
            g[size + k] = to_cut[k:].sum() * np.exp(p[size + k])
        g = g / len(rows)
        g[:size] += decay * p[:size]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return p[:size], np.cumsum(np.concatenate([p[size : size + 1], np.exp(p[size + 1 :])]))


def _gather(model: Ordinal):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(model.counts(batch["text"]))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["y"], pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.int64())], ["id", "y", "terms", "counts", "hits"])

    return run


def train_toxicity(docs: DataFrame, labels: DataFrame, most: int = 20_000, most_terms: int = TERMS, id_col: str = "doc_id", text_col: str = "text") -> Ordinal:
    """Learn from about ``most`` labelled documents at most that are not held out.

    The vocabulary is the ``most_terms`` words and word beginnings that speak most
    clearly for toxicity: seen in at least three toxic documents of the sample,
    and there (at the lower end of what chance allows) at least ``LEAST_ODDS``
    times as often as in clean ones. The driver holds them, so they are bounded;
    where fewer pass the test, ``most_terms`` leaves none out. Without toxic or clean
    rows the model calls every text clean.
    """
    sample = labelled_sample(docs, labels, "toxic", most, id_col, text_col).persist()
    try:
        n, bad = sample.agg(F.count(F.lit(1)), F.sum("y")).first()
        bad = bad or 0
        clean = Ordinal(np.zeros(0, np.uint64), np.zeros(0), np.array([35.0, 35.0]))
        if not bad or bad == n:
            return clean
        terms = sample.mapInArrow(_count_terms, "term long, seen long, toxic long").groupBy("term").agg(F.sum("seen").alias("seen"), F.sum("toxic").alias("toxic"))
        odds = F.log((F.col("toxic") + 0.5) / bad / ((F.col("seen") - F.col("toxic") + 0.5) / (n - bad)))
        error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("seen") - F.col("toxic") + 0.5))
        terms = terms.filter("term <> 0 and toxic >= 3").withColumn("odds", odds - 1.64 * error).filter(F.col("odds") >= float(np.log(LEAST_ODDS)))
        chosen = terms.orderBy((F.col("odds") * F.sqrt("toxic")).desc(), "term").limit(most_terms).select("term").toArrow()["term"].to_numpy()
        model = Ordinal(np.sort(chosen.astype(np.int64).view(np.uint64)), np.zeros(len(chosen)), clean.thresholds)
        seen = sample.mapInArrow(_gather(model), "id long, y int, terms array<long>, counts array<long>, hits long").toArrow().sort_by("id")
    finally:
        sample.unpersist()
    y, hits = seen["y"].to_numpy(), seen["hits"].to_numpy()
    grade = np.where(y == 1, 1 + (hits > np.median(hits[y == 1])), 0)
    rows = [(np.array(a, np.int64), np.array(b, np.int64)) for a, b in zip(seen["terms"].to_pylist(), seen["counts"].to_pylist())]
    model.weights, model.thresholds = fit_ordinal(rows, grade, len(model.terms))
    return model


def _grade(model: Ordinal):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(model.counts(batch["text"]))
            chance = np.array([model.chances(i, c) for i, c, _ in found]).reshape(-1, len(model.thresholds))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(chance.sum(1)), pa.array((chance >= 0.5).sum(1).astype(np.int32)), pa.array(np.array([h for _, _, h in found], np.int64))], ["doc_id", "severity", "grade", "hits"])

    return run


def grade_toxicity(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, severity (0 to 2), grade (0 to 2), toxic (grade > 0), hits.

    The whole text is read, however long; a null or empty one has no terms.
    Equal texts have equal grades, and repeated rows are graded each; an empty table gives an empty result; other columns are
    not carried.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    graded = rows.mapInArrow(_grade(model), f"doc_id {kind}, severity double, grade int, hits long")
    return graded.select("doc_id", "severity", "grade", (F.col("grade") > 0).alias("toxic"), "hits")


def keep_clean(docs: DataFrame, model: Ordinal, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not graded toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([bool(model.chances(i, c)[0] < 0.5) for i, c, _ in model.counts(batch[text_col])], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return grade_toxicity(docs, train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
