"""Sharding, mixing, the classifiers and the pipeline."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from latticework.llm import quality, toxicity
from latticework.llm.mixing import mix_documents
from latticework.llm.sharding import shard_documents
from tests.llm.helpers import documents, fuller, prose


def least_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        cap, n, held = (low + high) // 2, 1, 0
        for s in sizes:
            if held + s > cap:
                n, held = n + 1, 0
            held += s
        low, high = (low, cap) if n <= shards else (cap + 1, high)
    return low


@pytest.mark.parametrize("few", [100_000, 10])
def test_sharding(spark, few, monkeypatch):
    import latticework.llm.sharding as s

    monkeypatch.setattr(s, "FEW", few)
    rows = fuller(150)[:-1] + [(7000 + i, "hot copy of a text", "en", "a", 18) for i in range(40)] + [(4, "one", "x", "repeated", 3)]
    got = shard_documents(documents(spark, rows=rows).withColumn("shard", F.lit("x")), shards=5).collect()
    assert len(got) == len(rows)
    text = {r[0]: (r[1] or "").encode() for r in rows}
    groups = {}
    for r in got:
        t = text[r.doc_id]
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(t) + 1, zlib.crc32(t), "bytes", None)
        groups.setdefault(hashlib.sha256(t).digest(), []).append(r)
    assert all(len({r.shard for r in g}) == 1 for g in groups.values())
    sizes = [sum(r["size"] for r in groups[d]) for d in sorted(groups)]
    held = [sum(r["size"] for r in got if r.shard == k) for k in range(5)]
    assert max(held) == least_capacity(sizes, 5)
    for k in range(5):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    assert shard_documents(documents(spark, rows=[])).count() == 0


def test_few_groups(spark):
    rows = [(i, "same", "en", "a", 4) for i in range(9)]
    got = shard_documents(documents(spark, rows=rows)).collect()
    assert {r.shard for r in got} == {0} and sorted(r.slot for r in got) == list(range(9))


def filled(sizes, weights, budget, epochs):
    cap = [epochs * s for s in sizes]
    free, out = set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        level = max(0.0, budget - sum(cap[i] for i in range(len(sizes)) if i not in free)) / sum(weights[i] for i in free)
        over = {i for i in free if cap[i] <= level * weights[i]}
        if not over:
            for i in free:
                out[i] = level * weights[i]
            break
        free -= over
    return [cap[i] if i not in free else out[i] for i in range(len(sizes))]


def test_mixing(spark):
    rows = fuller(200)[:-1]
    docs = documents(spark, rows=rows).withColumn("size", F.lit(-1)).withColumn("target", F.lit("x"))
    got = mix_documents(docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix_documents(docs.repartition(7)).collect()))
    names = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    size = {r[0]: len((r[1] or "").encode().split()) for r in rows}
    total = {n: sum(size[r[0]] for r in rows if r[3] == n) for n in names}
    want = dict(zip(names, filled([total[n] for n in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(total.values()), 2.0)))
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == total[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken == r["size"] * r.repeats <= 2 * r["size"]
    for n in names:
        mine = [r for r in got if r.source == n]
        assert abs(sum(r.taken for r in mine) - want[n]) <= max(r["size"] for r in mine) / 2 + 1
    assert sum(want.values()) == pytest.approx(1.5 * sum(total.values()))
    assert mix_documents(documents(spark, rows=[])).count() == 0


def labelled(spark, n=400):
    texts = prose(n, 4)
    rows, labels = [], []
    for i, t in enumerate(texts):
        bad, rude = i % 3 == 0, i % 5 == 0
        t = t.upper().replace(" ", "!! ") + "!!" if bad else t
        t = t + " scumbag" if rude else t
        rows.append((i, t, "en", "s", len(t)))
        labels.append((i, int(not bad), int(rude)))
    labels += [(0, 0, 1), (1, None, None), (None, 1, 1), (2, 0, 1), (9999, 1, 0)]
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark):
    rows, labels = labelled(spark)
    docs = documents(spark, extra=[(10_000 + i, t, l, s, n) for i, t, l, s, n in rows]).filter("doc_id >= 10000")
    docs = docs.withColumn("doc_id", F.col("doc_id") - 10_000)
    model = quality.train_quality(docs, labels)
    got = {r.doc_id: r for r in quality.score_quality(docs.withColumn("score", F.lit("x")), model).collect()}
    out = [(i, r) for i, r in got.items() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert np.mean([r.predicted == int(i % 3 != 0) for i, r in out]) > 0.95
    again = {r.doc_id: r.score for r in quality.score_quality(docs, quality.train_quality(docs.repartition(5), labels)).collect()}
    assert again == {i: r.score for i, r in got.items()}
    odd = quality.score_quality(documents(spark), model).collect()
    assert len(odd) == 9 and all(0 <= r.score <= 1 for r in odd)
    assert quality.score_quality(documents(spark, rows=[]), model).count() == 0
    assert {r.predicted for r in quality.score_quality(docs, quality.train_quality(docs, labels.limit(0))).collect()} == {1}
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got.values())


def test_held_out_labels_are_not_read(spark):
    rows, labels = labelled(spark)
    docs = documents(spark, rows=rows)
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    turned = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.train_quality(docs, x) for x in (labels, turned))
    assert (a.weight == b.weight).all() and (a.bias, a.slope, a.shift) == (b.bias, b.slope, b.shift)


def test_dual_coordinate_descent_separates():
    draw = np.random.default_rng(0)
    rows = [np.sort(draw.choice(50, 5, replace=False)) for _ in range(200)]
    y = np.array([int(r.sum() > 125) for r in rows])
    w, b = quality.dual_coordinate_descent(rows, [np.ones(5)] * 200, y, np.full(200, 10.0), 50, epochs=200)
    assert np.mean([(w[r].sum() + b > 0) == t for r, t in zip(rows, y)]) > 0.97


def test_log_count_ratios():
    draw = np.random.default_rng(1)
    rows = [np.sort(draw.choice(40, draw.integers(1, 9), replace=False)) for _ in range(60)]
    y = draw.integers(0, 2, 60)
    got = quality.log_count_ratios(rows, y)
    held = [[1 + sum(f in set(r.tolist()) for r, t in zip(rows, y) if t == c) for f in range(quality.SIZE)] for c in (0, 1)]
    want = np.log(np.array(held[1]) / sum(held[1])) - np.log(np.array(held[0]) / sum(held[0]))
    assert np.allclose(got, want)


def test_dual_coordinate_descent_reaches_the_optimum():
    draw = np.random.default_rng(2)
    rows = [np.sort(draw.choice(12, 4, replace=False)) for _ in range(40)]
    values = [draw.normal(size=4) for _ in rows]
    y, cost = draw.integers(0, 2, 40), draw.uniform(0.2, 2.0, 40)
    w, b = quality.dual_coordinate_descent(rows, values, y, cost, 12, epochs=4000)
    x = np.zeros((40, 13))
    for i, (r, v) in enumerate(zip(rows, values)):
        x[i, r], x[i, 12] = v, 1.0
    sign = np.where(y == 1, 1.0, -1.0)
    # projected gradient steps on the whole dual problem
    q = (sign[:, None] * x) @ (sign[:, None] * x).T
    alpha = np.zeros(40)
    for _ in range(40_000):
        alpha = np.clip(alpha - (q @ alpha - 1) / np.linalg.norm(q, 2), 0, cost)
    best = (alpha * sign) @ x
    objective = lambda u: u @ u / 2 + cost @ np.maximum(0, 1 - sign * (x @ u))
    assert objective(np.append(w, b)) <= objective(best) * (1 + 1e-4)
    assert np.allclose(np.append(w, b), best, atol=2e-2)


def test_calibration():
    margins = np.linspace(-3, 3, 400)
    y = (np.random.default_rng(3).uniform(size=400) < 1 / (1 + np.exp(-(2 * margins - 1)))).astype(int)
    a, b = quality._calibrate(margins, y)
    loss = lambda a, b: np.mean(np.log1p(np.exp(-np.where(y == 1, 1, -1) * (a * margins + b))))
    assert loss(a, b) <= min(loss(p, q) for p in np.linspace(0.5, 4, 36) for q in np.linspace(-3, 2, 51)) + 1e-3


def test_classifiers_on_long_tied_and_repeated_texts(spark):
    rows, labels = labelled(spark, 200)
    docs = documents(spark, rows=rows)
    good, tox = quality.train_quality(docs, labels), toxicity.train_toxicity(docs, labels)
    long = "calm words " * 150_000
    odd = documents(spark, rows=[(1, long, "en", "a", 1), (2, long + "scumbag", "en", "a", 1), (3, rows[3][1], "en", "a", 1), (3, rows[3][1], "en", "a", 1), (4, rows[3][1], "fr", None, 1)])
    scores = sorted((r.doc_id, r.score) for r in quality.score_quality(odd, good).collect())
    assert len(scores) == 5 and len({s for i, s in scores if i > 2}) == 1
    grades = sorted((r.doc_id, r.severity, r.hits) for r in toxicity.grade_toxicity(odd, tox).collect())
    assert len(grades) == 5 and len({g[1:] for g in grades if g[0] > 2}) == 1 and [g[2] for g in grades[:2]] == [0, 1]
    small = quality.train_quality(docs, labels, most_features=3000)
    again = quality.train_quality(docs.repartition(3), labels, most_features=3000)
    assert (small.weight == again.weight).all() and (small.weight != good.weight).any()


def test_toxicity(spark):
    rows, labels = labelled(spark)
    docs = documents(spark, rows=rows)
    model = toxicity.train_toxicity(docs, labels)
    got = {r.doc_id: r for r in toxicity.grade_toxicity(docs.withColumn("grade", F.lit("x")), model).collect()}
    out = [r for i, r in got.items() if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(r.toxic == (r.doc_id % 5 == 0) for r in out)
    assert all(0 <= r.severity <= 2 and r.toxic == (r.grade > 0) for r in got.values())
    assert len(toxicity.grade_toxicity(documents(spark), model).collect()) == 9
    none = toxicity.train_toxicity(docs, labels.limit(0))
    assert not any(r.toxic for r in toxicity.grade_toxicity(docs, none).collect())
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.toxic}


def test_ordinal_thresholds_ascend():
    rows = [(np.array([i % 4]), np.array([1])) for i in range(400)]
    grade = np.array([0 if i % 4 < 2 else i % 4 - 1 for i in range(400)])
    w, cuts = toxicity.fit_ordinal(rows, grade, 4)
    assert cuts[0] < cuts[1] and w[3] > w[2] > w[0]
    model = toxicity.Ordinal(np.arange(4, dtype=np.uint64), w, cuts)
    assert model.chances(np.array([3]), np.array([1])).sum() > 1.5 > 0.5 > model.chances(np.array([0]), np.array([1])).sum()


def test_ordinal_reaches_the_optimum():
    """Against steps along numerical gradients of the penalised likelihood."""
    draw = np.random.default_rng(4)
    rows = [(np.sort(draw.choice(5, 2, replace=False)), draw.integers(1, 4, 2)) for _ in range(150)]
    grade = np.array([min(2, int(i.sum() + draw.integers(0, 3)) // 3) for i, _ in rows])
    x = np.zeros((150, 5))
    for k, (i, c) in enumerate(rows):
        x[k, i] = 1 + np.log(c)

    def loss(p):
        cuts = np.cumsum([p[5], np.exp(p[6])])
        above = 1 / (1 + np.exp(cuts[None, :] - (x @ p[:5])[:, None]))
        edge = np.concatenate([np.ones((150, 1)), above, np.zeros((150, 1))], axis=1)
        return -np.mean(np.log(edge[np.arange(150), grade] - edge[np.arange(150), grade + 1])) + 1e-3 / 2 * p[:5] @ p[:5]

    p = np.zeros(7)
    for _ in range(4000):
        p -= 0.5 * np.array([(loss(p + e) - loss(p - e)) / 2e-5 for e in np.eye(7) * 1e-5])
    w, cuts = toxicity.fit_ordinal(rows, grade, 5, decay=1e-3, steps=4000)
    assert loss(np.concatenate([w, [cuts[0], np.log(cuts[1] - cuts[0])]])) <= loss(p) + 1e-5
    assert np.allclose(w, p[:5], atol=0.02)


def test_repeated_ids_keep_unlike_texts(spark):
    import corpus_pipeline

    a, b, c = prose(3, 4, 40)
    a, b, c = (t + " one two three four five six seven" + x for t, x in ((a, " a"), (b, " b"), (c, " c")))
    rows = [(3, a, "en", "s", 1), (5, a, "en", "s", 1), (5, b, "en", "s", 1), (5, b, "en", "t", 1), (5, c, "fr", "s", 1), (6, "", "en", "s", 0), (6, " ", "en", "s", 1), (7, "", "en", "s", 0), (None, c, "en", "s", 1)]
    docs = documents(spark, rows=rows)
    for parts in (1, 5):
        kept = corpus_pipeline.drop_near_duplicates(spark, docs.repartition(parts), "")
        got = sorted((r.doc_id or 0, (r.text or "").strip()) for r in kept.collect())
        assert got == sorted([(3, a), (5, b), (5, c), (6, ""), (7, "")])
    rows = [(1, "x y", "en", "s", 1), (1, "u v", "en", "s", 1), (1, "p q r", "en", "s", 1), (1, "p q r", "en", "s", 1), (2, "k l", "en", None, 1), (None, "n " * 50, "en", "s", 1), (None, None, "en", "s", 0)]
    runs = [sorted((r.doc_id or 0, r.text or '') for r in corpus_pipeline.mix_sources(spark, documents(spark, rows=rows).repartition(n), "").collect()) for n in (1, 4)]
    assert runs[0] == runs[1]
    times = Counter(runs[0])
    # 61 words share 91.5: source s has 59 of them and weight 3, null 2 and weight 1; null stops at 4
    assert times[(2, "k l")] == 2 and all(times[(r[0] or 0, r[1])] >= (2 if r[1] == "p q r" else 1) for r in rows if r[1])
    assert abs(sum(len(t.split()) for i, t in runs[0] if i != 2) - 87.5) <= 25
    assert times[(0, '')] == 1  # taken whole times like all of its source, never for the rest
    for none in (documents(spark, rows=[]), documents(spark, rows=rows[-1:])):
        for stage in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.mix_sources, corpus_pipeline.tokenize):
            assert stage(spark, none, "").count() == none.count() * (stage is not corpus_pipeline.mix_sources)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    documents(spark, rows=[]).write.parquet(f"{tmp_path}/documents.parquet")
    labelled(spark, 10)[1].write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    from latticework.llm.mixing import mix_documents as mix
    from tests.llm.test_joins import jaccard_truth

    rows, labels = labelled(spark, 300)
    texts = prose(40, 9)
    rows = rows[:300] + [(500 + i, t, "en", f"s{i % 2}", 1) for i, t in enumerate(texts)] + [(600 + i, t + " tail", "en", None, 1) for i, t in enumerate(texts)] + [(None, "no id", "en", "s", 5), (700, None, None, None, None), (701, "", "en", "s", 0)]
    docs = documents(spark, rows=rows).withColumn("repeats", F.lit(7)).withColumn("_copy", F.lit("x"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = list((r.doc_id, bytes(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    tox = toxicity.train_toxicity(docs, labels)
    column = lambda rs: pa.array([r[1] or "" for r in rs])
    kept = [r for r, (i, c, _) in zip(rows, tox.counts(column(rows))) if tox.chances(i, c)[0] < 0.5]
    good = quality.train_quality(documents(spark, rows=kept), labels)
    kept = [r for r, f in zip(kept, quality.indicators(column(kept))) if good.score(f) >= 0.5]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    truth, _ = jaccard_truth([(at, *r[1:]) for at, r in enumerate(kept)])
    kept = [r for at, r in enumerate(kept) if truth[at][1] == at]
    assert len(kept) > 100
    # rows are numbered, as one of them has no id
    taken = {r.doc_id: r.repeats for r in mix(documents(spark, rows=[(at, *r[1:]) for at, r in enumerate(kept)])).collect()}
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = [(r[0], np.array(tok.encode(r[1] or "", add_special_tokens=False).ids, "<u4").tobytes()) for at, r in enumerate(kept) for _ in range(taken[at])]
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(got, key=order) == sorted(want, key=order)
