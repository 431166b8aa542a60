"""Near-duplicate operators against brute force."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.llm.common import shared_dir
from latticework.llm.components import components, local_roots
from latticework.llm.embedding_dedup import near_duplicates
from latticework.llm.ngram_join import jaccard_components
from latticework.llm.simhash import BITS, compare_edited, edited, fingerprints, near_fingerprints, op2_simhash, probed_fingerprints
from tests.llm.helpers import SCHEMA, documents, fuller


def left_in_shared(spark):
    return set(os.listdir(shared_dir(spark).removeprefix("file://")))


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def shingle_set(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def jaccard_truth(rows):
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), r) for i, r in roots(ids, links).items()}, links


@pytest.mark.parametrize("seed", [0, 1])
def test_jaccard_components(spark, seed):
    rows = fuller(120, seed)
    truth, links = jaccard_truth(rows)
    assert len(links) > 10
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(documents(spark, rows=rows)).collect()}
    assert got == truth


def test_jaccard_group_of_copies(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[: 30 + i % 3] + [f"x{i}"] + base[31:]), None, None, 0) for i in range(60)]
    rows += [(100 + i, " ".join(base[:50]), None, None, 0) for i in range(30)] + [(None, "no id", None, None, 0)]
    truth, _ = jaccard_truth([r for r in rows if r[0] is not None])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(documents(spark, rows=rows)).collect()}
    assert got == truth


def pattern(n=1024):
    """Two texts that every polynomial hash modulo a power of two takes for one."""
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_shingles_of_few_words():
    import pyarrow as pa

    from latticework.llm import words

    bank = "p q r s t u v".split()
    texts = [" ".join(bank[:n]) for n in range(7)]
    alone = [[list(s) for s in words.Shingles(5)(pa.array([t], pa.string()))][0] for t in texts]
    assert [len(s) for s in alone] == [0, 1, 1, 1, 1, 1, 2]
    assert len({tuple(s) for s in alone}) == 7
    for n, t in enumerate(texts):
        for other in ["z " * 600_000, "z", "", None]:
            got = [list(s) for s in words.Shingles(5)(pa.array([other, t], pa.string()))]
            assert got[1] == alone[n] and got[0] == [list(s) for s in words.Shingles(5)(pa.array([other], pa.string()))][0]
        for m in range(7):
            assert [list(s) for s in words.Shingles(5)(pa.array([t, texts[m]]))] == [alone[n], alone[m]]


def test_hashes_tell_patterns_apart():
    from latticework.llm import words

    for n in (1, 2, 3, 8, 16, 64, 128, 256, 1024, 4096):
        a, b = (np.frombuffer(t.encode(), np.uint8) for t in pattern(n))
        both = np.concatenate([a, b])
        x, y = words.hashes(both, np.array([0, n]), np.array([n, 2 * n]))
        assert x != y
    texts = ["x" * n for n in range(600)] + ["\0" * n for n in range(1, 600)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    assert len(set(words.hashes(data, ends - [len(t) for t in texts], ends).tolist())) == len(texts)


def test_jaccard_of_few_and_of_patterned_words(spark):
    one, other = pattern()
    base = [f"v{i}" for i in range(19)]
    rows = [(1, "two words"), (2, " ".join(base[:10] + [one] + base[10:])), (3, " ".join(base[:10] + [other] + base[10:])), (4, one), (5, other), (6, "Two  words"), (7, "a b c"), (8, None)]
    truth, _ = jaccard_truth(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == truth and got[3][1] == 3 and got[5][1] == 5
    alone = jaccard_components(spark.createDataFrame(rows[:1], "doc_id long, text string")).collect()
    assert [tuple(r) for r in alone] == [(1, 1, 1)]


def test_jaccard_blocks(spark, monkeypatch):
    """A group whose likeness lies around the threshold, over pairs of blocks."""
    import latticework.llm.ngram_join as j

    draw = np.random.default_rng(4)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(150):
        words = list(base) if i % 3 else base[40:] + base[:40]
        for at in draw.choice(80, draw.integers(0, 5), replace=False):
            words[at] = f"x{draw.integers(10**6)}"
        rows.append((i, " ".join(words)))
    truth, links = jaccard_truth(rows)
    assert len(links) > 500 and len({r for _, r in truth.values()}) > 10
    for block, centres in ((1 << 9, 1), (1 << 12, 1), (1 << 18, 4)):
        monkeypatch.setattr(j, "BLOCK", block)
        monkeypatch.setattr(j, "CENTRES", centres)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == truth


def test_counts_of_shingles():
    import pyarrow as pa

    from latticework.llm import words
    from latticework.llm.ngram_join import _count, _slots

    tokens = np.sort(np.random.default_rng(5).integers(0, 2**64, 5000, np.uint64))
    for buckets in (1, 3, 211, 1 << 20):
        bucket, slot = _slots(tokens, buckets)
        assert (np.diff(bucket) >= 0).all() and bucket.max() < buckets
        assert len(set(zip(bucket.tolist(), slot.tolist()))) == len(tokens)
    held = [np.array(x, "<u4") for x in ([1, 2, 9], [2, 9], [], [9, 10])]
    counts = [np.array(x, "<u4") for x in ([1, 1, 3], [1, 1], [], [1, 2])]
    table = pa.table({"chunk": list("abcd"), "bucket": [0] * 4, "slots": [words.planes(np.diff(x, prepend=np.uint32(0))) for x in held], "counts": [words.planes(x) for x in counts]})
    level = lambda n: 1 + int(4 * np.log2(n)) if n > 1 else 0
    assert [list(x.as_py()) for x in _count(table)["levels"]] == [[level(1), level(2), level(5)], [level(2), level(5)], [], [level(5), level(2)]]


def test_empty_and_clashing(spark):
    none = documents(spark, rows=[])
    assert jaccard_components(none).count() == 0
    assert compare_edited(none).count() == 0
    odd = documents(spark).withColumn("token", F.lit(1)).withColumn("component_id", F.lit("x")).withColumn("part", F.lit(2)).withColumn("cid", F.lit("y")).withColumn("fingerprint", F.lit("z"))
    assert jaccard_components(odd).count() == compare_edited(odd).count() == odd.count()


def test_jaccard_leaves_no_sets_behind(spark):
    before = left_in_shared(spark)
    rows = [(i, " ".join(f"w{i % 7}x{j}" for j in range(30))) for i in range(40)]
    found = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = left_in_shared(spark) - before
    assert not [x for x in kept if x.startswith("latticework-sets-")] and [x for x in kept if x.startswith("latticework-prefixes-")]
    assert {r.doc_id: r.component_id for r in found.collect()} == {i: i % 7 for i in range(40)}


def test_few_links_take_no_rounds(spark, monkeypatch):
    draw = np.random.default_rng(4)
    links = [(i, i + 1) for i in range(400)] + [(int(x), 10_000 + int(y)) for x, y in zip(draw.integers(500, 900, 300), draw.integers(0, 300, 300))]
    table = spark.createDataFrame([links[i] for i in draw.permutation(len(links))], "a long, b long").repartition(4).localCheckpoint()
    before = left_in_shared(spark)
    got = {r.node: r.root for r in components(table).collect()}
    assert len([x for x in left_in_shared(spark) - before if x.startswith("latticework-stars-")]) == 1
    monkeypatch.setattr("latticework.llm.components.CHUNK", 0)  # of the driver alone: rounds to the end
    rounds = {r.node: r.root for r in components(table).collect()}
    nodes, roots = local_roots(*np.array(links).T)
    assert got == rounds == {int(n): int(r) for n, r in zip(nodes, roots) if n != r}


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 200), (200, 300)]
    want = roots({n for e in links for n in e}, links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: r for n, r in want.items() if n != r}


def embedding_rows(n, seed):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, 8))
    rows = []
    for i in range(n):
        v = centres[i % 6] + draw.normal(size=8) * (0.1 if i % 3 else 2.0)
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 2)))
    rows += [(n + i, rows[0][1], 0) for i in range(20)]
    rows += [(n + 30, None, 0), (n + 31, [0.0] * 8, 0), (n + 32, [1.0, None] + [0.0] * 6, 0), (n + 33, [float("nan")] * 8, 0), (n + 34, [float("inf")] + [1.0] * 7, 0), (n + 35, rows[0][1], None), (n + 36, [], 0), (n + 37, [1.0, 2.0], 0), (n + 38, [2.0, 4.0], 0)]
    return rows


def test_embedding_near_duplicates(spark):
    rows = embedding_rows(150, 3)
    good = {}
    for i, v, label in rows:
        if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            good[i] = (np.array(v) / np.linalg.norm(v), label)
    ids = sorted(good)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] >= 0.93]
    assert len(links) > 200
    root = roots([r[0] for r in rows], links)
    count = {r[0]: 0 for r in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(table).collect()}
    assert got == {i: (count[i], root[i], root[i] == i) for i in root}
    assert near_duplicates(table.limit(0)).count() == 0


def test_embedding_kinds(spark):
    """Doubles stay doubles, also those that no float holds; labels may be texts."""
    near, apart = [1.0, 2.657e-1 * 1.4875], [1.0, 2.657e-1 * 1.488]
    rows = [(1, [1e200, 0.0], "a"), (2, [1.0, 1e-9], "a"), (3, [1e-200, 0.0], "a"), (4, [0.0, 1e300], "a"), (5, [1.0, 0.0], "b"), (6, [1.0, 0.1], "b"), (7, [1.0, 0.0], None), (8, near, "c"), (9, apart, "c"), (10, [1.0, 0.0], "c")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").withColumn("key", F.lit("x")).withColumn("number", F.lit(3))
    got = {r.vec_id: (r.n_links, r.component_id, r.label) for r in near_duplicates(table).collect()}
    unit = {i: np.array(v) / np.hypot(*(np.array(v) / max(v))) / max(v) for i, v, _ in rows}
    links = {i: sum(j != i and a == b and a is not None and unit[i] @ unit[j] >= 0.93 for j, _, b in rows) for i, _, a in rows}
    assert {i: g[0] for i, g in got.items()} == links
    assert [got[i][1] for i in range(1, 8)] == [1, 1, 1, 4, 5, 5, 7] and got[5][2] == "b"


def test_embedding_blocks(spark, monkeypatch):
    import latticework.llm.embedding_dedup as e

    rows = embedding_rows(300, 5)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = sorted(map(tuple, near_duplicates(table).collect()))
    monkeypatch.setattr(e, "BLOCK", 16)
    monkeypatch.setattr(e, "FAN", 3)
    assert sorted(map(tuple, near_duplicates(table).collect())) == want


def test_fingerprints_of_edited_texts(spark):
    import hashlib

    rows = fuller(60)
    got = {r.doc_id: r for r in compare_edited(documents(spark, rows=rows)).collect()}
    order = sorted(rows, key=lambda r: r[0])
    import pyarrow as pa

    marks = dict(zip([r[0] for r in order], fingerprints(pa.array([r[1] or "" for r in order]))))
    for a, b in zip(order, order[1:] + order[:1]):
        text, after = a[1] or "", b[1] or ""
        n = len(text)
        changed = text[: n - n // 2] + after[: n // 2]
        assert changed == edited(text, after)
        r = got[a[0]]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == marks[a[0]] and r.edited_fingerprint == fingerprints(pa.array([changed]))[0]
        bits = bin(int(r.fingerprint, 16) ^ int(marks[b[0]], 16)).count("1")
        assert r.near_next == 1 - bits / BITS and 0 <= r.near_edited <= 1
    far = [r for r in got.values() if r.n_chars > 100]
    assert np.mean([r.near_edited for r in far]) > np.mean([r.near_next for r in far]) + 0.05
    one = compare_edited(spark.createDataFrame([(1, "only one text", "en", "a", 13)], SCHEMA)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_block_tables_find_all(spark):
    draw = np.random.default_rng(1)
    marks = [int.from_bytes(draw.bytes(16), "big") for _ in range(40)]
    for m in list(marks):
        for k in range(1, 6):
            x = m
            for bit in draw.choice(128, k, replace=False):
                x ^= 1 << int(bit)
            marks.append(x)
    table = spark.createDataFrame([(f"{m:032x}",) for m in marks] + [(None,)], "fingerprint string")
    asked = table.limit(60)
    for radius, blocks in ((3, 5), (0, 1), (2, 3)):
        got = {(r.query, r.found, r.distance) for r in near_fingerprints(asked, table, radius, blocks).collect()}
        q = [int(r.fingerprint, 16) for r in asked.collect() if r.fingerprint]
        want = {(f"{a:032x}", f"{b:032x}", bin(a ^ b).count("1")) for a in q for b in marks if bin(a ^ b).count("1") <= radius}
        assert got == want


def test_probes_find_all(spark):
    draw = np.random.default_rng(2)
    marks = [0, (1 << 128) - 1, *(int.from_bytes(draw.bytes(16), "big") for _ in range(30))]
    for m in list(marks):
        for k in (1, 3, 6, 12, 16, 17, 18, 20):
            x = m
            for bit in draw.choice(128, k, replace=False):
                x ^= 1 << int(bit)
            marks.append(x)
    table = spark.createDataFrame([(f"{m:032x}",) for m in marks] + [(None,)], "fingerprint string")
    asked = table.limit(80)
    q = [int(r.fingerprint, 16) for r in asked.collect() if r.fingerprint]
    for radius in (17, 5):
        got = sorted((r.query, r.found, r.distance) for r in probed_fingerprints(asked, table, radius).collect())
        assert got == sorted((f"{a:032x}", f"{b:032x}", bin(a ^ b).count("1")) for a in set(q) for b in set(marks) if bin(a ^ b).count("1") <= radius)


def test_near_copies_are_found(spark, tmp_path):
    draw = np.random.default_rng(3)
    bank = ["".join(draw.choice(list("abcdefghij"), draw.integers(2, 10))) for _ in range(3000)]
    rows = []
    for i in range(60):
        words = list(draw.choice(bank, 300))
        near = list(words)
        for at in draw.choice(300, 6, replace=False):  # 5-word Jaccard 0.8 or more
            near[at] = bank[draw.integers(3000)]
        rows += [(50 * i, " ".join(words)), (50 * i + 1, " ".join(near))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = [r.near_found for r in op2_simhash(spark, str(tmp_path)).filter("doc_id % 50 = 0").collect()]
    assert len(found) == 60 and sum(n >= 1 for n in found) >= 54
