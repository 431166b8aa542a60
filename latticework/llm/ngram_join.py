"""Jaccard join of documents on word shingles with adaptive multi-match prefixes.

Shingles have one global order, rare ones first: by the number of sets that hold
them, counted over the whole table. Each task keeps its sets in a file of the
shared folder and deals out its distinct shingles by hash; every bucket adds
them up and answers each task, so a shingle travels as four bytes and comes back
as one. A set of n shingles that must share at least r = ceil(t n) with any
partner shares at least l of the first n - r + l with it, for every l. Each set
takes the l whose estimated cost (reading the lists of its prefix, verifying what
they hold) is least, and a pair is verified if it shares as many prefix shingles
as the smaller l of the two. A shingle of one set alone has no list; a set whose
prefix holds only such ones has no partner and goes no further.

Equal sets are one class. A first round verifies each class against a few
centres of every list (as many pairs as list entries, times the centres); what
that connects is one component. Classes of lists that then still hold several
components go, with their sets, into blocks: those that lists connect meet in one
block, or in pairs of blocks where they are many, and are compared inside the
task, which gives out links only. A component that fills blocks of its own is
never compared with itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm import words
from latticework.llm.common import bound_batches, join_keyed, materialize, new_folder, release, shuffle_width
from latticework.llm.components import components
from latticework.llm.files import get, put_at, remove

#: Shingles whose sets one file holds, and that one bucket of counts holds, about.
CHUNK, BUCKET = 1 << 21, 1 << 20
#: Shingles of the sets of a block, about.
BLOCK = 1 << 18
#: Classes of a list that all others are verified against first.
CENTRES = 4
#: Longest multi-match; cost of verifying a candidate, in list entries read, for each shingle.
LONGEST, VERIFY = 4, 0.02
#: Bytes of text for each shingle, about.
SPACING = 6


def _class_key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _slots(tokens: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32-bit place in it of sorted shingles; both follow their order."""
    n, half = np.uint64(buckets), np.uint64(32)
    at = (tokens >> half) * n + ((tokens & np.uint64(0xFFFFFFFF)) * n >> half)
    return (at >> half).astype(np.int64), at.astype(np.uint32)


def _pack(doc_ids: list, keys: list[bytes], sets: list[np.ndarray]) -> bytes:
    """Documents' ids, sizes and class keys, and the distinct sets one after another."""
    first, which, held = {}, np.empty(len(sets), "<i4"), []
    for i, (key, s) in enumerate(zip(keys, sets)):
        if key not in first:
            first[key] = len(held)
            held.append(s)
        which[i] = first[key]
    sizes = np.array([len(s) for s in held], "<i4")
    head = np.array([len(sets), len(held)], "<i8")
    return b"".join([head.tobytes(), np.array(doc_ids, "<i8").tobytes(), which.tobytes(), sizes.tobytes(), b"".join(first), *(s.tobytes() for s in held)])


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Ids, number of each one's set, sizes and keys of the sets, their shingles."""
    n, m = np.frombuffer(data, "<i8", 2)
    at = 16
    ids = np.frombuffer(data, "<i8", n, at)
    which = np.frombuffer(data, "<i4", n, at := at + 8 * n)
    sizes = np.frombuffer(data, "<i4", m, at := at + 4 * n).astype(np.int64)
    at += 4 * m
    keys = [data[at + 16 * i : at + 16 * i + 16] for i in range(m)]
    return ids, which, sizes, keys, np.frombuffer(data, "<u8", -1, at + 16 * m)


def _deal(k: int, buckets: int, folder: str):
    """Write the sets of each run of documents; (chunk, bucket, slots, counts) of its distinct shingles."""
    names = ["chunk", "bucket", "slots", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, ids, keys, sets, size = words.Shingles(k), [], [], [], 0

        def out() -> pa.RecordBatch:
            data = _pack(ids, keys, sets)
            # named by its content: a task that runs again writes the same files
            chunk = xxhash.xxh3_128_hexdigest(data)
            put_at(f"{folder}/{chunk}", data)
            token, count = np.unique(_unpack(data)[4], return_counts=True)
            bucket, slot = _slots(token, buckets)
            edge = np.flatnonzero(np.diff(bucket, prepend=-1))
            cuts = list(zip(edge.tolist(), [*edge[1:].tolist(), len(bucket)])) or [(0, 0)]  # a chunk without shingles is heard of too
            full = bucket[edge] if len(edge) else np.zeros(1, np.int64)
            return pa.RecordBatch.from_arrays([pa.array([chunk] * len(cuts)), pa.array(full), pa.array([words.planes(np.diff(slot[a:b], prepend=np.uint32(0))) for a, b in cuts], pa.binary()), pa.array([words.planes(count[a:b]) for a, b in cuts], pa.binary())], names)

        for batch in batches:
            doc_ids = batch["doc_id"].to_pylist()
            for i, s in enumerate(shingles(batch["text"])):
                ids.append(doc_ids[i])
                sets.append(s)
                keys.append(_class_key(s))
                size += len(s)
                if size >= CHUNK:
                    yield out()
                    ids, keys, sets, size = [], [], [], 0
        if ids:
            yield out()

    return run


def _count(table: pa.Table) -> pa.Table:
    """For each chunk, one byte for each of its shingles of this bucket: 0 if one
    set has it, else 1 + 4 log2 of the number of sets."""
    table = table.combine_chunks()
    slots = [np.cumsum(words.from_planes(x.as_py()), dtype=np.uint32) for x in table["slots"]]
    counts = np.concatenate([words.from_planes(x.as_py()) for x in table["counts"]])
    _, inverse = np.unique(np.concatenate(slots), return_inverse=True)
    total = np.bincount(inverse, counts)
    level = np.where(total > 1, 1 + np.floor(4 * np.log2(np.maximum(total, 1))), 0).astype(np.uint8)[inverse]
    ends = np.cumsum([len(s) for s in slots])
    levels = [level[e - len(s) : e].tobytes() for s, e in zip(slots, ends.tolist())]
    return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "levels": pa.array(levels, pa.binary())})


def prefix(level: np.ndarray, tokens: np.ndarray, threshold: float) -> tuple[np.ndarray, int]:
    """The prefix of a set, as indices in global order, and its l; ``level``: how
    frequent each shingle is (0: in no other set)."""
    n = len(tokens)
    need = math.ceil(threshold * n - 1e-9)
    order = np.lexsort((tokens, level))
    run = np.cumsum(np.where(level[order] > 0, np.exp2((level[order] - 1.0) / 4), 0.0))
    best, cost = 1, None
    for many in range(1, min(LONGEST, need) + 1):
        entries = float(run[min(n, n - need + many) - 1])
        mine = entries + entries / many * VERIFY * n
        if cost is None or mine < cost:
            best, cost = many, mine
    return order[: min(n, n - need + best)], best


_FOUND = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("many", pa.int32()), ("tokens", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("shingles", pa.binary())])
_FOUND_SQL = "doc_id long, n long, key binary, many int, tokens array<long>, places array<int>, shingles binary"


def _prefixes(folder: str, threshold: float):
    """(doc_id, n, key) of each document of a chunk; for each of its sets that may
    have a partner: l, the shingles of its prefix that have a list, their places
    in the set's order, and the set."""

    def run(table: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        ids, which, sizes, keys, flat = _unpack(get(f"{folder}/{chunk}"))
        level = np.frombuffer(b"".join(x.as_py() for x in table.sort_by("bucket")["levels"]), np.uint8)
        token, inverse = np.unique(flat, return_inverse=True)
        if len(token) != len(level):
            raise ValueError("a chunk's counts differ from its shingles: the input must read alike each time")
        level = level[inverse]
        ends = np.cumsum(sizes)
        alone = np.concatenate([[0], np.cumsum(level == 0)])
        need = np.ceil(threshold * sizes - 1e-9).astype(np.int64)
        # with so many shingles of its own, the longest prefix holds no other
        open_ = np.flatnonzero((alone[ends] - alone[ends - sizes] < np.minimum(sizes, sizes - need + LONGEST)) & (sizes > 0))
        rows = []
        for i in open_.tolist():
            a, b = int(ends[i] - sizes[i]), int(ends[i])
            take, many = prefix(level[a:b], flat[a:b], threshold)
            kept = np.flatnonzero(level[a:b][take] > 0)
            if len(kept):
                rows.append((keys[i], b - a, many, flat[a:b][take[kept]].view(np.int64), kept.astype(np.int32), flat[a:b].tobytes()))
        n, m = len(ids), len(rows)
        at = pa.array(np.cumsum([0, *(len(r[3]) for r in rows)]), pa.int32())
        lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate([*(r[c] for r in rows), np.zeros(0, kind)]).astype(kind))) for c, kind in ((3, np.int64), (4, np.int32))]
        members = pa.table([pa.array(ids), pa.array(sizes[which]), pa.array([keys[w] for w in which.tolist()], pa.binary()), *(pa.nulls(n, f.type) for f in list(_FOUND)[3:])], schema=_FOUND)
        classes = pa.table([pa.nulls(m, pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int32()), *lists, pa.array([r[5] for r in rows], pa.binary())], schema=_FOUND)
        return pa.concat_tables([members, classes])

    return run


def _links_if(shared: int, n: int, m: int, percent: int) -> bool:
    return 100 * shared >= percent * (n + m - shared)


def _verify(percent: int):
    """Pairs (a, b) that share as many prefix shingles as the smaller l asks for, and link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            many = np.minimum(batch["x_many"].to_numpy(), batch["y_many"].to_numpy())
            for i in range(len(batch)):
                p, q = (np.asarray(batch[f"{s}_tokens"][i].values) for s in "xy")
                if len(np.intersect1d(p, q, assume_unique=True)) < many[i]:
                    keep.append(False)
                    continue
                x, y = (np.frombuffer(batch[f"{s}_shingles"][i].as_py(), np.uint64) for s in "xy")
                keep.append(_links_if(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _alike(x: Column, y: Column, percent: int) -> Column:
    """Sizes that may link."""
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _reach(x: Column, y: Column, percent: int) -> Column:
    """Whether sets (with fields n, place) that share a shingle at these places of
    the global order can share enough: what comes before it and what comes from
    it on bound the overlap on either side."""
    bound = F.least(x["place"], y["place"]) + F.least(x["n"] - x["place"], y["n"] - y["place"])
    return bound * (100 + percent) >= (x["n"] + y["n"]) * percent


_BLOCK = ["doc", "part", "cluster", "n", "many", "at"]


def _write_block(folder: str):
    """A block's classes in one file of the shared folder."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cluster", "ascending"), ("cid", "ascending")]).combine_chunks()
        columns = [table[c].combine_chunks() if isinstance(table[c], pa.ChunkedArray) else table[c] for c in ("doc", "part", "cluster", "n", "many")]
        head = [np.asarray(c).astype("<i8") for c in columns]
        lists = [np.asarray(x.values).astype("<i8") for x in table["tokens"]]
        head.append(np.array([len(x) for x in lists], "<i8"))
        data = np.array([len(table)], "<i8").tobytes() + b"".join(h.tobytes() for h in head) + b"".join(x.tobytes() for x in lists) + b"".join(x.as_py() for x in table["shingles"])
        path = f"{folder}/{xxhash.xxh3_128_hexdigest(data)}"
        put_at(path, data)
        return pa.table({"bin": table["bin"][:1], "own": table["own"][:1], "path": pa.array([path])})

    return run


def _read_block(path: str) -> dict:
    data = get(path)
    (m,) = np.frombuffer(data, "<i8", 1)
    found = dict(zip(_BLOCK, np.frombuffer(data, "<i8", 6 * m, 8).reshape(6, m)))
    found["part"] = found["part"].copy()
    lengths = found["at"]
    found["at"] = np.concatenate([[0], np.cumsum(lengths)])
    total = int(lengths.sum())
    found["tokens"] = np.frombuffer(data, "<i8", total, 8 + 48 * m)
    found["begin"] = np.concatenate([[0], np.cumsum(found["n"])])
    found["sets"] = np.frombuffer(data, "<u8", -1, 8 + 48 * m + 8 * total)
    return found


def compare_blocks(x: dict, y: dict, percent: int) -> list[tuple[int, int]]:
    """Links (doc, doc) that connect all parts that classes of the two blocks (or
    of one, if ``x`` is ``y``) have links between; pairs that are of one part by
    then are not verified."""
    out = []
    _, code = np.unique(np.concatenate([x["tokens"], y["tokens"]]), return_inverse=True)
    mine, theirs = code[: len(x["tokens"])], code[len(x["tokens"]) :]
    flag = np.zeros(int(code.max()) + 1 if len(code) else 1, np.int64)
    width = np.diff(y["at"]) > 0
    starts = y["at"][:-1][width]
    for i in range(len(x["doc"])):
        n = int(x["n"][i])
        fit = (y["cluster"] == x["cluster"][i]) & (y["part"] != x["part"][i]) & (100 * np.minimum(n, y["n"]) >= percent * np.maximum(n, y["n"]))
        if x is y:
            fit[: i + 1] = False
        if not fit.any():
            continue
        own = mine[x["at"][i] : x["at"][i + 1]]
        flag[own] = 1
        shared = np.zeros(len(fit), np.int64)
        if len(starts):
            shared[width] = np.add.reduceat(flag[theirs], starts)
        flag[own] = 0
        set_i = x["sets"][x["begin"][i] : x["begin"][i + 1]]
        for j in np.flatnonzero(fit & (shared >= np.minimum(x["many"][i], y["many"]))).tolist():
            if x["part"][i] == y["part"][j]:
                continue
            set_j = y["sets"][y["begin"][j] : y["begin"][j + 1]]
            small, large = (set_i, set_j) if len(set_i) <= len(set_j) else (set_j, set_i)
            place = np.searchsorted(large, small)
            place[place == len(large)] = 0
            if _links_if(int((large[place] == small).sum()), len(small), len(large), percent):
                out.append((int(x["doc"][i]), int(y["doc"][j])))
                gone, into = y["part"][j], x["part"][i]
                for block in (x, y):
                    block["part"][block["part"] == gone] = into
    return out


def _compare(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, q in zip(batch["p"].to_pylist(), batch["q"].to_pylist()):
                x = _read_block(p)
                links = compare_blocks(x, x if p == q else _read_block(q), percent)
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])

    return run


def _blocks(entries: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes of different parts that share lists;
    ``entries``: token, cid, part, of the lists that hold several parts."""
    spark = entries.sparkSession
    heads = entries.groupBy("token").agg(F.min("cid").alias("head"))
    roots = components(entries.join(heads, "token").select("cid", "head"))
    within = entries.groupBy("cid").agg(F.min("part").alias("part")).join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    within = within.join(classes.select("cid", "n"), "cid").select("cid", "part", F.coalesce("root", "cid").alias("cluster"), "n")
    within = materialize(within, "within")
    sizes = within.groupBy("cluster", "part").agg(F.sum("n").alias("n")).withColumn("own", F.when(F.col("n") >= BLOCK, F.col("part")))
    rests = sizes.groupBy("cluster").agg(F.sum(F.when(F.col("own").isNull(), F.col("n"))).alias("rest"), F.sum("n").alias("all"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    bins = max(1, -(-total // BLOCK))
    plan = sizes.join(rests, "cluster").select("cluster", "part", "own", F.when(F.col("all") < BLOCK, -1 - F.pmod(F.xxhash64("cluster"), F.lit(bins))).otherwise(F.col("cluster")).alias("bin"), F.ceil(F.when(F.col("own").isNull(), F.col("rest")).otherwise(F.col("n")) / BLOCK).alias("parts"))
    placed = within.join(plan, ["cluster", "part"]).withColumn("block", F.when(F.col("bin") < 0, 0).otherwise(F.pmod(F.xxhash64("cid"), F.col("parts"))))
    placed = placed.select("cid", "part", "cluster", "bin", "own", "block").join(classes.select("cid", "doc", "n", "many", "tokens", "shingles"), "cid")
    manifest = placed.groupBy("bin", "own", "block").applyInArrow(_write_block(new_folder(spark, "blocks")), "bin long, own long, path string")
    manifest = materialize(manifest, "manifest")
    p, q = (manifest.select("bin", F.col("own").alias(f"{s}_own"), F.col("path").alias(s)) for s in "pq")
    # rows of the manifest, one for each BLOCK shingles; blocks of one part alone are not paired
    pairs = p.join(q, "bin").filter("p <= q and not coalesce(p_own = q_own, false)").select("p", "q")
    return materialize(pairs.repartition(shuffle_width(spark), "p", "q").mapInArrow(_compare(percent), "a long, b long"), "links")


def jaccard_components(docs: DataFrame, percent: int = 75, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    The set of a document: distinct ``k``-word shingles of its whole text (A-Z
    lowered, words as runs without ASCII white space), however long; with fewer
    words its whole sequence; without words or with a null text none, and then
    it links with nothing. Documents link when 100 * shared >= ``percent`` *
    together; component_id is the smallest doc_id reachable by links, its own
    included. Rows without an id are left out; rows that repeat an id are linked
    each; an empty table gives an empty result; other columns are not carried.
    Shingles are compared by 64-bit hashes within a pair of sets, whole sets by
    128-bit ones. ``docs`` must give the same rows when read again (files do).
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("doc_id is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    folder, buckets = new_folder(spark, "sets"), min(1 << 31, max(shuffle_width(spark), -(-size // (SPACING * BUCKET))))
    dealt = rows.mapInArrow(_deal(k, buckets, folder), "chunk string, bucket long, slots binary, counts binary")
    levels = dealt.groupBy("bucket").applyInArrow(_count, "chunk string, bucket long, levels binary")
    found = materialize(levels.groupBy("chunk").applyInArrow(_prefixes(folder, percent / 100), _FOUND_SQL), "prefixes")
    # the table is written and holds the sets that go on
    remove(folder)
    release(spark)
    members = found.filter("many is null").select("doc_id", "n", "key")
    firsts = members.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("copies"))
    classes = found.filter("many is not null").drop("doc_id").dropDuplicates(["key"]).join(firsts.drop("copies"), "key")
    # the table is written once, so these numbers hold
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()).drop("key"), "classes")
    release(spark)

    entries = classes.select("cid", "n", "many", F.explode(F.arrays_zip("tokens", "places")).alias("e"))
    entries = entries.select(F.col("e.tokens").alias("token"), "cid", F.struct("cid", "n", F.col("e.places").alias("place")).alias("at"))
    # the class that comes first in each of some orders by hash: lists of like members have like centres
    least = lambda i: F.min(F.struct(F.xxhash64("cid", F.lit(i)).alias("h"), F.col("at")))["at"].alias(f"c{i}")
    heads = entries.groupBy("token").agg(F.count(F.lit(1)).alias("classes"), *[least(i) for i in range(CENTRES)]).filter("classes > 1")
    heads = heads.select("token", F.array_distinct(F.array(*[f"c{i}" for i in range(CENTRES)])).alias("centres"))
    lists = materialize(entries.join(heads, "token"), "lists")
    stars = lists.select("at", F.explode(F.filter("centres", lambda c: (c["cid"] != F.col("at.cid")) & _alike(c["n"], F.col("at.n"), percent) & _reach(c, F.col("at"), percent))).alias("centre"))
    stars = stars.select(F.greatest("at.cid", "centre.cid").alias("x"), F.least("at.cid", "centre.cid").alias("y")).distinct()
    side = lambda s, d: classes.select(F.col("cid").alias(s), F.col("doc").alias(d), *[F.col(c).alias(f"{s}_{c}") for c in ("many", "tokens", "shingles")])
    both = stars.join(side("x", "a"), "x").join(side("y", "b"), "y")
    stars = materialize(both.drop("x", "y").mapInArrow(_verify(percent), "a long, b long"), "links")
    release(spark)
    roots = components(stars)

    part = classes.select("cid", "doc").join(roots.withColumnRenamed("node", "doc"), "doc", "left").select("cid", F.coalesce("root", "doc").alias("part"))
    open_ = materialize(lists.select("token", "cid").join(part, "cid"), "open")
    mixed = open_.groupBy("token").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p < q").select("token")
    rest = _blocks(materialize(open_.join(mixed, "token"), "mixed"), classes, percent)
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(rest))

    class_root = firsts.join(roots.withColumnRenamed("node", "doc"), "doc", "left").select("key", F.coalesce("root", "doc").alias("component_id"), "copies")
    joined = join_keyed(members.filter("n > 0"), materialize(class_root, "roots"), "key", "copies").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return joined.unionAll(members.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op9_ngram_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
