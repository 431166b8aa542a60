"""SimHash fingerprints of documents and their search by permuted block tables.

Each distinct word votes with its weight for or against every bit, by its
hash; a bit is set where the votes for it win. A search cuts fingerprints into
blocks: within the radius, at least (blocks - radius) blocks are equal, so a
table for each choice of that many blocks finds every near fingerprint.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.llm import words
from latticework.llm.common import materialize, shuffle_width

#: Bits of a fingerprint; longest word that still gains weight; terms whose votes are counted at once.
BITS, LONGEST, CHUNK = 128, 12, 1 << 14
_SALT = np.uint64(0xA24BAED4963EE407)


def _votes(h: np.ndarray, weight: np.ndarray) -> np.ndarray:
    votes = np.zeros(BITS)
    for a in range(0, len(h), CHUNK):
        part = h[a : a + CHUNK]
        both = np.stack([part, words.mix(part ^ _SALT)], axis=1)
        bits = np.unpackbits(np.ascontiguousarray(both.astype("<u8")).view(np.uint8), axis=1)
        votes += weight[a : a + CHUNK] @ (2.0 * bits - 1.0)  # whole numbers: exact in any order
    return votes


def fingerprints(column: pa.Array) -> list[str]:
    """The fingerprint of each text as 32 hex digits; without words all bits are 0.

    A word (A-Z lowered) weighs round(8 * (1 + ln count)) times the square of
    its length in bytes, counted to 12: long words are rarer and say more.
    """
    out = []
    for _, data, offsets in words.text_slices(column):
        starts, ends = words.bounds(data, offsets)
        h = words.hashes(data, starts, ends, lower=True)
        length = np.minimum(ends - starts, LONGEST).astype(np.float64)
        at = np.searchsorted(starts, offsets)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            term, first, count = np.unique(h[a:b], return_index=True, return_counts=True)
            weight = np.round(8 * (1 + np.log(count))) * length[a:b][first] ** 2
            out.append(np.packbits(_votes(term, weight) > 0).tobytes().hex())
    return out


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits of two fingerprints."""
    return (F.lit(float(BITS)) - _distance(a, b)) / float(BITS)


def _word(x: Column, i: int) -> Column:
    return F.conv(F.substring(x, 1 + 8 * i, 8), 16, 10).cast("long")


def _distance(a: Column, b: Column) -> Column:
    return sum((F.bit_count(_word(a, i).bitwiseXOR(_word(b, i))) for i in range(1, BITS // 32)), F.bit_count(_word(a, 0).bitwiseXOR(_word(b, 0))))


def edited(text: str, after: str) -> str:
    """``text`` with its last half (rounded down) replaced by as many code points of ``after``, or all."""
    n = len(text)
    return text[: n - n // 2] + after[: n // 2]


def _describe(names: list[int], texts: list[str], after: list[str]) -> dict[str, pa.Array]:
    changed = [edited(t, x).encode() for t, x in zip(texts, after)]
    return {
        "doc_id": pa.array(names, pa.int64()),
        "n_chars": pa.array(list(map(len, texts)), pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in changed]),
        "edited_fingerprint": pa.array(fingerprints(pa.array(changed, pa.large_binary()))),
    }


_COLUMNS = ["doc_id", "n_chars", "edited_sha256", "edited_fingerprint", "fingerprint", "next_fingerprint", "part", "edge", "text"]
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, edited_fingerprint string, fingerprint string, next_fingerprint string, part int, edge string, text string"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, each with the next; the first and the last of the partition as edges with their texts."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()

    def edge(kind: str, name: int, text: str, mark: str) -> pa.RecordBatch:
        row = [name, None, None, None, mark, None, part, kind, text]
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 4, pa.int32(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], _COLUMNS)

    held: tuple[int, str, str] | None = None
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for at, data, offsets in words.text_slices(batch.column(1), 1 << 20):
            raw = data.tobytes()
            cuts = offsets.tolist()
            texts = [raw[a:b].decode() for a, b in zip(cuts, cuts[1:])]
            marks = fingerprints(pa.array([raw[a:b] for a, b in zip(cuts, cuts[1:])], pa.large_binary()))
            rows = [*([held] if held else []), *zip(ids[at : at + len(texts)], texts, marks)]
            if not held:
                yield edge("first", *rows[0])
            held = rows.pop()
            if rows:
                nexts = [*rows[1:], held]
                out = _describe([r[0] for r in rows], [r[1] for r in rows], [r[1] for r in nexts])
                n = len(rows)
                out |= {"fingerprint": pa.array([r[2] for r in rows]), "next_fingerprint": pa.array([r[2] for r in nexts]), "part": pa.array([part] * n, pa.int32()), "edge": pa.array([""] * n), "text": pa.nulls(n, pa.string())}
                yield pa.RecordBatch.from_arrays([out[c] for c in _COLUMNS], _COLUMNS)
    if held:
        yield edge("last", *held)


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = _describe(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["next_text"].to_pylist())
        out |= {c: batch[c] for c in ("fingerprint", "next_fingerprint")}
        yield pa.RecordBatch.from_arrays([out[c] for c in _COLUMNS[:6]], _COLUMNS[:6])


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each document and of its edited text, with their likeness
    to each other and to the next document's (in id order; after the last: the first).

    A null text is empty; rows without an id are left out; rows that repeat an
    id follow each other by text; a single document is its own next; an empty
    table gives an empty result; other columns are not carried. Whole texts
    are read, one pass in id order; only the two texts at each partition's
    edges are looked at again.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("doc_id is not null")
    width = shuffle_width(docs.sparkSession)
    # by digest too: rows that repeat one id may span tasks
    rows = rows.withColumn("digest", F.crc32(F.col("text").cast("binary")))
    ordered = rows.repartitionByRange(width, "doc_id", "digest").sortWithinPartitions("doc_id", "digest", F.length("text")).select("doc_id", "text")
    kept = materialize(ordered.mapInArrow(_walk, _SCHEMA), "fingerprints")
    # one row for each partition: which partition with rows comes next
    parts = kept.filter("edge = 'first'").select("part")
    line = Window.orderBy("part")
    parts = parts.select("part", F.coalesce(F.lead("part").over(line), F.first("part").over(line)).alias("next_part"))
    firsts = kept.filter("edge = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    lasts = kept.filter("edge = 'last'").select("doc_id", "text", "fingerprint", "part").join(parts, "part").join(firsts, "next_part")
    closed = lasts.select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint").mapInArrow(_close, _SCHEMA.partition(", part")[0])
    every = kept.filter("edge = ''").select(*_COLUMNS[:6]).unionByName(closed)
    return every.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


def near_fingerprints(queries: DataFrame, corpus: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """(query, found, distance): distinct fingerprints of ``corpus`` within
    ``radius`` bits of each distinct one of ``queries`` (columns ``fingerprint``).

    A table for each choice of ``blocks - radius`` blocks holds all
    fingerprints under those blocks; a pair is returned by the first table
    that has it. Exact: no bucket is capped. Null fingerprints find nothing.
    """
    if not 0 <= radius < blocks:
        raise ValueError("more blocks than the radius are needed")
    edges = [BITS // 4 * i // blocks for i in range(blocks + 1)]
    block = lambda x, i: F.substring(x, edges[i] + 1, edges[i + 1] - edges[i])
    choices = list(combinations(range(blocks), blocks - radius))
    tables = lambda d: d.filter("fingerprint is not null").select("fingerprint").distinct().select("fingerprint", F.posexplode(F.array(*[F.concat(*[block(F.col("fingerprint"), i) for i in c]) for c in choices])).alias("choice", "key"))
    q = tables(queries).withColumnRenamed("fingerprint", "query")
    c = tables(corpus).withColumnRenamed("fingerprint", "found")
    same = [block(F.col("query"), i) == block(F.col("found"), i) for i in range(blocks)]
    # the first choice all of whose blocks are equal is that of the first equal blocks
    first = F.concat(*[F.when(s, F.lit(str(i))).otherwise("") for i, s in enumerate(same)])
    own = F.element_at(F.array(*[F.lit("".join(map(str, c))) for c in choices]), q["choice"] + 1)
    near = q.join(c, (q["key"] == c["key"]) & (q["choice"] == c["choice"]) & (F.substring(first, 1, blocks - radius) == own) & (_distance(F.col("query"), F.col("found")) <= radius))
    return near.select("query", "found", _distance(F.col("query"), F.col("found")).alias("distance"))


#: Bits of the blocks of each half of a fingerprint, the bits of a block that probes flip, and the radius below which that finds all.
PIECES, FLIPS = (21, 21, 22), 2
REACH = 2 * len(PIECES) * (FLIPS + 1) - 1
_CUTS = [(half, sum(PIECES[:i]), n) for half in (0, 1) for i, n in enumerate(PIECES)]


def _keyed(flips: int):
    """Words of each fingerprint under the key of each of its blocks, with up to ``flips`` bits of it changed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                raw = bytes.fromhex("".join(batch.column(0).slice(at, 1000).to_pylist()))
                both = np.frombuffer(raw, ">u8").reshape(-1, 2).astype(np.uint64)
                for i, (half, start, n) in enumerate(_CUTS):
                    masks = np.array([sum(1 << b for b in c) for k in range(flips + 1) for c in combinations(range(n), k)], np.uint64)
                    part = (both[:, half] >> np.uint64(start)) & np.uint64((1 << n) - 1)
                    keys = (part[:, None] ^ masks[None, :]).ravel().astype(np.int64) | (i << max(PIECES))
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(both[:, h], len(masks)).view(np.int64)) for h in (0, 1)), pa.array(keys)], ["high", "low", "key"])

    return run


def probed_fingerprints(queries: DataFrame, corpus: DataFrame, radius: int = REACH) -> DataFrame:
    """``near_fingerprints`` for a wide radius and few queries.

    Of six blocks of two near fingerprints at least one differs in two bits at
    most; fingerprints of ``corpus`` stand under their blocks, and queries ask
    for their blocks with up to two bits flipped. A pair is returned by its
    first such block. Exact: no bucket is capped.
    """
    if not 0 <= radius <= REACH:
        raise ValueError(f"the radius is {REACH} at most")
    tables = lambda d, flips: d.filter("fingerprint is not null").select("fingerprint").distinct().mapInArrow(_keyed(flips), "high long, low long, key long")
    q, c = tables(queries, FLIPS).alias("q"), tables(corpus, 0).alias("c")
    apart = [F.col(f"q.{w}").bitwiseXOR(F.col(f"c.{w}")) for w in ("high", "low")]
    distance = F.bit_count(apart[0]) + F.bit_count(apart[1])
    first = F.coalesce(*[F.when(F.bit_count(F.shiftrightunsigned(apart[half], start).bitwiseAND(F.lit((1 << n) - 1))) <= FLIPS, i) for i, (half, start, n) in enumerate(_CUTS)])
    # sizes behind Arrow are underrated: neither side may be broadcast
    near = q.hint("merge").join(c.hint("merge"), (F.col("q.key") == F.col("c.key")) & (distance <= radius) & (first == F.shiftright("q.key", max(PIECES))))
    text = lambda x: F.lower(F.concat(F.lpad(F.hex(f"{x}.high"), 16, "0"), F.lpad(F.hex(f"{x}.low"), 16, "0")))
    return near.select(text("q").alias("query"), text("c").alias("found"), distance.alias("distance"))


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, and for ids divisible by 50 ``near_found``: other
    documents whose fingerprint is within 17 bits (null for other ids)."""
    docs = materialize(compare_edited(spark.read.parquet(f"{sf_dir}/documents.parquet")), "compared")
    queries = docs.filter("doc_id % 50 = 0").select("fingerprint").distinct()
    sizes = docs.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))
    near = probed_fingerprints(queries, sizes).join(sizes.withColumnRenamed("fingerprint", "found"), "found").groupBy("query").agg((F.sum("n") - 1).alias("near_found"))
    asked = docs.filter("doc_id % 50 = 0").join(near, F.col("fingerprint") == F.col("query"), "left").drop("query")
    return asked.unionByName(docs.filter("doc_id % 50 <> 0").withColumn("near_found", F.lit(None).cast("long")))
