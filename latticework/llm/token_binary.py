"""Token ids as directly addressable codes in binary files.

Each id is split into chunks of ``bits`` bits. Level 0 holds the low chunk of
every id, level k the k-th chunk of those ids that need it; a bitmap at each
level says which ids go on, and a rank directory over the bitmap finds an id's
place at the next level, so any id is read without decoding a block.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.llm import words
from latticework.llm.common import materialize, new_folder, shuffle_width
from latticework.llm.files import get, put

MAGIC = b"LWDAC001"
#: Bits of a chunk; bits of the bitmap that one rank entry covers; ids of a file, about.
BITS, RANK, FILE_IDS = 8, 512, 1 << 22
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def encode(ids: np.ndarray, bits: int = BITS) -> bytes:
    """The file's bytes for ids below 2**32: a header, then for each level its
    length, chunks, bitmap (little bit order) and rank directory."""
    rest = np.asarray(ids).astype(np.uint32)
    kind = np.uint8 if bits <= 8 else np.uint16
    levels = []
    while True:
        more = (rest >> np.uint32(bits)) > 0
        bitmap = np.packbits(more, bitorder="little")
        counts = _ONES[bitmap].astype(np.uint64)
        blocks = np.add.reduceat(counts, np.arange(0, len(counts), RANK // 8)) if len(counts) else np.zeros(0, np.uint64)
        ranks = np.concatenate([[0], np.cumsum(blocks)[:-1]]).astype("<u4") if len(blocks) else np.zeros(0, "<u4")
        chunks = (rest & np.uint32((1 << bits) - 1)).astype(kind)
        levels.append(struct.pack("<Q", len(rest)) + chunks.tobytes() + bitmap.tobytes() + ranks.tobytes())
        rest = rest[more] >> np.uint32(bits)
        if not len(rest):
            break
    return MAGIC + struct.pack("<BBH", bits, len(levels), RANK) + b"".join(levels)


class Codes:
    """Ids of a file by position: ``codes[i]``, ``codes.slice(a, b)``, ``len(codes)``."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        self.bits, n, self.rank = struct.unpack_from("<BBH", data, 8)
        kind, at, self.levels = np.dtype(np.uint8 if self.bits <= 8 else "<u2"), 12, []
        for _ in range(n):
            (count,) = struct.unpack_from("<Q", data, at)
            at += 8
            chunks = np.frombuffer(data, kind, count, at)
            at += count * kind.itemsize
            bitmap = np.frombuffer(data, np.uint8, -(-count // 8), at)
            at += len(bitmap)
            ranks = np.frombuffer(data, "<u4", -(-count // self.rank), at)
            at += 4 * len(ranks)
            self.levels.append((chunks, bitmap, ranks))
        if at != len(data):
            raise ValueError("the file's length differs from its header")

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value, shift = 0, 0
        for chunks, bitmap, ranks in self.levels:
            value |= int(chunks[i]) << shift
            byte, bit = i >> 3, i & 7
            if not bitmap[byte] >> bit & 1:
                break
            first = i // self.rank * (self.rank // 8)
            i = int(ranks[i // self.rank]) + int(_ONES[bitmap[first:byte]].sum()) + int(_ONES[bitmap[byte] & (1 << bit) - 1])
            shift += self.bits
        return value

    def _rank(self, level: int, i: int) -> int:
        """Ids before ``i`` at ``level`` that go on to the next."""
        _, bitmap, ranks = self.levels[level]
        if i >= len(self.levels[level][0]):
            return len(self.levels[level + 1][0]) if level + 1 < len(self.levels) else 0
        byte, first = i >> 3, i // self.rank * (self.rank // 8)
        return int(ranks[i // self.rank]) + int(_ONES[bitmap[first:byte]].sum()) + int(_ONES[bitmap[byte] & (1 << (i & 7)) - 1])

    def slice(self, a: int, b: int) -> np.ndarray:
        """Ids a to b (excluded) as uint32, read from those positions alone."""
        out = np.zeros(b - a, np.uint32)
        where = np.arange(b - a)
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            if a >= b:
                break
            out[where] |= chunks[a:b].astype(np.uint32) << np.uint32(k * self.bits)
            more = np.unpackbits(bitmap[a >> 3 : -(-b // 8)], bitorder="little")[a & 7 : (a & 7) + b - a].astype(bool)
            a, b = self._rank(k, a), self._rank(k, b)
            where = where[more]
        return out


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a file, without truncation and padding; one thread."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


#: Fixed value: how a pre-tokenizer says that it cuts before digits, signs and the endings of these.
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


@lru_cache(maxsize=4)
def traits(path: str) -> tuple[bool, str | None, tuple[str, ...]]:
    """Whether the tokenizer lowers letters and cuts words as ``words.fine`` does; a
    special token that stands between words without touching them; all added tokens."""
    said = json.loads(tokenizer(path).to_str())
    steps = lambda part, name: (part or {}).get(name) or ([part] if part else [])
    lowers = any(x["type"] == "Lowercase" for x in steps(said["normalizer"], "normalizers"))
    cuts = any(x["type"] == "Split" and x["pattern"] == {"Regex": _SPLIT} and x["behavior"] == "Removed" and x["invert"] for x in steps(said["pre_tokenizer"], "pretokenizers"))
    added = said["added_tokens"]
    between = [x["content"] for x in added if x["special"] and not (x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"])]
    return lowers and cuts, between[0] if between else None, tuple(x["content"] for x in added)


#: Words that the library encodes at once; its result for each takes much memory.
AT_ONCE = 4096


def encode_words(path: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and how many each has.

    Texts are joined by a special token, which the library takes out before all
    else, so that one call encodes many; those that hold an added token go alone.
    """
    tok, (_, between, added) = tokenizer(path), traits(path)
    ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for a in range(0, len(texts), AT_ONCE):
        part = texts[a : a + AT_ONCE]
        joined = between.join(part) if between else ""
        if not between or any((joined.count(x) > len(part) - 1) if x == between else (x in joined) for x in added):
            for t in part:
                ids.append(np.array(tok.encode_batch_fast([t], add_special_tokens=False)[0].ids, np.uint32))
                lengths.append(np.array([len(ids[-1])]))
            continue
        flat = np.array(tok.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
        cuts = flat == tok.token_to_id(between)
        lengths.append(np.diff(np.concatenate([[-1], np.flatnonzero(cuts), [len(flat)]])) - 1)
        ids.append(flat[~cuts])
    return np.concatenate(ids), np.concatenate(lengths)


class WordEncoder:
    """Ids of words; each different word (told by its bytes) is encoded when it first comes.

    Holds at most ``most`` words and then starts anew.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        self.path, self.most, self.fine = path, most, traits(path)[0]
        self._clear()

    def _clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    @staticmethod
    def _room(x: np.ndarray, n: int) -> np.ndarray:
        return x if n <= len(x) else np.concatenate([x, np.zeros(max(n - len(x), len(x)), x.dtype)])

    def _learn(self, new: list[bytes]) -> None:
        ids, lengths = encode_words(self.path, [w.decode() for w in new])
        n = len(self.number)
        self.ids = self._room(self.ids, self.used + len(ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts, self.lengths = self._room(self.starts, n + len(new)), self._room(self.lengths, n + len(new))
        self.starts[n : n + len(new)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[n : n + len(new)] = lengths
        self.used += len(ids)
        self.number.update(zip(new, range(n, n + len(new))))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's ids start (one more entry at the end)."""
        starts, ends = words.bounds(data, offsets)
        if self.fine:
            starts, ends, plain = words.fine(data, starts, ends)
            data = words.lowered(data, starts[plain], ends[plain])
        which, found = words.distinct(data, starts, ends)
        new = [w for w in found if w not in self.number]
        if len(self.number) + len(new) > self.most:
            self._clear()
            new = found
        if new:
            self._learn(new)
        entry = np.fromiter(map(self.number.__getitem__, found), np.int64, len(found))[which]
        lengths = self.lengths[entry]
        ids = self.ids[words.spread(self.starts[entry], lengths)]
        run = np.concatenate([[0], np.cumsum(lengths)])
        return ids, run[np.searchsorted(starts, offsets)]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One for all tasks of a worker."""
    return WordEncoder(path)


def _write(path: str, end_id: int, folder: str, file_ids: int):
    """Encode texts and write files as they fill; one manifest row for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, ids, docs, lengths, held, seq = word_encoder(path), [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            whole, n = np.concatenate(ids), np.concatenate(lengths)
            names = np.concatenate(docs)
            index = pa.py_buffer(names.tobytes()), pa.py_buffer(n.astype(np.int64).tobytes())
            body = encode(whole)
            # documents' ids and lengths follow the codes; the last 16 bytes say how many and where
            tail = index[0].to_pybytes() + index[1].to_pybytes() + struct.pack("<QQ", len(names), len(body))
            address = put(folder, f"tokens-{seq:05d}", body + tail)
            return pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([seq]), pa.array([address]), pa.array([len(names)]), pa.array([len(whole)])], ["part", "seq", "path", "docs", "ids"])

        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for batch in batches:
            names = batch.column(0).to_numpy(zero_copy_only=False)
            for at, data, offsets in words.text_slices(batch.column(1), 2 << 20):
                got, run_at = encoder(data, offsets)
                full = np.insert(got, run_at[1:], np.uint32(end_id))
                ends = np.concatenate([[0], np.cumsum(np.diff(run_at) + 1)])
                a, n = 0, len(offsets) - 1
                while a < n:
                    # up to the document with which the file is full
                    b = min(n, int(np.searchsorted(ends, ends[a] + file_ids - held)))
                    b = max(b, a + 1)
                    ids.append(full[ends[a] : ends[b]])
                    docs.append(names[at + a : at + b].astype(np.int64))
                    lengths.append(np.diff(ends[a : b + 1]))
                    held += int(ends[b] - ends[a])
                    a = b
                    if held >= file_ids:
                        yield flush()
                        ids, docs, lengths, held, seq = [], [], [], 0, seq + 1
        if held:
            yield flush()

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Encode all texts, append ``end_id`` to each, and write files in ascending id order.

    Returns the manifest: part, seq (files are in that order), path, docs, ids,
    start (ids of all files before). A null text is empty and has the end id
    alone; rows without an id are not written; repeated ids stand side by side.
    A file holds whole documents, ``file_ids`` ids or more. The files survive
    their tasks in the shared folder; only files of the manifest count.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("doc_id is not null")
    # ties by the text's digest: reruns write equal files, and a repeated id may span tasks
    rows = rows.withColumn("digest", F.crc32(F.col("text").cast("binary")))
    ordered = rows.repartitionByRange(2 * shuffle_width(spark), "doc_id", "digest").sortWithinPartitions("doc_id", "digest").select("doc_id", "text")
    files = materialize(ordered.mapInArrow(_write(tokenizer_path, end_id, new_folder(spark, "tokens"), file_ids), "part int, seq long, path string, docs long, ids long"), "manifest")
    earlier = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = files.groupBy("part").agg(F.sum("ids").alias("ids")).select("part", earlier(Window.orderBy("part")).alias("first"))
    # one row for each task of the write
    return files.join(F.broadcast(parts), "part").withColumn("start", F.col("first") + earlier(Window.partitionBy("part").orderBy("seq"))).drop("first")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = get(path)
            n, body = struct.unpack("<QQ", data[-16:])
            names = np.frombuffer(data, np.int64, n, body)
            lengths = np.frombuffer(data, np.int64, n, body + 8 * n)
            codes = Codes(data[:body])
            if lengths.sum() != len(codes) or len(data) != body + 16 * n + 16:
                raise ValueError(f"{path} is damaged")
            ends = np.cumsum(lengths)
            for a in range(0, n, 4096):
                b = min(n, a + 4096)
                first = int(ends[a] - lengths[a])
                raw = codes.slice(first, int(ends[b - 1])).astype("<u4").tobytes()
                cuts = [4 * (int(e) - first) for e in ends[a:b]]
                sums = [zlib.crc32(raw[x:y]) for x, y in zip([0, *cuts], cuts)]
                yield pa.RecordBatch.from_arrays([pa.array(names[a:b]), pa.array(start + ends[a:b] - lengths[a:b]), pa.array(lengths[a:b]), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""
    width = shuffle_width(manifest.sparkSession)
    return manifest.select("path", "start").repartition(width, "path").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_binary(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_tokens(write_tokens(docs, public_tokenizers.path("word_bpe_49k.json")))
