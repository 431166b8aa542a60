"""Byte-level BPE encoding and decoding through a table of distinct words.

Texts are cut into words that the tokenizer encodes independently. A block of
texts keeps each text as numbers of the block's distinct words. The words go,
packed by hash, to the task that holds their part of the table of distinct
words, where each is encoded once however many blocks have it; its ids go back
to those blocks and are joined to the positions. Decoding joins every id with
the table of pieces, which is as large as the vocabulary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm import words
from latticework.llm.common import shuffle_width
from latticework.llm.token_binary import encode_words, tokenizer

#: Bytes of text in a block, about (a longer text is a block of its own).
BLOCK_BYTES = 8 << 20
#: Bytes of text for each part of the table of distinct words.
BUCKET_BYTES = 32 << 20
#: Words whose ids are gathered at once; bytes of ids decoded at once.
GATHER, DECODE = 1 << 18, 1 << 18


_SHAPE = pa.schema([("words", pa.bool_()), ("key", pa.int64()), ("block", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_SHAPE_SQL = "words boolean, key long, block long, a binary, b binary, c binary"


def _pack(x: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x if isinstance(x, bytes) else x.tobytes())


def _unpack(x: pa.Scalar | bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x if isinstance(x, bytes) else x.as_py())


class _Block:
    """Texts as numbers of their distinct words (told by their bytes)."""

    def __init__(self):
        self.names, self.valid, self.parts, self.counts, self.held = [], [], [], [], 0
        self.number: dict[bytes, int] = {}

    def add(self, names: np.ndarray, valid: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
        starts, ends = words.pieces(data, offsets)
        which, found = words.distinct(data, starts, ends)
        number = self.number
        mine = np.fromiter((number.setdefault(w, len(number)) for w in found), np.int64, len(found))
        self.parts.append(mine[which])
        self.counts.append(np.diff(np.searchsorted(starts, offsets)))
        self.names.append(names)
        self.valid.append(valid)
        self.held += len(data)

    def rows(self, buckets: int) -> pa.RecordBatch:
        """One row with the texts, and one for each bucket with the words of that bucket."""
        numbers, n = np.concatenate(self.parts), len(self.number)
        rank = np.argsort(-np.bincount(numbers, minlength=n), kind="stable")  # common words get small numbers
        new = np.empty(n, np.int64)
        new[rank] = np.arange(n)
        size = np.fromiter(map(len, self.number), np.int64, n)
        data = np.frombuffer(b"".join(self.number), np.uint8)
        starts = np.cumsum(size) - size
        texts = [np.concatenate(self.names).tobytes() + np.concatenate(self.valid).tobytes(), np.concatenate(self.counts).astype("<u4").tobytes(), words.planes(new[numbers])]
        block = int.from_bytes(hashlib.blake2b(b"".join([*texts, size.tobytes(), data.tobytes()]), digest_size=8).digest(), "little", signed=True)
        out = [(False, block, block, *map(_pack, texts))]
        bucket = (words.hashes(data, starts, starts + size) % np.uint64(buckets)).astype(np.int64)
        by = np.lexsort((new, bucket))
        edges = np.flatnonzero(np.concatenate([[True], np.diff(bucket[by]) != 0, [True]])) if n else np.zeros(0, np.int64)
        for a, b in zip(edges.tolist(), edges[1:].tolist()):
            part = by[a:b]
            steps = np.diff(new[part], prepend=0)
            out.append((True, int(bucket[part[0]]), block, _pack(data[words.spread(starts[part], size[part])]), _pack(words.planes(size[part])), _pack(words.planes(steps))))
        return pa.RecordBatch.from_pylist([dict(zip(_SHAPE.names, r)) for r in out], _SHAPE)


def _blocks(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for batch in batches:
            valid = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            names = batch.column(0).fill_null(0).to_numpy()
            for at, data, offsets in words.text_slices(batch.column(1), 2 << 20):
                to = at + len(offsets) - 1
                block.add(names[at:to], valid[at:to], data, offsets)
                if block.held >= BLOCK_BYTES:
                    yield block.rows(buckets)
                    block = _Block()
        if block.names:
            yield block.rows(buckets)

    return run


def _encode_bucket(path: str):
    """One part of the table of distinct words: encode each, and answer every block."""

    def run(table: pa.Table) -> pa.Table:
        if not table["words"][0].as_py():
            return pa.schema([("key", pa.int64()), ("numbers", pa.binary()), ("lengths", pa.binary()), ("ids", pa.binary())]).empty_table()
        texts = [np.frombuffer(_unpack(x), np.uint8) for x in table["a"]]
        sizes = [words.from_planes(_unpack(x)).astype(np.int64) for x in table["b"]]
        data, size = np.concatenate(texts), np.concatenate(sizes)
        ends = np.cumsum(size)
        starts = ends - size
        inverse, found = words.distinct(data, starts, ends)
        flat, lengths = encode_words(path, [w.decode() for w in found])
        begins, at, out = np.cumsum(lengths) - lengths, 0, []
        for row in range(len(table)):
            mine = inverse[at : at + len(sizes[row])]
            at += len(mine)
            out.append({"key": table["block"][row].as_py(), "numbers": table["c"][row].as_py(), "lengths": _pack(words.planes(lengths[mine])), "ids": _pack(words.planes(flat[words.spread(begins[mine], lengths[mine])]))})
        return pa.Table.from_pylist(out, pa.schema([("key", pa.int64()), ("numbers", pa.binary()), ("lengths", pa.binary()), ("ids", pa.binary())]))

    return run


_CODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _rebuild(path: str, decode: bool):
    """Each text's ids, from its block's numbers and the ids of the block's words."""
    schema = _CODED.append(pa.field("decoded", pa.string())) if decode else _CODED

    def some(names: pa.Array, counts: np.ndarray, at: np.ndarray, starts: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> pa.Table:
        size = lengths[at]
        ids = flat[words.spread(starts[at], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum(counts)]
        begin = np.concatenate([[0], ends[:-1]])
        columns = [names, pa.array(ends - begin), words.cut(ids.view(np.uint8), 4 * begin, 4 * ends)]
        return pa.table([*columns, _decoded(columns[2], path)] if decode else columns, schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = left.filter(pa.compute.invert(left["words"]))
        if not len(texts):
            return schema.empty_table()
        numbers = np.concatenate([np.cumsum(words.from_planes(_unpack(x)).astype(np.int64)) for x in right["numbers"]] or [np.zeros(0, np.int64)])
        size = np.concatenate([words.from_planes(_unpack(x)).astype(np.int64) for x in right["lengths"]] or [np.zeros(0, np.int64)])
        flat = np.concatenate([words.from_planes(_unpack(x)) for x in right["ids"]] or [np.zeros(0, "<u4")])
        starts, lengths = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
        starts[numbers], lengths[numbers] = np.cumsum(size) - size, size
        out = []
        for row in range(len(texts)):
            raw = _unpack(texts["a"][row])
            n = len(raw) // 9
            names = pa.array(np.frombuffer(raw, np.int64, n), mask=~np.frombuffer(raw, bool, n, 8 * n))
            counts = np.frombuffer(_unpack(texts["b"][row]), "<u4").astype(np.int64)
            at = words.from_planes(_unpack(texts["c"][row]))
            if len(at) and at.max() >= len(lengths):
                raise ValueError("a block lacks ids of its words: its input must read alike each time")
            ends = np.cumsum(counts)
            a = 0
            while a < len(names):
                first = int(ends[a] - counts[a])
                b = max(a + 1, int(np.searchsorted(ends, first + GATHER, "right")))
                out.append(some(names[a:b], counts[a:b], at[first : ends[b - 1]], starts, lengths, flat))
                a = b
        return pa.concat_tables(out)

    return run


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False, keep_unnamed: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids) of each document: ids as little-endian unsigned
    32-bit integers, equal to those of the library on the whole text (without
    added special tokens, truncation and padding). ``decode``: also the text of
    these ids, as ``decode_documents`` gives it, in the same pass.

    A null text is empty and has no ids; rows without an id are left out, or with
    ``keep_unnamed`` have a null one;
    repeated rows are encoded each; an empty table gives an empty result; other
    columns are not carried. ``docs`` must give the same rows when read again
    (files do), since lost tasks are run anew.
    """
    width = shuffle_width(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows if keep_unnamed else rows.filter("doc_id is not null")
    # as many parts of the table as keep each one's words, from all blocks, about as small as a block
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4 * width, -(-size // BUCKET_BYTES))
    # one exchange serves both: texts by block and words by bucket
    dealt = rows.mapInArrow(_blocks(buckets), _SHAPE_SQL).repartition(width, "key")
    coded = dealt.groupBy("key").applyInArrow(_encode_bucket(tokenizer_path), "key long, numbers binary, lengths binary, ids binary")
    return dealt.groupBy("key").cogroup(coded.groupBy("key")).applyInArrow(_rebuild(tokenizer_path, decode), "doc_id long, n_tokens long, ids binary" + ", decoded string" * decode)


@lru_cache(maxsize=4)
def piece_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all pieces in id order, and where each starts: a table as large as the vocabulary."""
    tok = tokenizer(path)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    pieces = []
    for i in range(tok.get_vocab_size(with_added_tokens=True)):
        token = tok.id_to_token(i) or ""
        pieces.append(bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode())
    return np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([0, *map(len, pieces)])


def _decoded(column: pa.Array, path: str) -> pa.Array:
    """The texts of ids: each id joined with its piece's bytes."""
    data, begins = piece_table(path)
    out: list[pa.Array] = []
    for _, raw, offsets in words.text_slices(column, DECODE):
        ids = raw.view("<u4") if len(raw) else np.zeros(0, "<u4")
        size = begins[ids + 1] - begins[ids]
        cuts = np.concatenate([[0], np.cumsum(size)])[offsets // 4]
        text = words.cut(data[words.spread(begins[ids], size)], cuts[:-1], cuts[1:])
        try:
            out.append(text.cast(pa.string()))
        except pa.ArrowInvalid:  # ids that were not made from a text
            out.append(pa.array([x.decode("utf-8", "replace") for x in text.to_pylist()], pa.string()))
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _decoded(batch["ids"], path)], [*batch.schema.names, "decoded"])

    return run


def decode_documents(coded: DataFrame, tokenizer_path: str) -> DataFrame:
    """``coded`` (doc_id, n_tokens, ids) with the text of its ids, ``decoded``,
    special tokens kept; no ids give the empty text."""
    return coded.select("doc_id", "n_tokens", "ids").mapInArrow(_decode(tokenizer_path), "doc_id long, n_tokens long, ids binary, decoded string")


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    both = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, decode=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
