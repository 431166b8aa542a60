"""Vectorised word splitting and hashing over the UTF-8 bytes of many texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text handled at once; a longer text is handled alone.
SLICE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes after a space at which a byte-level pre-tokenizer surely starts a word there:
#: not white space, and not the first byte of any longer white space character.
_STARTS = np.ones(256, bool)
_STARTS[:33] = False
_STARTS[[0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = False

#: Letters, digits, signs, white space of ASCII; 5: bytes that no rule here cuts at.
_KIND = np.full(256, 3, np.uint8)
_KIND[97:123] = _KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[_SPACE] = 0
_KIND[128:] = _KIND[39] = 5

#: Odd multipliers of the hash; a word beyond LONG bytes is hashed alone, by xxh3.
_BASE, _NEXT, _SIZE, LONG = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 64
#: The low n bytes of a lane of eight.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (every output bit depends on every input bit)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def text_slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of at most ``most`` bytes (or one row)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"").cast(pa.large_binary())
    if len(column) == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, whole[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space) of each text."""
    n = len(data)
    space = _SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = ~space
    last = first.copy()
    if n:
        first[1:] &= space[:-1] | edge[1:n]
        last[:-1] &= space[1:] | edge[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of pieces that cover each text and that a byte-level BPE
    encodes independently: cut before a space that a non-space follows."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n > 1:
        cut[: n - 1] = (data[:-1] == 32) & _STARTS[data[1:]]
    cut[offsets] = True
    cut[n] = True
    at = np.flatnonzero(cut)
    return at[:-1], at[1:]


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes (little-endian) from each position on; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def fine(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of letters, digits and signs of ASCII cut into runs of letters, single
    digits and runs of signs: starts, ends, and whether a piece comes of such a
    word. Words with other bytes, an apostrophe or ``<|`` stay whole."""
    n = len(data)
    kind = _KIND[data]
    bad = np.zeros(n + 1, np.int64)
    whole = kind > 3
    if n > 1:
        whole[:-1] |= (data[:-1] == 60) & (data[1:] == 124)
    np.cumsum(whole, out=bad[1:])
    plain = bad[ends] == bad[starts]
    inside = np.zeros(n + 1, np.int8)
    inside[starts[plain]] += 1
    inside[ends[plain]] -= 1
    cut = np.zeros(n + 1, bool)
    if n > 1:
        cut[1:n] = (np.cumsum(inside[:n], dtype=np.int8)[1:] > 0) & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
    cut[starts] = True
    begin = np.flatnonzero(cut[:n])
    word = np.searchsorted(starts, begin, "right") - 1
    end = ends[word]
    same = np.flatnonzero(word[1:] == word[:-1])
    end[same] = begin[same + 1]
    return begin, end, plain[word]


def lowered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``data`` with A-Z as a-z in these (disjoint) ranges."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    return np.where(np.cumsum(inside[: len(data)], dtype=np.int8) > 0, _LOWER[data], data)


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Number of each byte range among the different ones (compared byte by byte), and these."""
    coded = pc.dictionary_encode(cut(data, starts, ends))
    return coded.indices.to_numpy(), coded.dictionary.to_pylist()


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte range; ``lower``: with A-Z as a-z.

    Eight bytes after another are mixed into the state, so no step is linear in
    the text: unlike a polynomial, patterned texts do not meet.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    data = _LOWER[data] if lower else data
    lanes, length = _lanes(data), ends - starts
    h = mix((lanes[starts] & _MASK[np.minimum(length, 8)]) ^ (length.astype(np.uint64) + np.uint64(1)) * np.uint64(_SIZE))
    left = np.flatnonzero((length > 8) & (length <= LONG))
    at = 8
    while len(left):
        lane = lanes[starts[left] + at] & _MASK[np.minimum(length[left] - at, 8)]
        h[left] = mix(h[left] * np.uint64(_NEXT) ^ mix(lane + np.uint64(_BASE)))
        at += 8
        left = left[length[left] > at]
    far = np.flatnonzero(length > LONG)
    if len(far):
        view = memoryview(np.ascontiguousarray(data))
        h[far] = [xxhash.xxh3_64_intdigest(view[a:b], _BASE) for a, b in zip(starts[far].tolist(), ends[far].tolist())]
    return h


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of the ranges (start, length), one range after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges as an Arrow binary array."""
    lengths = (ends - starts).astype(np.int64)
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[spread(starts, lengths)]))])


def planes(x: np.ndarray) -> bytes:
    """Byte planes (low bytes first) of numbers below 2**32, which compress where numbers are small."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


class Shingles:
    """Distinct hashes of k-word shingles of texts: a shingle is k consecutive
    words (A-Z lowered); a text with fewer words has its whole sequence as one,
    a text without words has none."""

    def __init__(self, k: int = 5):
        self.k = k

    def __call__(self, column: pa.Array) -> Iterator[np.ndarray]:
        """A sorted array of distinct uint64 for each row."""
        k = self.k
        for _, data, offsets in text_slices(column):
            starts, ends = bounds(data, offsets)
            h = hashes(data, starts, ends, lower=True)
            n = len(h)
            at = np.searchsorted(starts, offsets)
            rolled = np.zeros(n, np.uint64)
            for j in range(min(k, n)):
                rolled[: n - j] += h[j:] * np.uint64(pow(_BASE, j + 1, 1 << 64))
            rolled = mix(rolled)
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                if b - a >= k:
                    yield np.unique(rolled[a : b - k + 1])
                elif b > a:
                    short = sum(int(x) * pow(_BASE, j + 2, 1 << 64) for j, x in enumerate(h[a:b])) + b - a
                    yield mix(np.array([short % (1 << 64)], np.uint64))
                else:
                    yield np.zeros(0, np.uint64)
