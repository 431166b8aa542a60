"""Lexers and hashes that need state: vectorised over Arrow batches, in Python."""

from __future__ import annotations

import functools
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# FNV-1a, 64 bits.
FNV_OFFSET, FNV_PRIME, MASK = 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1
# Words of structure that stay themselves when a body is normalised.
STRUCTURAL = set("if else elif for while do switch case match return break continue try catch except finally throw raise with yield await async new delete in is not and or lambda class struct enum trait interface fn func function def let var const static import from use package".split())

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|\#[^\n]*|/\*.*?\*/|'''.*?'''|\"\"\".*?\"\"\")"""
    r"""|(?P<str>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<num>0[xX][0-9a-fA-F_]+|\d[\d_]*(?:\.\d+)?)|(?P<id>[^\W\d]\w*)|(?P<op>::|->|=>|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|.)""",
    re.S,
)


def fnv1a(data: bytes, h: int = FNV_OFFSET) -> int:
    for b in data:
        h = (h ^ b) * FNV_PRIME & MASK
    return h


def normalise(body: str) -> list[str]:
    """Tokens without comments; literals as STR and NUM, identifiers as ID."""
    out = []
    for m in _TOKEN.finditer(body):
        kind = m.lastgroup
        if kind != "skip":
            word = m[0]
            out.append("STR" if kind == "str" else "NUM" if kind == "num" else word if kind == "op" or word in STRUCTURAL else "ID")
    return out


def token_hash(tokens: list[str]) -> int:
    h = FNV_OFFSET
    for t in tokens:
        h = (fnv1a(t.encode(), h) ^ 0xFF) * FNV_PRIME & MASK
    return h


def simhash(tokens: list[str], k: int = 4) -> int:
    """Sign of the votes of k-token shingles, bit by bit; ties are 0."""
    runs = [tokens[i : i + k] for i in range(len(tokens) - k + 1)] or [tokens]
    marks = np.array([token_hash(run) for run in runs], "<u8")
    up = np.unpackbits(marks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * up > len(runs), bitorder="little").tobytes(), "little")


def strip_noise(body: str) -> str:
    """Comments and the insides of strings blanked, every offset kept."""

    def blank(m: re.Match) -> str:
        text = m[0]
        if m.lastgroup == "skip":
            return re.sub(r"[^\s]", " ", text)
        return text[0] + re.sub(r"[^\n]", " ", text[1:-1]) + text[-1] if m.lastgroup == "str" else text

    return _TOKEN.sub(blank, body)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@functools.lru_cache(maxsize=4096)
def marks_of(tokens: tuple[str, ...]) -> tuple[int, int, int]:
    """Number, fingerprint and SimHash of tokens; bodies alike once normalised are hashed once."""
    return len(tokens), _signed(token_hash(list(tokens))), _signed(simhash(list(tokens)))


@F.pandas_udf(T.StructType([T.StructField("tokens", T.IntegerType()), T.StructField("fingerprint", T.LongType()), T.StructField("simhash", T.LongType())]))
def fingerprint(bodies: pd.Series) -> pd.DataFrame:
    """Token count, exact fingerprint and SimHash of normalised bodies (as signed 64-bit integers)."""
    return pd.DataFrame([marks_of(tuple(normalise(b or ""))) for b in bodies], columns=["tokens", "fingerprint", "simhash"])


@F.pandas_udf(T.StringType())
def without_noise(bodies: pd.Series) -> pd.Series:
    return bodies.map(lambda b: None if b is None else strip_noise(b))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType()), T.StructField("line", T.IntegerType())])))
def literals(bodies: pd.Series) -> pd.Series:
    """String, number and boolean literals with their 1-based lines."""

    def scan(body: str | None) -> list[dict]:
        out, line, at = [], 1, 0
        for m in _TOKEN.finditer(body or ""):
            line, at = line + body.count("\n", at, m.start()), m.start()
            kind = "string" if m.lastgroup == "str" else "number" if m.lastgroup == "num" else "bool" if m[0] in ("true", "false", "True", "False") else None
            if kind:
                out.append({"kind": kind, "value": m[0], "line": line})
        return out

    return bodies.map(scan)
