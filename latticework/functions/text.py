"""Tokenisers and BM25, JVM-side."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.functions.exprs import ascii_lower
from latticework.functions.tables import keep

#: Ranges of ideographs, kana and hangul that are cut into bigrams.
CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{AC00}-\x{D7AF}"
#: Tokens of a query that count.
MOST_QUERY_TOKENS = 24


def split_identifier(ident: Column) -> Column:
    """Parts of an identifier: cut at ``_ - .`` and before an upper-case letter
    that follows a lower-case one; A-Z lowered; parts of one byte dropped."""
    spaced = F.regexp_replace(ident, r"(?<=\p{Ll})(?=\p{Lu})|[_\-.]", "\u0001")
    return F.filter(F.split(ascii_lower(spaced), "\u0001"), lambda p: F.octet_length(p) >= 2)


def compact_segments(ident: Column) -> Column:
    """Dot-separated segments with only letters, digits and ``_``, A-Z lowered."""
    return F.filter(F.transform(F.split(ident, r"\."), lambda s: ascii_lower(F.regexp_replace(s, r"[^\p{L}\p{N}_]", ""))), lambda s: s != "")


def _bigrams(run: Column) -> Column:
    n = F.char_length(run)
    return F.when(n < 2, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: run.substr(i, F.lit(2))))


def tokenise_keywords(raw: Column) -> Column:
    """Query tokens in order, each once: ASCII runs whole, other runs as
    overlapping bigrams; of at least two bytes."""
    runs = F.regexp_extract_all(ascii_lower(raw), F.lit(r"[a-z0-9_]+|[\p{L}\p{N}&&[^\x00-\x7F]]+"), F.lit(0))
    parts = F.flatten(F.transform(runs, lambda r: F.when(r.rlike("^[a-z0-9_]"), F.array(r)).otherwise(_bigrams(r))))
    return F.array_distinct(F.filter(parts, lambda p: F.octet_length(p) >= 2))


def tokenise_code(raw: Column) -> Column:
    """Query tokens of a piece of code, each once: what its string literals say,
    identifiers and their parts, segments of paths; of at least two bytes."""
    quoted = F.regexp_extract_all(raw, F.lit("\"([^\"]*)\"|'([^']*)'"), F.lit(0))
    said = F.flatten(F.transform(quoted, lambda q: tokenise_keywords(q)))
    idents = F.regexp_extract_all(raw, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    named = F.flatten(F.transform(idents, lambda i: F.concat(F.array(ascii_lower(i)), split_identifier(i))))
    paths = F.filter(F.split(raw, r"\s+"), lambda w: F.contains(w, F.lit("/")))
    steps = F.flatten(F.transform(paths, lambda p: F.transform(F.split(p, "/"), lambda s: ascii_lower(F.regexp_replace(s, r"[^\p{L}\p{N}_.]", "")))))
    return F.array_distinct(F.filter(F.concat(said, named, steps), lambda t: F.octet_length(t) >= 2))


#: A part of an ASCII identifier: no upper-case letter follows a lower-case one in it. All
#: repeats are possessive, so that a long one takes no stack.
_PART = r"(?=[A-Za-z0-9])[A-Z0-9]*+(?:[a-z]++[0-9]++[A-Z0-9]*+)*+[a-z]*+"


def fts_tokens(body: Column) -> Column:
    """Index tokens: ASCII identifiers split into parts, CJK runs as bigrams
    (one alone stays); every other character separates."""
    parts = F.filter(F.regexp_extract_all(body, F.lit(rf"{_PART}|[{CJK}]++"), F.lit(0)), lambda p: F.octet_length(p) >= 2)
    # one call lowers them all
    low = F.when(F.size(parts) > 0, F.split(F.lower(F.array_join(parts, " ")), " ", -1)).when(parts.isNotNull(), F.array().cast("array<string>"))
    pairs = F.flatten(F.transform(low, lambda r: F.when(r.rlike("^[a-z0-9]"), F.array(r)).otherwise(_bigrams(r))))
    return F.when(body.rlike(f"[{CJK}]"), pairs).otherwise(low)


def query_tokens(raw: Column) -> Column:
    return F.slice(F.array_distinct(fts_tokens(raw)), 1, MOST_QUERY_TOKENS)


#: Parts of a stored index, by a token's hash.
PARTS = 32


def part_of(token: Column) -> Column:
    return F.pmod(F.crc32(token), F.lit(PARTS)).cast("int")


def postings(bodies: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """(id, token, tf, length, head, part) of every body; one posting of a body is its
    head. Stored partitioned by ``part``, a query reads the parts of its tokens alone."""
    tokens = bodies.select(F.col(id_col).alias("id"), fts_tokens(F.col(body_col)).alias("tokens"))
    long = tokens.select("id", F.size("tokens").alias("length"), F.posexplode("tokens").alias("at", "token"))
    counted = long.groupBy("id", "length", "token").agg(F.count(F.lit(1)).alias("tf"), (F.min("at") == 0).alias("head"))
    return counted.select("id", "token", "tf", "length", "head", part_of(F.col("token")).alias("part"))


def asked(bodies: DataFrame, id_col: str, body_col: str, tokens: list[str]) -> tuple[DataFrame, int, float]:
    """Postings of some tokens alone, the number of bodies and their mean length, from
    one reading of the bodies: no token but these becomes a row."""
    count = lambda t: F.size("tokens") - F.size(F.array_remove("tokens", t))
    one = bodies.select(F.col(id_col).alias("id"), fts_tokens(F.col(body_col)).alias("tokens")).filter(F.size("tokens") > 0)
    one = one.select("id", F.size("tokens").alias("length"), *[count(t).alias(f"n{i}") for i, t in enumerate(tokens)])
    held = keep(one.groupBy("id").agg(*[F.sum(c).alias(c) for c in one.columns[1:]]), "asked")
    n, total = held.agg(F.count(F.lit(1)), F.sum("length")).first()
    every = F.array(*[F.struct(F.lit(t).alias("token"), F.col(f"n{i}").alias("tf")) for i, t in enumerate(tokens)])
    found = held.select("id", "length", F.inline(every)).filter("tf > 0")
    return found.withColumn("part", part_of(F.col("token"))), n, (total / n if n else 1.0)


def sizes(index: DataFrame) -> tuple[int, float]:
    """Bodies of an index and their mean length, from counts that add up."""
    n, total = index.agg(F.count_if("head"), F.sum("tf")).first()
    return n, (total / n if n else 1.0)


def hits(index: DataFrame, tokens: list[str]) -> DataFrame:
    """The postings of some tokens."""
    parts = sorted({zlib.crc32(t.encode()) % PARTS for t in tokens})
    return index.filter(F.col("part").isin(parts) & F.col("token").isin(tokens))


def bm25(index: DataFrame, documents: int, mean_length: float, tokens: list[str], match_all: bool, limit: int | None = 256, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score, matched) of the best bodies by BM25, higher first, then id.

    ``index``: postings. Only the query's postings are read and grouped.
    """
    hit = hits(index, tokens)
    df = hit.groupBy("token").agg(F.count(F.lit(1)).alias("df"))  # as many rows as the query has tokens
    idf = F.log((F.lit(float(documents)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(float(mean_length))))
    scored = hit.join(F.broadcast(df), "token").groupBy("id").agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("matched"))
    if match_all:
        scored = scored.filter(F.col("matched") == len(set(tokens)))
    return scored.orderBy(F.col("score").desc(), "id").limit(limit) if limit else scored
