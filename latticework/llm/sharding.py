"""Sharding by minimax contiguous partition (native: DataFrame operations only).

Rows with equal texts form an atomic group. Groups are put in a fixed order
(by digest), and the smallest capacity is searched at which greedy filling
needs no more shards than there are; the order is cut where that filling cuts.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.llm.common import materialize, with_position

#: Groups whose sizes are added up by one task, about.
GROUPS_PER_BUCKET = 8192
#: Capacities that one pass over the sizes tries at once.
PROBES = 8
#: Sizes that the driver may hold for the last steps of the search.
FEW = 100_000


def _prefix_sums(groups: DataFrame) -> tuple[DataFrame, int, int]:
    """(digest, end): the sizes of all groups up to and with this one; total; largest size."""
    n, total, largest = groups.agg(F.count(F.lit(1)), F.sum("bytes"), F.max("bytes")).first()
    bits = min(16, max(0, math.ceil(math.log2(max(1, n) / GROUPS_PER_BUCKET))))
    bucket = F.shiftright(F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("int"), 16 - bits)
    groups = groups.withColumn("bucket", bucket)
    # at most 2**16 buckets: a fixed bound, so one task may add them up
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.groupBy("bucket").agg(F.sum("bytes").alias("all")).select("bucket", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("bucket").orderBy("digest").rowsBetween(Window.unboundedPreceding, 0)
    ends = groups.withColumn("end", F.sum("bytes").over(inside)).join(F.broadcast(starts), "bucket").select("digest", (F.col("end") + F.col("start")).alias("end"))
    return materialize(ends, "prefix"), total or 0, largest or 0


def _greedy(ends: DataFrame, capacities: list[int], shards: int, total: int, largest: int) -> list[list[int]]:
    """For each capacity (none below ``largest``) where greedy filling ends each shard."""
    filled = [[0] for _ in capacities]
    for _ in range(shards):
        probes = [f[-1] + c for f, c in zip(filled, capacities)]
        # the last end at or below a probe is less than one group below it
        near = ends.filter((F.col("end") > min(probes) - largest) & (F.col("end") <= max(probes)))
        row = near.agg(*[F.max(F.when(F.col("end") <= p, F.col("end"))).alias(f"c{i}") for i, p in enumerate(probes)]).first()
        for f, p, end in zip(filled, probes, row):
            f.append(total if p >= total else end)
        if all(f[-1] >= total for f in filled):
            break
    return filled


def _in_reach(low: int, high: int, shards: int, total: int, largest: int) -> Column:
    """Where greedy filling can end a shard at a capacity from ``low`` to ``high``:
    each of the first j shards is less than one group short of its capacity."""
    windows = [(F.col("end") > j * (low - largest)) & (F.col("end") <= j * high) for j in range(1, shards + 1)]
    return (F.col("end") == total) | reduce(lambda x, y: x | y, windows)


def minimax_cuts(ends: DataFrame, shards: int, total: int, largest: int) -> list[int]:
    """Ends of the shards at the smallest capacity that ``shards`` shards can hold.

    The capacity lies between the mean (or the largest group) and one group
    more than the mean. Passes over the sizes narrow that interval until at
    most ``FEW`` ends are in reach of it; the driver halves the rest on those.
    """
    low, high = max(largest, -(-total // shards)), -(-total // shards) + largest
    while low < high and ends.filter(_in_reach(low, high, shards, total, largest)).count() > FEW:
        step = max(1, (high - low) // PROBES)
        tried = list(range(low, high, step))[:PROBES] + [high]
        fits = [f[-1] >= total for f in _greedy(ends, tried, shards, total, largest)]
        first = fits.index(True)
        low, high = tried[first - 1] + 1 if first else low, tried[first]
    if low == high:
        return _greedy(ends, [high], shards, total, largest)[0][1:]
    near = np.sort(ends.filter(_in_reach(low, high, shards, total, largest)).toArrow()["end"].to_numpy())

    def fill(capacity: int) -> list[int]:
        filled = [0]
        while filled[-1] < total and len(filled) <= shards:
            filled.append(int(near[np.searchsorted(near, filled[-1] + capacity, "right") - 1]))
        return filled

    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fill(middle)[-1] >= total else (middle + 1, high)
    return fill(high)[1:]


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text plus 1; a null text has none, counts as the
    group of empty texts, and has the checksum 0. law is ``bytes``: the largest
    shard is as small as whole groups in digest order allow, so a group larger
    than the mean shard has one nearly to itself and shards may stay empty.
    slot: gapless from 0 in each shard, by digest and id; repeated rows each
    have their own. grown_shard is null under this law. An empty table gives an
    empty result. Other columns of ``docs`` are not carried.
    """
    binary = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.length(binary) + 1).cast("long").alias("size"),
        F.crc32(binary).alias("text_crc32"),
        F.unhex(F.sha2(binary, 256)).alias("digest"),
    )
    rows = materialize(rows, "sizes")
    groups = materialize(rows.groupBy("digest").agg(F.sum("size").alias("bytes")), "groups")
    ends, total, largest = _prefix_sums(groups)
    shard: Column = F.lit(0)
    if total:
        cuts = sorted({c for c in minimax_cuts(ends, shards, total, largest) if c < total})
        if cuts:
            firsts = [r[0] for r in ends.filter(F.col("end").isin(cuts)).select("digest").collect()]  # below `shards` rows
            shard = reduce(lambda a, b: a + b, [(F.col("digest") > F.lit(bytes(d))).cast("int") for d in firsts])
    placed = with_position(rows.withColumn("shard", shard.cast("int")), [F.col("shard").asc(), F.col("digest").asc(), F.col("doc_id").asc()], group="shard", name="slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
