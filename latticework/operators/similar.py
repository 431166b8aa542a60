"""Exact and near duplicates of bodies by fingerprint and SimHash."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.operators.traverse import label_components


def exact_groups(marks: DataFrame, least_tokens: int = 8) -> DataFrame:
    """(fingerprint, members, first) of bodies with one fingerprint."""
    big = marks.filter(F.col("tokens") >= least_tokens)
    return big.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("first")).filter("members > 1")


def near_pairs(marks: DataFrame, radius: int = 10) -> DataFrame:
    """(src, dst, distance) of distinct SimHashes within ``radius`` bits.

    Of four blocks of 16 bits, hashes within the radius differ in at most
    ``radius`` // 4 bits of one: each hash asks for every key that near to its own,
    so keys stay 16 bits long and no pair is lost.
    """
    if not 0 <= radius < 16:
        raise ValueError("radius must be from 0 to 15")
    masks = [sum(1 << b for b in bits) for k in range(radius // 4 + 1) for bits in combinations(range(16), k)]
    one = marks.select("simhash").distinct()
    block = lambda c, i: F.shiftrightunsigned(c, 16 * i).bitwiseAND(F.lit(0xFFFF))
    held = one.select("simhash", F.posexplode(F.array(*[block(F.col("simhash"), i) for i in range(4)])).alias("block", "key"))
    asked = held.select(F.col("simhash").alias("other"), "block", F.explode(F.lit(masks)).alias("mask"), "key").withColumn("key", F.col("key").bitwiseXOR(F.col("mask")))
    distance = F.bit_count(F.col("simhash").bitwiseXOR(F.col("other")))
    near = held.join(asked, ["block", "key"]).filter((F.col("simhash") < F.col("other")) & (distance <= radius))
    return near.select(F.col("simhash").alias("src"), F.col("other").alias("dst"), distance.alias("distance")).distinct()


def near_clusters(marks: DataFrame, radius: int = 10) -> DataFrame:
    """(id, cluster) of bodies joined by near pairs or equal hashes; alone: left out."""
    roots = label_components(near_pairs(marks, radius))
    rooted = marks.join(roots.select(F.col("id").alias("simhash"), "root"), "simhash", "left").withColumn("root", F.coalesce("root", "simhash"))
    first = rooted.groupBy("root").agg(F.min("id").alias("cluster"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rooted.join(first, "root").select("id", "cluster")


def cluster_stats(marks: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, members, tokens, similarity): size, upper median of token counts, and
    the least likeness of two bodies of the cluster (of different hashes; else 1)."""
    rows = clusters.join(marks.select("id", "tokens", "simhash"), "id")
    order = Window.partitionBy("cluster").orderBy("tokens", "id")
    middle = rows.withColumn("n", F.row_number().over(order)).withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("cluster")))
    middle = middle.filter(F.col("n") == F.floor(F.col("members") / 2) + 1).select("cluster", "members", "tokens")
    one = rows.select("cluster", "simhash").distinct()
    far = one.alias("a").join(one.alias("b"), (F.col("a.cluster") == F.col("b.cluster")) & (F.col("a.simhash") < F.col("b.simhash")))
    far = far.groupBy(F.col("a.cluster").alias("cluster")).agg(F.max(F.bit_count(F.col("a.simhash").bitwiseXOR(F.col("b.simhash")))).alias("bits"))
    return middle.join(far, "cluster", "left").select("cluster", "members", "tokens", (1 - F.coalesce("bits", F.lit(0)) / 64.0).alias("similarity"))
