"""Mixing sources to target weights by capped water-filling.

The budget is shared by weight; a source stops at ``max_epochs`` times its own
size and what it leaves is shared again among the rest, until nothing is above
its cap. Each document is then taken a whole number of times, and a seeded
shuffle of the source decides which documents are taken once more.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.llm.common import WORD, materialize, with_position

#: Rows of a source whose sizes one task adds up, about.
ROWS_PER_BUCKET = 4096


def water_fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """Add ``target`` to sources (with ``weight`` > 0 and ``source_size``)."""
    cap, share = F.col("source_size") * F.lit(float(max_epochs)), F.col("weight")
    level, capped = 0.0, -1
    while True:
        above = cap <= share * F.lit(level)
        spent, weight, n = sources.agg(F.sum(F.when(above, cap).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(share)), F.sum(above.cast("long"))).first()
        if not weight or n == capped:
            break
        level, capped = max(0.0, budget - spent) / weight, n
    return sources.withColumn("target", cap if not weight and spent is not None else F.least(cap, share * F.lit(level)))


def mix_documents(
    docs: DataFrame,
    budget_ratio: float = 1.5,
    max_epochs: float = 2.0,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, repeats.

    size: words of the whole text (null or blank: 0). Sources in code point
    order, null last, have ``weights`` in turn. ``repeats`` is floor(target /
    source_size), and one more for the documents that come first in a seeded
    order of the source until the rest of the target is reached; taken = size *
    repeats. So a source misses its target by half a document at most, and
    reruns agree. A source without words has target 0; its documents are
    repeated 0 times. An empty table gives an empty result; repeated rows are
    documents of their own.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(text_col).alias("digest"))
    # by id and text: rows that repeat an id are spread like others
    rows = materialize(rows.withColumn("draw", F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("digest"), F.lit("mix")), F.lit(1 << 30))), "sizes")
    n = rows.count()
    bits = max(0, min(30, math.ceil(math.log2(max(1, n) / ROWS_PER_BUCKET))))
    rows = rows.withColumn("bucket", F.shiftright("draw", 30 - bits).cast("int"))
    buckets = materialize(rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "buckets")

    sources = buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    sources = with_position(sources, [F.col("source").asc_nulls_last()])
    nth = F.pmod(F.col("position"), F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth + 1).cast("int"))
    sources = materialize(sources.select("source", "source_size", weight.alias("weight")), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    sources = water_fill(sources, budget_ratio * total, max_epochs)
    sources = sources.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    sources = sources.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))

    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("start", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    starts = starts.alias("b").join(sources.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).select("b.source", "bucket", "start", "source_size", "target", "whole", "rest")

    inside = Window.partitionBy("source", "bucket").orderBy("draw", "doc_id", "size", "digest").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    both = rows.alias("r").join(starts.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")) & (F.col("r.bucket") == F.col("t.bucket")))
    more = (F.col("start") + F.col("local") + F.col("size") / 2.0 < F.col("rest")) & (F.col("size") > 0)
    repeats = (F.col("whole") + more.cast("long")).cast("int")
    return both.select("doc_id", "size", "source_size", "target", (F.col("size") * repeats).cast("long").alias("taken"), repeats.alias("repeats"), F.col("r.source").alias("source"))


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
