"""Labelled rows that a classifier learns from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import bound_batches


def held_out(doc_id: Column) -> Column:
    """Whether a document is never learned from: crc32 of its id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, y) of about ``most`` labelled documents at most that are not held out.

    A document with several labels has that of their majority, none at a tie.
    Which documents are in the sample depends on a hash of their ids alone.
    """
    bound_batches(docs.sparkSession)
    votes = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).filter("id is not null and y in (0, 1)").filter(~held_out(F.col("id")))
    votes = votes.groupBy("id").agg(F.avg("y").alias("mean")).filter("mean <> 0.5").select("id", (F.col("mean") > 0.5).cast("int").alias("y"))
    share = min(1.0, most / max(1, votes.count()))
    if share < 1.0:
        votes = votes.filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))
    # at most about `most` rows of two numbers: a fixed bound
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(votes), "id").select("id", "text", "y")
