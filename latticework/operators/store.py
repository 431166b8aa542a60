"""Writes: upserts, clearing, sweeps and export."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(table: DataFrame, rows: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """``table`` with ``rows`` over it: by key the last writer wins (of several new
    ones the last by ``order``)."""
    new = rows
    if order:
        new = new.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(order).desc()))).filter("_n = 1").drop("_n")
    return table.join(new, key, "left_anti").unionByName(new.select(*table.columns))


def valid_nodes(nodes: DataFrame) -> DataFrame:
    """Rows whose lines are in order; others are rejected on write."""
    return nodes.filter(F.coalesce(F.col("start_line") <= F.col("end_line"), F.lit(True)))


def clear_indexer(table: DataFrame, indexer: str) -> DataFrame:
    """Without the rows of an indexer; rows of none stay."""
    return table.filter(F.col("indexer").isNull() | (F.col("indexer") != indexer))


def sweep_orphans(rows: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Only rows whose node exists."""
    return rows.join(nodes.select(F.col("id").alias(key)), key, "left_semi")


def suppress_imprecise(edges: DataFrame, covered: DataFrame, keep: str) -> DataFrame:
    """Without calls and references that start in a covered file (ids in
    ``covered.id``) and are not of the indexer ``keep``; none counts as another."""
    vague = edges.filter(F.col("kind").isin("calls", "references") & (F.coalesce(F.col("indexer"), F.lit("")) != keep)).select("id", F.col("from_id"))
    gone = vague.join(covered.select(F.col("id").alias("from_id")), "from_id", "left_semi").select("id").distinct()
    return edges.join(gone, "id", "left_anti")


def export_jsonl(table: DataFrame, folder: str) -> None:
    """One JSON object a row; the folder appears whole or not at all."""
    table.write.mode("overwrite").option("ignoreNullFields", "false").json(folder)


def commit(frames: dict[str, DataFrame], folder: str) -> str:
    """Write several tables all or none: into a new folder below ``folder``, which
    counts only once its marker is written, last. Returns that folder."""
    spark = next(iter(frames.values())).sparkSession
    place = f"{folder.rstrip('/')}/v-{uuid.uuid4().hex}"
    for name, frame in frames.items():
        frame.write.parquet(f"{place}/{name}")
    stamp = spark.range(1).select(F.current_timestamp().alias("at"), F.lit(place).alias("place"))
    stamp.write.mode("append").json(f"{folder.rstrip('/')}/log")
    return place


def current(spark: SparkSession, folder: str) -> str | None:
    """The folder of the last commit; none: null. What a broken one left does not count."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/log")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    last = spark.read.schema("at timestamp, place string").json(f"{folder.rstrip('/')}/log").agg(F.max_by("place", "at")).first()
    return last[0]
