"""What the operators of this subpackage share: tables in the cluster's shared
folder, and global positions without a single-task sort."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where
    it is set; where it is not, a fresh local folder for a local master and an error on a cluster."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="latticework-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """An unused folder name below the shared folder."""
    return f"{shared_dir(spark)}/latticework-{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a reader of it.

    Cuts the lineage like ``checkpoint()``, survives lost executors, and keeps
    column pruning and filter pushdown for later readers.
    """
    spark = df.sparkSession
    path = new_folder(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Give back what ended jobs hold: shuffle files and broadcasts stay until the
    driver's JVM collects its garbage, and Python keeps freed memory for itself."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)
    spark.sparkContext._jvm.System.gc()


#: Rows of an Arrow batch that carries whole texts, at most.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches at ``BATCH_ROWS`` rows or fewer: whole texts
    travel in them, and a task holds a batch several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_position(df: DataFrame, order: list[Column], group: str | None = None, name: str = "position") -> DataFrame:
    """Add a gapless 0-based rank in ``order`` (within ``group``, if given).

    ``order`` must keep equal values of ``group`` together. Rows are dealt by
    range and ranked inside their partition; only one row for each partition
    and group is needed to add the partitions up, so no task sees all rows.
    ``group`` must hold no nulls.
    """
    width = shuffle_width(df.sparkSession)
    dealt = df.repartitionByRange(width, *order).sortWithinPartitions(*order)
    kept = materialize(dealt.withColumn("_row", F.monotonically_increasing_id()), "position")
    key = F.col(group) if group else F.lit(0)
    kept = kept.withColumn("_group", key).withColumn("_part", F.shiftright("_row", 33))
    parts = kept.groupBy("_group", "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_group", "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    # parts has at most one row for each partition and group boundary
    ranked = kept.join(F.broadcast(parts), ["_group", "_part"])
    return ranked.withColumn(name, F.col("_row") + F.col("_shift")).drop("_row", "_group", "_part", "_shift")


#: A key with more than this share of all rows is joined by broadcasting its row; there are fewer of them than its inverse.
HOT = 1e-3


def join_keyed(left: DataFrame, right: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join with ``right``, which has one row for each ``key`` and the number
    ``count`` of rows of ``left`` that hold it (dropped). Rows of a hot key stay
    where they are, so none gathers in one task."""
    total = right.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) > HOT * total
    few, rest = F.broadcast(right.filter(hot).drop(count)), right.filter(~hot).drop(count)
    cold = left.join(F.broadcast(right.filter(hot).select(key)), key, "left_anti").join(rest, key)
    return left.join(few, key).unionByName(cold)
