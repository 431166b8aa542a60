"""Tables in the cluster's shared folder, for loops that must cut their lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def new_folder(spark: SparkSession, tag: str) -> str:
    """An unused folder name in the shared folder: ``spark.checkpoint.dir``; where that
    is not set, a fresh local one for a local master and an error on a cluster."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="latticework-")
        sc.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/latticework-{tag}-{uuid.uuid4().hex}"


def dealt(df: DataFrame, key: str) -> DataFrame:
    """The rows over all cores, by a key: what reads few bytes may be one task, whatever
    is then made of its rows."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def write_parts(df: DataFrame, path: str, part: str) -> None:
    """Write ``df`` partitioned by a column of few values; no task sorts its rows for that."""
    conf, name = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    conf.set(name, 100)
    try:
        df.write.partitionBy(part).option("compression", "zstd").parquet(path)
    finally:
        conf.set(name, before)


def keep(df: DataFrame, tag: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of it."""
    return counted(df, tag)[0]


def counted(df: DataFrame, tag: str = "table", what: Column | None = None) -> tuple[DataFrame, int]:
    """``keep``, and how many rows there are (or ``what`` adds up to): counted as they
    are written, so a loop learns that it is done without another job."""
    path, seen = new_folder(df.sparkSession, tag), Observation()
    df.observe(seen, (F.count(F.lit(1)) if what is None else what).alias("n")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["n"]


#: Rows that are broadcast at most; bits of a bitmap at least and at most (8 MB), and for each id.
FEW, LEAST_BITS, MOST_BITS, BITS_AN_ID = 100_000, 1 << 20, 1 << 26, 16
#: Bits of a row of a bitmap.
_ROW = 4096


def matching(rows: DataFrame, column: str, ids: DataFrame, n: int) -> DataFrame:
    """The rows whose ``column`` is among the ``n`` ids (column ``id``, each once).

    Few ids are broadcast. Of many a bitmap of their hashes is, so that of the rows
    only those that match, and a few more, are shuffled for the exact join.
    """
    asked = ids.select(F.col("id").alias(column))
    if n <= FEW:
        return rows.join(F.broadcast(asked), column, "left_semi").select(*rows.columns)
    bits = LEAST_BITS
    while bits < min(MOST_BITS, n * BITS_AN_ID):
        bits *= 2
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    div = lambda c, n: (F.shiftright(c, n.bit_length() - 1)).cast("int")
    mark = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("at") % 64).cast("int"))
    words = ids.select(place("id").alias("at")).select(div(F.col("at"), _ROW).alias("_row"), (div(F.col("at"), 64) % (_ROW // 64)).alias("word"), mark.alias("mark"))
    words = words.groupBy("_row", "word").agg(F.bit_or("mark").alias("mark"))
    maps = words.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("word", "mark"))).alias("held"))
    maps = maps.select("_row", F.transform(F.sequence(F.lit(0), F.lit(_ROW // 64 - 1)), lambda i: F.coalesce(F.try_element_at("held", i), F.lit(0).cast("bigint"))).alias("_words"))
    at = rows.withColumn("_at", place(column)).withColumn("_row", div(F.col("_at"), _ROW)).join(F.broadcast(maps), "_row")
    word = F.get("_words", div(F.col("_at"), 64) % (_ROW // 64))
    likely = at.filter((F.call_function("shiftright", word, (F.col("_at") % 64).cast("int")).bitwiseAND(F.lit(1)) == 1))
    # not a semi join, which the optimizer would make before the bitmap is asked
    return likely.select(*rows.columns).join(asked, column).select(*rows.columns)
