"""The ledger of commands: summaries in batch and over a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "command string, ts_unix_ms bigint, duration_ms bigint, ok boolean, metrics map<string, bigint>"


def read_ledger(spark, path: str) -> DataFrame:
    """JSON lines; malformed ones are ignored."""
    return spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path)


def summarise(ledger: DataFrame) -> DataFrame:
    """Per command: calls, errors, total, mean and longest duration."""
    d = F.col("duration_ms")
    return ledger.groupBy("command").agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("errors"), F.sum(d).alias("total_ms"), F.avg(d).alias("mean_ms"), F.max(d).alias("max_ms"))


def metric_sums(ledger: DataFrame) -> DataFrame:
    """Per command and metric the sum of its values."""
    return ledger.select("command", F.explode("metrics").alias("metric", "value")).groupBy("command", "metric").agg(F.sum("value").alias("total"))


def windowed(events: DataFrame, ts: Column | str, width: str, late: str | None = None) -> DataFrame:
    """Counts and durations of each command in tumbling windows; works on a batch
    and, with ``late`` as the watermark, on a stream."""
    rows = events.withColumn("_ts", F.col(ts) if isinstance(ts, str) else ts)
    rows = rows.withWatermark("_ts", late) if late else rows
    return rows.groupBy(F.window("_ts", width).alias("w"), "command").agg(F.count(F.lit(1)).alias("calls"), F.sum("duration_ms").alias("total_ms")).select(F.col("w.start").alias("start"), "command", "calls", "total_ms")


def append(rows: DataFrame, folder: str) -> None:
    """Add commands to a ledger: each append writes files of its own, so writers need no lock."""
    rows.select("command", "ts_unix_ms", "duration_ms", "ok", "metrics").write.mode("append").json(folder)
