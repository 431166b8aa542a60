"""Queries on records: the ledger, diffs, JSON, SQL references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.operators import ledger as L
from latticework.plans.registry import query
from latticework.sources import parsers as P
from latticework.sources.derived import Graph


def _ledger(g: Graph) -> DataFrame:
    e = g.table("events")
    return e.select(F.col("event_type").alias("command"), F.col("ts").cast("timestamp").alias("ts"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_unix_ms"), F.floor(F.col("value") * 100).cast("bigint").alias("duration_ms"), (F.col("event_id") % 7 != 0).alias("ok"), F.from_json("props", "map<string, bigint>").alias("metrics"))


_LEDGER = "l AS (SELECT event_type AS command, ts, CAST(floor(value * 100) AS BIGINT) AS duration_ms, event_id % 7 <> 0 AS ok, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"


@query("command_ledger", f"WITH {_LEDGER} SELECT command, count(*) AS calls, count(*) FILTER (NOT ok) AS errors, CAST(sum(duration_ms) AS BIGINT) AS total_ms, sum(duration_ms) / count(*) AS mean_ms, max(duration_ms) AS max_ms FROM l GROUP BY command")
def command_ledger(g: Graph) -> DataFrame:
    return L.summarise(_ledger(g))


@query("ledger_metrics", f"WITH {_LEDGER} SELECT command, 'k' AS metric, CAST(sum(k) AS BIGINT) AS total FROM l WHERE k IS NOT NULL GROUP BY command")
def ledger_metrics(g: Graph) -> DataFrame:
    return L.metric_sums(_ledger(g))


@query("ledger_windows", f"WITH {_LEDGER} SELECT time_bucket(INTERVAL '1 hour', ts) AS start, command, count(*) AS calls, CAST(sum(duration_ms) AS BIGINT) AS total_ms FROM l GROUP BY 1, 2")
def ledger_windows(g: Graph) -> DataFrame:
    """Tumbling hours (an extension; the same plan runs on a stream)."""
    return L.windowed(_ledger(g), "ts", "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "command", "calls", "total_ms")


@query("parsed_diffs", "SELECT o_orderkey AS id, concat('src/f', o_custkey % 50, '.py') AS path, CASE WHEN o_orderstatus = 'P' THEN 'added' ELSE 'modified' END AS status, o_orderkey + 1 AS new_start, o_orderkey + greatest(o_custkey % 4, 1) AS new_end FROM orders")
def parsed_diffs(g: Graph) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    o = g.table("orders")
    name = F.concat(F.lit("src/f"), (F.col("o_custkey") % 50).cast("string"), F.lit(".py"))
    diff = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.when(F.col("o_orderstatus") == "P", "\nnew file mode 100644").otherwise(""), F.lit("\n--- a\n+++ b\n@@ -"), text("o_orderkey"), F.lit(" +"), (F.col("o_orderkey") + 1).cast("string"), F.lit(","), (F.col("o_custkey") % 4).cast("string"), F.lit(" @@\n+x"))
    return P.parse_diffs(o.select(F.col("o_orderkey").alias("id"), diff.alias("diff")))


@query("sql_references", "SELECT o_orderkey AS id, unnest(CASE WHEN o_custkey % 2 = 0 THEN [concat('t', o_custkey % 9), 'audit'] ELSE [concat('t', o_custkey % 9)] END) AS ref FROM orders")
def sql_references(g: Graph) -> DataFrame:
    t = F.concat(F.lit("T"), (F.col("o_custkey") % 9).cast("string"))
    sql = F.concat(F.lit("with recent as (select 1) select * from "), t, F.lit(" join recent on true "), F.when(F.col("o_custkey") % 2 == 0, "insert into audit values (1) on duplicate key update x = 1").otherwise(""))
    return g.table("orders").select(F.col("o_orderkey").alias("id"), F.explode(P.sql_table_refs(sql)).alias("ref"))


@query("json_keys", "SELECT k AS key, count(*) AS n FROM (SELECT unnest([concat('a', event_id % 5), 'k']) AS k FROM events) x GROUP BY 1")
def json_keys(g: Graph) -> DataFrame:
    body = F.concat(F.lit("v = obj['a"), (F.col("event_id") % 5).cast("string"), F.lit("'] or d.get(\"k\", 0)"))
    return g.table("events").select(F.explode(P.json_keys(body)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("snapshot_diff", "WITH a AS (SELECT page_id, url FROM pages WHERE page_id % 5 <> 0), b AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN concat(url, 'x') ELSE url END AS url FROM pages WHERE page_id % 7 <> 0) SELECT coalesce(a.page_id, b.page_id) AS page_id, CASE WHEN a.page_id IS NULL THEN 'added' WHEN b.page_id IS NULL THEN 'removed' ELSE 'url_changed' END AS change FROM a FULL JOIN b ON a.page_id = b.page_id WHERE a.url IS DISTINCT FROM b.url")
def snapshot_diff(g: Graph) -> DataFrame:
    from latticework.operators.joins import diff

    p = g.table("pages").select("page_id", "url")
    head = p.filter("page_id % 7 <> 0").withColumn("url", F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("x"))).otherwise(F.col("url")))
    return diff(p.filter("page_id % 5 <> 0"), head, "page_id", ["url"])
