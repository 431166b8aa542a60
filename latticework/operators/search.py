"""Ranked search: structural scores, content by BM25, boosts, demotion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions import exprs, text
from latticework.functions import kinds as K
from latticework.functions.tables import counted, keep, matching

# What a match is worth.
EXACT_ID, EXACT_NAME, PATH_SEGMENT, CONTENT_ALL, NAME_TOKEN, TEST_NAME, EVIDENCE, NEIGHBOUR, CONTENT_ANY, SUBSTRING = 100, 80, 60, 55, 50, 45, 30, 20, 15, 10
LEAST_WINDOW, NEIGHBOURS = 256, 8


def structural(nodes: DataFrame, tokens: list[str], kinds: list[str] | None = None) -> DataFrame:
    """(id, score) of nodes: each token counts once, by the first tier it meets."""
    low = lambda c: exprs.ascii_lower(F.coalesce(F.col(c), F.lit("")))
    n = nodes.filter(F.col("kind").isin(kinds or K.SEARCHED))
    n = n.select("id", "kind", "path", low("id").alias("i"), low("name").alias("m"), low("path").alias("p"), F.coalesce(text.split_identifier(F.col("name")), F.array()).alias("parts"), F.coalesce(text.compact_segments(F.col("name")), F.array()).alias("whole"))
    n = n.withColumn("segments", F.transform(F.split("p", r"[/\\]"), lambda s: F.regexp_replace(s, r"(\.dart)+$", "")))
    score = F.lit(0)
    for t in tokens:
        one = (
            F.when(F.col("i") == t, EXACT_ID)
            .when(F.col("m") == t, EXACT_NAME)
            .when(F.array_contains("segments", t), PATH_SEGMENT)
            .when(F.array_contains("parts", t) | F.array_contains("whole", t), F.when(F.col("kind").isin("test_case", "test_group"), TEST_NAME).otherwise(NAME_TOKEN))
            .when(F.contains(F.col("i"), F.lit(t)) | F.contains(F.col("p"), F.lit(t)) | F.contains(F.col("m"), F.lit(t)), SUBSTRING)
            .otherwise(0)
        )
        score = score + one
    return n.select("id", "path", score.alias("score")).filter("score > 0")


def with_content(hits: DataFrame, bodies: DataFrame, tokens: list[str]) -> DataFrame:
    """Scores plus what bodies (id, path, body) add: those with all tokens, else those with some."""
    found = F.size(F.array_intersect(text.fts_tokens(F.col("body")), F.array(*map(F.lit, tokens)).cast("array<string>")))
    content = bodies.withColumn("found", found).filter("found > 0").select("id", "path", F.when(F.col("found") == len(tokens), CONTENT_ALL).otherwise(CONTENT_ANY).alias("score"))
    return hits.unionByName(content).groupBy("id").agg(F.max("path").alias("path"), F.sum("score").alias("score"))


def ranked(hits: DataFrame, edges: DataFrame, limit: int = 25) -> DataFrame:
    """(id, score) of the best hits after boosts: a precise outgoing edge, a hit
    among the first neighbours; auxiliary and test paths count three quarters."""
    hits, several = counted(hits, "hits")
    window = keep(hits.orderBy(F.col("score").desc(), "id").limit(max(limit, LEAST_WINDOW)), "window")
    most = max(limit, LEAST_WINDOW)
    live = edges.filter(F.col("status") != "deprecated")
    tier = K.edge_tier(*[F.col(c) for c in ("kind", "source", "certainty", "status", "indexer")])
    # at most LEAST_WINDOW or limit ids ask
    asks = lambda rows: matching(rows, "id", window.select("id"), most)
    precise = asks(live.filter(F.col("kind").isin(K.USAGE) & (tier == "high")).select(F.col("from_id").alias("id"))).distinct().withColumn("evidence", F.lit(EVIDENCE))
    touching = live.filter(F.col("kind").isin(K.EXPANSION_KINDS))
    near = asks(touching.select(F.col("from_id").alias("id"), F.col("to_id").alias("other"))).unionAll(asks(touching.select(F.col("to_id").alias("id"), F.col("from_id").alias("other")))).filter("id <> other").distinct()
    first = near.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("other"))).filter(F.col("n") <= NEIGHBOURS)
    first = keep(first.select("id", "other"), "neighbours")
    met = matching(hits.select(F.col("id").alias("other")), "other", first.select(F.col("other").alias("id")).distinct(), most * NEIGHBOURS)
    linked = first.join(met, "other", "left_semi").select("id").distinct().withColumn("linked", F.lit(NEIGHBOUR if several >= 2 else 0))
    out = window.join(precise, "id", "left").join(linked, "id", "left").na.fill(0, ["evidence", "linked"])
    score = (F.col("score") + F.col("evidence") + F.col("linked")).cast("bigint")
    path = F.coalesce("path", F.lit(""))
    score = F.when(exprs.is_auxiliary_path(path) | exprs.is_test_path(path), F.floor(score * 3 / 4)).otherwise(score)
    return out.select("id", score.cast("bigint").alias("score")).orderBy(F.col("score").desc(), "id").limit(limit)


# What a candidate's description is worth, and how much an edge says about a hit.
CANDIDATE_TEXT = 40
PRIORITY = {"declares_verification": 5, "reads_provider": 4, "persists_to": 4, "navigates_to": 4, "subscribes_stream": 4, "derives_from": 4, "calls": 3, "references": 3, "contains": 2}


def card(edges: DataFrame, node_id: str) -> DataFrame:
    """(other, priority): the neighbours of a node, each with its best edge's priority."""
    touching = edges.filter((F.col("from_id") == node_id) | (F.col("to_id") == node_id))
    other = F.when(F.col("from_id") == node_id, F.col("to_id")).otherwise(F.col("from_id"))
    worth = F.lit(1)
    for kind, n in PRIORITY.items():
        worth = F.when(F.col("kind") == kind, n).otherwise(worth)
    rows = touching.select(other.alias("other"), worth.alias("priority")).filter(F.col("other") != node_id)
    return rows.groupBy("other").agg(F.max("priority").cast("bigint").alias("priority"))


def score_candidates(candidates: DataFrame, tokens: list[str]) -> DataFrame:
    """(id, score) of candidates (id, name, description): as for nodes, without paths;
    the description counts once, whatever tokens it holds."""
    low = lambda c: exprs.ascii_lower(F.coalesce(F.col(c), F.lit("")))
    rows = candidates.select("id", low("id").alias("i"), low("name").alias("m"), low("description").alias("d"), F.coalesce(text.split_identifier(F.col("name")), F.array()).alias("parts"), F.array_join(F.coalesce(text.compact_segments(F.col("name")), F.array()), "").alias("whole"), F.lit(0).alias("score"), F.lit(False).alias("told"))
    for t in tokens:
        named = F.when(F.col("i") == t, EXACT_ID).when(F.col("m") == t, EXACT_NAME).when(F.array_contains("parts", t) | (F.col("whole") == t), NAME_TOKEN)
        tells = named.isNull() & F.contains("d", F.lit(t)) & ~F.col("told")
        weak = F.when(F.contains("i", F.lit(t)) | F.contains("m", F.lit(t)), SUBSTRING).otherwise(0)
        rows = rows.select("id", "i", "m", "d", "parts", "whole", (F.col("score") + F.coalesce(named, F.when(tells, CANDIDATE_TEXT).otherwise(weak))).alias("score"), (F.col("told") | tells).alias("told"))
    return rows.filter("score > 0").select("id", F.col("score").cast("bigint").alias("score"))
