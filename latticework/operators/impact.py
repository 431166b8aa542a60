"""What a diff touches: symbols, their dependants, requirements, tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions import kinds as K
from latticework.functions.tables import keep
from latticework.operators import joins
from latticework.operators import traverse as T

TESTS = ["test_case", "test_group"]


def changed_symbols(nodes: DataFrame, hunks: DataFrame) -> DataFrame:
    """(id) of the smallest code or tests that changed lines (path, hunk, new_start, new_end) fall in."""
    spans = nodes.filter(F.col("kind").isin(K.CODE_OR_TEST) & F.col("start_line").isNotNull())
    ranges = spans.select(F.col("path").alias("file_path"), F.col("id").alias("symbol_id"), "start_line", "end_line")
    hits = joins.interval_join(ranges, hunks.withColumnRenamed("path", "file_path"))
    return joins.most_specific(keep(hits.select("file_path", "hunk", "symbol_id", "start_line", "end_line"), "hits")).select(F.col("symbol_id").alias("id")).distinct()


def implemented(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, requirement): what a symbol implements, or the first one above it that implements something."""
    links = edges.filter("kind = 'declares_implementation'").select(F.col("from_id").alias("ancestor"), F.col("to_id").alias("requirement"))
    above = T.ancestors(edges, ids).select("id", "ancestor", "hop").unionAll(ids.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("hop")))
    found = above.join(links, "ancestor")
    nearest = found.groupBy("id").agg(F.min("hop").alias("hop"))
    return found.join(nearest, ["id", "hop"]).select("id", "requirement").distinct()


def propagated(edges: DataFrame, changed: DataFrame, depth: int, most: int | None = None) -> DataFrame:
    """(id, depth) of the changed symbols and of what calls or references them."""
    return T.bfs(T.adjacency(edges, ["calls", "references"], reverse=True), changed, depth, most)


def impact(nodes: DataFrame, edges: DataFrame, hunks: DataFrame, depth: int = 2) -> DataFrame:
    """(id, role, depth): changed, propagated, test (a dependant that is one),
    requirement, linked_test (declared to verify such a requirement)."""
    changed = keep(changed_symbols(nodes, hunks), "changed")
    reached = keep(propagated(edges, changed, depth), "reached")
    kind = nodes.filter(F.col("kind").isin(TESTS)).select("id", F.lit(True).alias("is_test"))
    role = F.when(F.col("depth") == 0, "changed").when(F.col("is_test"), "test").otherwise("propagated")
    out = reached.join(kind, "id", "left").select("id", role.alias("role"), F.col("depth").cast("bigint").alias("depth"))
    met = keep(implemented(edges, changed).select(F.col("requirement").alias("id")).distinct(), "requirements")
    tests = edges.filter("kind = 'declares_verification'").join(met.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(F.col("from_id").alias("id")).distinct()
    last = lambda rows, name: rows.select("id", F.lit(name).alias("role"), F.lit(0).cast("bigint").alias("depth"))
    return out.unionAll(last(met, "requirement")).unionAll(last(tests, "linked_test"))


def select_tests(nodes: DataFrame, edges: DataFrame, hunks: DataFrame, depth: int = 2) -> DataFrame:
    """(id, reasons, confidence): tests of changed files, tests that reference a
    changed symbol or a dependant of one, tests of files that import its module."""
    tests = nodes.filter(F.col("kind").isin(TESTS)).select("id", "path")
    symbols = keep(propagated(edges, changed_symbols(nodes, hunks), depth).select("id"), "symbols")
    reason = lambda rows, name, rank: rows.select("id", F.lit(name).alias("reason"), F.lit(rank).alias("rank")).distinct()
    own = tests.join(hunks.select("path").distinct(), "path", "left_semi")
    cites = edges.filter(F.col("kind").isin("calls", "references")).join(symbols.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(F.col("from_id").alias("id")).join(tests.select("id"), "id", "left_semi")
    files = nodes.join(symbols, "id", "left_semi").select("path").distinct()
    modules = nodes.filter(F.col("kind").isin(K.of_family("module"))).join(files, "path", "left_semi").select(F.col("id").alias("to_id"))
    importers = edges.filter("kind = 'imports'").join(modules, "to_id", "left_semi").select(F.col("from_id").alias("id"))
    paths = nodes.select("id", "path").join(importers, "id", "left_semi").select("path").distinct()
    every = reason(own, "test_file_directly_changed", 3).unionAll(reason(cites, "references_changed_symbol", 3)).unionAll(reason(tests.join(paths, "path", "left_semi"), "imports_changed_module", 2))
    best = every.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"), F.max("rank").alias("rank"))
    return best.select("id", "reasons", F.when(F.col("rank") == 3, "high").when(F.col("rank") == 2, "medium").otherwise("low").alias("confidence"))
