"""Registration of queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from latticework.sources.derived import Graph, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, recursive: bool = False):
    """Register a function of a Graph as the query ``name``."""

    def add(build: Callable[[Graph], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Graph(spark, sf_dir))
        if sql:
            ORACLES[name] = oracle(sql, recursive)
        return build

    return add


def literals(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"
