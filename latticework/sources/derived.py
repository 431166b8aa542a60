"""A typed graph derived from the relational tables by SQL that Spark and DuckDB
read alike, so that every graph query has something to run on and an oracle.

regions contain nations (modules, files), nations customers (types), customers
orders (methods, tests); orders call parts and reference suppliers; parts call
parts; parts implement and tests verify the requirement of a brand; orders
persist to the table of a market segment.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from latticework.functions.tables import new_folder, write_parts

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"]

_REGION = "concat('mod::r', {0})"
_NATION = "concat('file::src/n', {0}, '/lib.rs')"
_CUSTOMER = "concat('rust::src/n', {1}, '/lib.rs::Customer', {0})"
_SUPPLIER = "concat('java::src/main/java/service/Supplier', {0}, 'Service.java::Supplier', {0}, 'Service')"
_PART = "concat('python::lib/p', {0} % 40, '.py::part_', {0})"
_ORDER = "concat('python::app/o', {0} % 100, '.py::Order', {0} % 100, '.m', {0})"
_REQ = "concat('req::', {0})"
_TABLE = "concat('db_table::', {0})"

NODES = f"""
SELECT id, kind, path, name, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line, indexer, metadata_json FROM (
SELECT {_REGION.format("r_regionkey")} AS id, 'rust_module' AS kind, concat('src/r', r_regionkey) AS path, r_name AS name, 1 AS start_line, 1 AS end_line, 'rust_ast' AS indexer, CAST(NULL AS STRING) AS metadata_json FROM {{region}}
UNION ALL SELECT {_NATION.format("n_nationkey")}, 'file', concat('src/n', n_nationkey, '/lib.rs'), 'lib.rs', CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), 'rust_ast', CAST(NULL AS STRING) FROM {{nation}}
UNION ALL SELECT {_CUSTOMER.format("c_custkey", "c_nationkey")}, 'rust_struct', concat('src/n', c_nationkey, '/lib.rs'), concat('Customer', c_custkey), c_custkey * 10, c_custkey * 10 + 9, 'scip:rust', CAST(NULL AS STRING) FROM {{customer}}
UNION ALL SELECT {_SUPPLIER.format("s_suppkey")}, 'java_class', concat('src/main/java/service/Supplier', s_suppkey, 'Service.java'), concat('Supplier', s_suppkey, 'Service'), 1, 200, 'java_lsp', CAST(NULL AS STRING) FROM {{supplier}}
UNION ALL SELECT {_PART.format("p_partkey")}, 'python_function', concat(CASE WHEN p_partkey % 17 = 0 THEN 'examples/p' WHEN p_partkey % 13 = 0 THEN 'tests/p' ELSE 'lib/p' END, p_partkey % 40, '.py'),
  concat(CASE WHEN p_partkey % 5 = 0 THEN '_' ELSE '' END, replace(p_name, ' ', '_'), '_', p_partkey), p_partkey, p_partkey + p_size, CASE WHEN p_partkey % 3 = 0 THEN 'python_ast' ELSE 'scip:python' END, CAST(NULL AS STRING) FROM {{part}}
UNION ALL SELECT {_ORDER.format("o_orderkey")}, CASE WHEN o_orderstatus = 'F' THEN 'test_case' ELSE 'python_method' END, concat(CASE WHEN o_orderstatus = 'F' THEN 'app/tests/o' ELSE 'app/o' END, o_orderkey % 100, '.py'),
  concat('Order', o_orderkey % 100, '.m', o_orderkey), o_orderkey % 1000 + 1, o_orderkey % 1000 + 20, 'python_ast', CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' THEN 'fastapi_route' END FROM {{orders}}
UNION ALL SELECT DISTINCT {_REQ.format("p_brand")}, 'requirement', 'docs/requirements.md', p_brand, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), 'requirements_md', CAST(NULL AS STRING) FROM {{part}}
UNION ALL SELECT {_REQ.format("n_name")}, 'requirement', 'docs/requirements.md', n_name, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), 'requirements_md', CAST(NULL AS STRING) FROM {{nation}}
UNION ALL SELECT DISTINCT {_TABLE.format("c_mktsegment")}, 'db_table', 'schema/tables.sql', c_mktsegment, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), 'schema', CAST(NULL AS STRING) FROM {{customer}}
) n"""

EDGES = f"""
SELECT concat('edge::', kind, '::', source, '::', length(from_id), ':', from_id, '::', to_id) AS id, from_id, to_id, kind, source, certainty, status, indexer FROM (
SELECT DISTINCT from_id, to_id, kind, source, certainty, status, indexer FROM (
SELECT {_REGION.format("n_regionkey")} AS from_id, {_NATION.format("n_nationkey")} AS to_id, 'contains' AS kind, 'filesystem' AS source, 'fact' AS certainty, 'confirmed' AS status, CAST(NULL AS STRING) AS indexer FROM {{nation}}
UNION ALL SELECT {_NATION.format("n_nationkey")}, {_NATION.format("(n_nationkey + 1) % 25")}, 'imports', 'language_adapter', 'fact', 'confirmed', 'rust_ast' FROM {{nation}}
UNION ALL SELECT {_NATION.format("c_nationkey")}, {_CUSTOMER.format("c_custkey", "c_nationkey")}, 'contains', 'language_adapter', 'fact', 'confirmed', 'scip:rust' FROM {{customer}}
UNION ALL SELECT {_CUSTOMER.format("c_custkey", "c_nationkey")}, {_ORDER.format("o_orderkey")}, 'contains', 'language_adapter', 'fact', 'confirmed', 'python_ast' FROM {{orders}} JOIN {{customer}} ON c_custkey = o_custkey
UNION ALL SELECT {_ORDER.format("l_orderkey")}, {_PART.format("l_partkey")}, 'calls', CASE WHEN l_partkey % 29 = 0 THEN 'git_diff' ELSE 'language_adapter' END, CASE WHEN l_orderkey % 31 = 0 THEN 'declared' ELSE 'fact' END,
  CASE WHEN (l_orderkey + l_partkey) % 23 = 0 THEN 'deprecated' ELSE 'confirmed' END, CASE WHEN l_partkey % 4 = 0 THEN 'scip:python' WHEN l_partkey % 4 = 1 THEN 'python_lsp' WHEN l_partkey % 4 = 2 THEN 'python_ast' ELSE CAST(NULL AS STRING) END FROM {{lineitem}}
UNION ALL SELECT {_ORDER.format("l_orderkey")}, {_SUPPLIER.format("l_suppkey")}, 'references', 'language_adapter', 'fact', 'confirmed', 'java_lsp' FROM {{lineitem}}
UNION ALL SELECT {_PART.format("p_partkey")}, {_PART.format("CAST(floor(p_partkey / 2) AS BIGINT)")}, 'calls', 'language_adapter', 'fact', 'confirmed', 'python_ast' FROM {{part}} WHERE p_partkey > 0 AND p_partkey % 6 <> 5
UNION ALL SELECT {_PART.format("CAST(floor(p_partkey / 3) AS BIGINT)")}, {_PART.format("p_partkey")}, 'calls', 'language_adapter', 'fact', 'confirmed', 'dart_analyzer' FROM {{part}} WHERE p_partkey % 50 = 7
UNION ALL SELECT {_PART.format("p_partkey")}, {_REQ.format("p_brand")}, 'declares_implementation', 'external_manifest', 'declared', 'confirmed', 'links' FROM {{part}} WHERE p_partkey % 4 = 0
UNION ALL SELECT {_NATION.format("n_nationkey")}, CASE WHEN n_regionkey = 3 THEN concat('req::gone_', n_name) ELSE {_REQ.format("n_name")} END, 'declares_implementation', 'external_manifest', 'declared', 'confirmed', 'links' FROM {{nation}} WHERE n_regionkey IN (1, 2, 3)
UNION ALL SELECT CASE WHEN n_nationkey > 20 THEN 'test::gone' ELSE {_REGION.format("n_regionkey")} END, {_REQ.format("n_name")}, 'declares_verification', 'external_manifest', 'declared', 'confirmed', 'links' FROM {{nation}} WHERE n_regionkey = 2
UNION ALL SELECT {_ORDER.format("o_orderkey")}, {_REQ.format("p_brand")}, 'declares_verification', 'external_manifest', 'declared', 'confirmed', 'links' FROM {{lineitem}} JOIN {{orders}} ON o_orderkey = l_orderkey JOIN {{part}} ON p_partkey = l_partkey WHERE o_orderstatus = 'F' AND o_orderkey % 5 = 0 AND l_linenumber = 1
UNION ALL SELECT {_ORDER.format("o_orderkey")}, {_TABLE.format("c_mktsegment")}, 'persists_to', 'language_adapter', 'fact', 'confirmed', 'schema' FROM {{orders}} JOIN {{customer}} ON c_custkey = o_custkey WHERE o_orderkey % 9 = 0
UNION ALL SELECT {_ORDER.format("o_orderkey")}, concat('mod::missing', o_custkey % 7), 'imports', 'language_adapter', 'fact', 'confirmed', 'python_ast' FROM {{orders}} WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW'
UNION ALL SELECT {_SUPPLIER.format("s_suppkey")}, {_TABLE.format("'AUDIT'")}, 'persists_to', 'git_diff', 'fact', 'confirmed', CAST(NULL AS STRING) FROM {{supplier}} WHERE s_suppkey % 6 = 0
) e ) d"""

#: Ranges of symbols in files, and changed lines (hunks).
RANGES = """
SELECT concat('f', l_orderkey % 50) AS file_path, concat('s', l_orderkey, '_', l_linenumber) AS symbol_id, CAST(l_orderkey AS BIGINT) + l_linenumber * 3 AS start_line,
  CAST(l_orderkey AS BIGINT) + l_linenumber * 3 + CAST(l_quantity AS BIGINT) AS end_line FROM {lineitem}"""
HUNKS = """
SELECT concat('f', o_orderkey % 50) AS file_path, concat('h', o_orderkey) AS hunk, CAST(o_orderkey AS BIGINT) + 5 AS new_start, CAST(o_orderkey AS BIGINT) + 5 + o_custkey % 4 AS new_end FROM {orders}"""
#: What speaks for an artifact, and the files with the hashes of what was indexed.
EVIDENCE = f"""
SELECT concat('ev::', l_orderkey, '_', l_linenumber) AS id, {_PART.format("l_partkey")} AS artifact_id, CASE WHEN l_linenumber = 1 THEN 'symbol' WHEN l_returnflag = 'R' THEN 'manual' ELSE 'code' END AS kind,
  concat('app/o', l_orderkey % 100, '.py') AS path, CAST(l_orderkey % 1000 + l_linenumber AS BIGINT) AS start_line FROM {{lineitem}}"""
FILE_INDEX = """
SELECT concat('src/f', o_custkey) AS path, md5(CAST(max(o_orderkey) AS {text})) AS hash, CASE WHEN o_custkey % 4 = 0 THEN 'test' ELSE 'code' END AS kind FROM {orders} GROUP BY o_custkey"""

#: A diff of natural size: one changed run of lines for each nation.
CHANGES = """
SELECT concat('lib/p', n_nationkey, '.py') AS path, concat('c', n_nationkey) AS hunk, CAST(n_nationkey * 11 + 1 AS BIGINT) AS new_start, CAST(n_nationkey * 11 + 12 AS BIGINT) AS new_end FROM {nation}"""

_HEAD, _BRANCHES, _TAIL = re.split(r"(?<=FROM \(\n)(?=SELECT concat)|(?=\n\) e \) d)", EDGES.replace("SELECT DISTINCT from_id", "SELECT from_id", 1))
#: Order edges by the keys that tell them apart (a null nation makes the customer's id null).
_ORDER_EDGES = "SELECT DISTINCT CASE WHEN c_nationkey IS NOT NULL THEN c_custkey END AS c_custkey, c_nationkey, o_orderkey FROM {orders} JOIN {customer} ON c_custkey = o_custkey"


def _lean(branch: str) -> str:
    """A branch of the edges with each row once: by keys where its ids are one to one with them."""
    if branch.endswith("FROM {lineitem}"):
        return branch.replace("FROM {lineitem}", f"FROM (SELECT DISTINCT l_orderkey, {'l_partkey' if 'l_partkey' in branch else 'l_suppkey'} FROM {{lineitem}})")
    if branch.endswith("'contains', 'language_adapter', 'fact', 'confirmed', 'python_ast' FROM {orders} JOIN {customer} ON c_custkey = o_custkey"):
        return branch.replace("FROM {orders} JOIN {customer} ON c_custkey = o_custkey", f"FROM ({_ORDER_EDGES})")
    return branch.replace("SELECT", "SELECT DISTINCT", 1)


#: ``EDGES`` for Spark: no two branches share a row (kind, indexer or the form of an id
#: tells them apart), so each is made distinct alone, before its texts are made.
LEAN_EDGES = _HEAD + "\nUNION ALL ".join(_lean(b.strip()) for b in _BRANCHES.split("UNION ALL ")) + _TAIL
#: What edges are stored without: it is made of other columns as they are read.
EDGE_ID = "concat('edge::', kind, '::', source, '::', length(from_id), ':', from_id, '::', to_id)"

VIEWS = {"nodes": NODES, "edges": EDGES, "ranges": RANGES, "hunks": HUNKS, "evidence": EVIDENCE, "file_index": FILE_INDEX, "changes": CHANGES}
#: Relations that are written once for a folder, by kind, before anything reads them.
STORED = ("nodes", "edges")
_places: dict[tuple[str, str, str], tuple[str, StructType]] = {}


class Graph:
    """The derived relations of one data folder, each read when it is asked for.

    Nodes and edges are the index: the first use in an application writes them to
    the shared folder, partitioned by kind, and every query reads that, so a
    filter on kinds reads those alone. The tables must not change meanwhile.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text.replace("{text}", "STRING"), **{t: self.table(t) for t in TABLES if "{" + t + "}" in text})

    def stored(self, name: str, build: Callable[[], DataFrame], part: str) -> DataFrame:
        """What ``build`` gives, written once for the folder, partitioned by ``part``."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _places:
            path = new_folder(self.spark, name)
            # the columns' order is that of the frame, not of the files
            frame = build()
            write_parts(frame, path, part)
            _places[key] = (path, frame.schema)
        path, schema = _places[key]
        return self.spark.read.schema(schema).parquet(path).select(*schema.names)

    def __getattr__(self, name: str) -> DataFrame:
        if name == "edges":
            held = self.stored(name, lambda: self.sql(LEAN_EDGES).drop("id"), "kind")
            return held.select(F.expr(EDGE_ID).alias("id"), *held.columns)
        if name in STORED:
            return self.stored(name, lambda: self.sql(VIEWS[name]), "kind")
        if name in VIEWS:
            return self.sql(VIEWS[name])
        raise AttributeError(name)


def oracle(body: str, recursive: bool = False) -> str:
    """DuckDB SQL: ``body`` over the derived relations it names."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", body)]
    plain = {t: t for t in TABLES} | {"text": "VARCHAR"}
    heads = [f"{v} AS MATERIALIZED ({VIEWS[v].format(**plain)})" for v in used]
    text = body.strip()
    if text[:5].upper() == "WITH ":
        text = text[5:]
        return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join([*heads, text])}"
    return f"WITH {', '.join(heads)} {text}" if heads else text
