"""Queries on declared schemas, mappers, routes, manifests and source spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.functions import kinds as K
from latticework.functions.tables import keep
from latticework.operators import joins
from latticework.operators.features import cluster_name
from latticework.plans.registry import literals, query
from latticework.sources import parsers
from latticework.sources.derived import Graph


def _text(*parts: str | Column) -> Column:
    """Strings as they stand, ``$name`` for a column, columns as text, one after another."""
    return F.concat(*[p.cast("string") if not isinstance(p, str) else F.col(p[1:]).cast("string") if p.startswith("$") else F.lit(p) for p in parts])


@query("table_columns", """WITH t AS (SELECT n_nationkey AS k, concat('n_', lower(replace(n_name, ' ', '_'))) AS tab, n_regionkey AS r FROM nation)
SELECT k, tab AS "table", 1 AS position, 'id' AS name, 'bigint NOT NULL' AS definition FROM t UNION ALL SELECT k, tab, 2, 'name', concat('varchar(', 20 + r, ') DEFAULT ''a''') FROM t
UNION ALL SELECT k, tab, 3, 'price', 'decimal(10, 2)' FROM t WHERE r % 2 = 0 UNION ALL SELECT k, concat(tab, '_log'), 1, 'at', 'timestamp' FROM t""")
def table_columns(g: Graph) -> DataFrame:
    """Columns of the tables that a schema's statements create."""
    tab = F.concat(F.lit("n_"), F.lower(F.replace(F.col("n_name"), F.lit(" "), F.lit("_"))))
    price = F.when(F.col("n_regionkey") % 2 == 0, "  price decimal(10, 2),\n").otherwise("")
    ddl = _text("-- tables\nCREATE TABLE IF NOT EXISTS `", tab, "` (\n  `id` bigint NOT NULL,\n  name varchar(", F.col("n_regionkey") + 20, ") DEFAULT 'a',\n", price, "  PRIMARY KEY (id),\n  CONSTRAINT c CHECK (id > 0)\n);\ncreate table ", tab, "_log (at timestamp);\nselect 1;")
    return parsers.table_columns(g.table("nation").select(F.col("n_nationkey").alias("k"), ddl.alias("ddl")), "k", "ddl").select("k", "table", "position", "name", "definition")


@query("mapper_tables", """WITH s AS (SELECT s_suppkey AS k, s_nationkey % 5 AS r FROM supplier), x AS (SELECT k, 'find' AS id, unnest(['automobile', concat('side', r)]) AS tab FROM s UNION ALL SELECT k, 'add', 'building' FROM s),
n AS (SELECT lower(name) AS tab, id AS target FROM nodes WHERE kind = 'db_table') SELECT k, x.id AS statement, x.tab AS ref, n.target FROM x LEFT JOIN n ON x.tab = n.tab""")
def mapper_tables(g: Graph) -> DataFrame:
    """Tables that the statements of mappers name, includes put in, joined to the tables of the graph."""
    xml = _text('<mapper namespace="m.S', "$s_suppkey", '">\n<sql id="side"> join side', F.col("s_nationkey") % 5, ' x on 1 = 1 </sql>\n<sql id="all"> from AUTOMOBILE a <include refid="side"></include> </sql>\n<select id="find" resultType="R">\n select * <include refid="all"/> where a.id = #{id}\n</select>\n<insert id="add">insert into building values (#{x})</insert>\n</mapper>')
    rows = parsers.mapper_statements(g.table("supplier").select(F.col("s_suppkey").alias("k"), xml.alias("xml")), "k", "xml")
    refs = rows.select("k", F.col("id").alias("statement"), F.explode(parsers.sql_table_refs(F.col("sql"))).alias("ref"))
    tables = g.nodes.filter("kind = 'db_table'").select(F.lower("name").alias("ref"), F.col("id").alias("target"))
    return refs.join(tables, "ref", "left").select("k", "statement", "ref", "target")


@query("handler_joins", r"""WITH r AS (SELECT DISTINCT concat(CASE WHEN l_suppkey % 2 = 0 THEN 'SUPPLIER' ELSE 'ISupplier' END, l_suppkey, 'Service') AS name FROM lineitem),
n AS (SELECT id, lower(split_part(id, '::', -1)) AS k FROM nodes WHERE kind = 'java_class') SELECT concat('api::', name) AS spec, n.id AS target FROM r JOIN n ON n.k IN (lower(name), lower(regexp_replace(name, '^I([A-Z])', '\1')), concat(lower(name), 'impl'))""")
def handler_joins(g: Graph) -> DataFrame:
    """Interfaces joined to what implements them, by the ends of ids and two conventions of naming."""
    head = F.when(F.col("l_suppkey") % 2 == 0, "SUPPLIER").otherwise("ISupplier")
    specs = g.table("lineitem").select(_text("api::", head, "$l_suppkey", "Service").alias("spec")).distinct()
    return joins.named_alike(specs, g.nodes.filter("kind = 'java_class'"))


@query("consumed_routes", f"""WITH c AS (SELECT concat('app/o', o_orderkey % 100, '.py') AS path, concat('c', o_orderkey) AS call, CAST(o_orderkey % 1000 + 3 AS BIGINT) AS at, concat('/orders/:param/items', o_custkey % 3) AS route FROM orders),
h AS (SELECT c.call, c.route, n.id, row_number() OVER (PARTITION BY c.path, c.call ORDER BY n.end_line - n.start_line, n.start_line DESC, n.id) AS n FROM c JOIN nodes n ON n.path = c.path AND n.start_line <= c.at AND n.end_line >= c.at WHERE n.start_line > 0 AND n.kind IN {literals(K.of_family("callable"))})
SELECT call, 'GET' AS verb, route, id AS caller FROM h WHERE n = 1""")
def consumed_routes(g: Graph) -> DataFrame:
    """HTTP calls of clients, each with the callable that its line stands in."""
    line = _text("    r = await api.get('/orders/${", "$o_custkey", "}/items", F.col("o_custkey") % 3, "?page=1')")
    rows = g.table("orders").select(_text("app/o", F.col("o_orderkey") % 100, ".py").alias("file_path"), _text("c", "$o_orderkey").alias("hunk"), (F.col("o_orderkey") % 1000 + 3).alias("new_start"), parsers.consumed_route(line).alias("r")).filter("r is not null")
    calls = rows.withColumn("new_end", F.col("new_start"))
    ranges = g.nodes.filter(F.col("kind").isin(K.of_family("callable")) & F.col("start_line").isNotNull()).select(F.col("path").alias("file_path"), F.col("id").alias("symbol_id"), "start_line", "end_line")
    at = joins.innermost_join(ranges, calls).select("file_path", "hunk", F.col("symbol_id").alias("caller"))
    return calls.join(at, ["file_path", "hunk"]).select(F.col("hunk").alias("call"), "r.verb", F.col("r.path").alias("route"), "caller")


@query("links_manifest", """WITH x AS (SELECT c_custkey AS k, concat('REQ-', c_custkey) AS requirement, c_custkey FROM customer)
SELECT k, requirement, 'documents' AS relation, concat('d', c_custkey, '.md') AS target FROM x UNION ALL SELECT k, requirement, 'declares_implementation', unnest(['a.py#f', concat('b', c_custkey % 9, '.py')]) FROM x UNION ALL SELECT k, requirement, 'declares_verification', 't.py' FROM x WHERE c_custkey % 2 = 0""")
def links_manifest(g: Graph) -> DataFrame:
    """Declared links of a manifest for each customer."""
    tests = F.when(F.col("c_custkey") % 2 == 0, "    tests:\n      - t.py\n").otherwise("")
    manifest = _text("version: 1\nrequirements:\n  REQ-", "$c_custkey", ":\n    docs: ['d", "$c_custkey", ".md']\n    implementation:\n      - a.py#f\n      # not this\n      - \"b", F.col("c_custkey") % 9, '.py"\n', tests, "other:\n  REQ-0:\n    docs: [x]\n")
    return parsers.links_manifest(g.table("customer").select(F.col("c_custkey").alias("k"), manifest.alias("text")), "k", "text")


@query("literal_sites", """WITH x AS (SELECT p_size AS v, p_partkey FROM part WHERE p_size NOT IN (0, 1)), n AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY p_partkey) AS n FROM x)
SELECT CAST(v AS VARCHAR) AS value, count(*) AS n, array_to_string(list(p_partkey ORDER BY p_partkey) FILTER (n <= 3), ',') AS sites FROM n GROUP BY v""")
def literal_sites(g: Graph) -> DataFrame:
    """Numbers in code: how often, and the first three places of each."""
    rows = g.table("part").select(F.col("p_size").alias("v"), F.col("p_partkey").alias("site")).filter("v not in (0, 1)")
    return joins.first_sites(rows, "v", 3).select(F.col("v").cast("string").alias("value"), "n", F.array_join(F.col("sites").cast("array<string>"), ",").alias("sites"))


@query("json_contract", """WITH x AS (SELECT event_id, unnest(['kind', concat('k', user_id % 7)]) AS key, unnest([NULL, CASE WHEN user_id % 3 = 0 THEN '''none''' ELSE '0' END]) AS dflt FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY event_id) AS n FROM x)
SELECT key, count(*) AS n, coalesce(array_to_string(list_sort(list(DISTINCT dflt) FILTER (dflt IS NOT NULL)), ' '), '') AS defaults, array_to_string(list(event_id ORDER BY event_id) FILTER (n <= 2), ',') AS sites FROM n GROUP BY key""")
def json_contract(g: Graph) -> DataFrame:
    """Keys that code reads from JSON: how often, with which defaults, and the first two places."""
    code = _text("a = row['kind']; b = row.get(\"k", F.col("user_id") % 7, '", ', F.when(F.col("user_id") % 3 == 0, "'none'").otherwise("0"), ")")
    rows = g.table("events").select(F.col("event_id").alias("site"), F.explode(parsers.json_reads(code)).alias("r")).select("site", "r.*")
    marks = rows.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("default")), " ").alias("defaults"))  # distinct defaults of a key: few
    return joins.first_sites(rows, "key", 2).join(marks, "key").select("key", "n", "defaults", F.array_join(F.col("sites").cast("array<string>"), ",").alias("sites"))


@query("source_spans", """WITH d AS (SELECT o_orderkey, o_custkey % 6 AS c FROM orders)
SELECT o_orderkey AS id, concat(array_to_string(list_transform(range(0, c), lambda i: concat('# note ', i)), chr(10)), CASE WHEN c > 0 THEN chr(10) ELSE '' END, 'def f():', chr(10), '  return ', o_orderkey) AS text FROM d""")
def source_spans(g: Graph) -> DataFrame:
    """The text of a symbol's lines with the comments right above it."""
    n = F.col("o_custkey") % 6
    notes = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.concat(F.lit("# note "), (i - 1).cast("string")))
    body = F.concat(F.array(F.lit("#include <x>"), F.lit("import a"), F.lit("")), F.slice(notes, F.lit(1), n.cast("int")), F.array(F.lit("def f():"), _text("  return ", "$o_orderkey"), F.lit("end")))
    rows = g.table("orders").select(F.col("o_orderkey").alias("id"), body.alias("all"), (n + 4).alias("s"))
    return rows.select("id", parsers.span(F.col("all"), F.col("s"), F.col("s") + 1).alias("text"))


@query("module_rollup", """WITH m AS (SELECT id, split_part(path, '/', 1) AS module, kind, metadata_json FROM nodes WHERE path IS NOT NULL), o AS (SELECT a.module, count(DISTINCT b.id) FILTER (e.kind = 'persists_to') AS stores, count(DISTINCT b.module) FILTER (b.module <> a.module) AS needs FROM edges e JOIN m a ON e.from_id = a.id JOIN m b ON e.to_id = b.id GROUP BY 1)
SELECT m.module, count(*) AS symbols, count(DISTINCT m.kind) AS kinds, count(metadata_json) AS roles, coalesce(any_value(o.stores), 0) AS stores, coalesce(any_value(o.needs), 0) AS needs FROM m LEFT JOIN o ON m.module = o.module GROUP BY m.module""")
def module_rollup(g: Graph) -> DataFrame:
    """What each top directory holds, stores to and depends on."""
    m = g.nodes.filter("path is not null").select("id", F.substring_index("path", "/", 1).alias("module"), "kind", "metadata_json")
    both = g.edges.select("from_id", "to_id", F.col("kind").alias("edge")).join(m.select(F.col("id").alias("from_id"), "module"), "from_id").join(m.select(F.col("id").alias("to_id"), F.col("module").alias("other")), "to_id")
    # pairs first, in one pass, so that what is counted is no larger than the modules and tables there are
    met = keep(both.select("module", "other", F.when(F.col("edge") == "persists_to", F.col("to_id")).alias("store")).distinct(), "modules")
    needs = met.filter("module <> other").select("module", "other").distinct().groupBy("module").agg(F.count(F.lit(1)).alias("needs"))
    stores = met.filter("store is not null").select("module", "store").distinct().groupBy("module").agg(F.count(F.lit(1)).alias("stores"))
    own = m.groupBy("module").agg(F.count(F.lit(1)).alias("symbols"), F.countDistinct("kind").alias("kinds"), F.count("metadata_json").alias("roles"))
    return own.join(stores, "module", "left").join(needs, "module", "left").na.fill(0, ["stores", "needs"])


@query("edges_by_resolver", "SELECT id, indexer FROM edges WHERE indexer IN ('python_lsp', 'java_lsp')")
def edges_by_resolver(g: Graph) -> DataFrame:
    return g.edges.filter(F.col("indexer").isin("python_lsp", "java_lsp")).select("id", "indexer")


@query("feature_names", "SELECT path, concat('n', regexp_extract(path, 'src/n([0-9]+)/', 1), ' · lib.rs') AS name FROM nodes WHERE kind = 'file'")
def feature_names(g: Graph) -> DataFrame:
    """Names of features by the paths of what anchors them."""
    return g.nodes.filter("kind = 'file'").select("path", cluster_name(F.col("path")).alias("name"))
