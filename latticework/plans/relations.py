"""Single-pass and join queries over the derived graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions import exprs
from latticework.functions import kinds as K
from latticework.operators import checks, joins, store
from latticework.plans.registry import literals, query
from latticework.sources.derived import Graph

_LONG = lambda c: F.col(c).cast("bigint")

_TIER = f"""CASE WHEN status = 'deprecated' OR kind = 'derives_from' OR source = 'git_diff' THEN 'low'
 WHEN kind IN ('contains', 'imports') THEN 'high'
 WHEN kind = 'documents' AND source = 'markdown' THEN 'high'
 WHEN kind IN ('declares_implementation', 'declares_verification') AND source = 'external_manifest' THEN 'high'
 WHEN kind IN {literals(K.SEMANTIC)} AND (certainty = 'declared' OR coalesce(indexer LIKE '%\\_lsp' ESCAPE '\\' OR indexer IN ('dart_analyzer', 'scip') OR indexer LIKE 'scip:%', false)) THEN 'high'
 ELSE 'medium' END"""


def tiered(edges: DataFrame) -> DataFrame:
    return edges.withColumn("tier", K.edge_tier(*[F.col(c) for c in ("kind", "source", "certainty", "status", "indexer")]))


@query("node_scan", "SELECT id, kind, path, name, start_line, end_line FROM nodes")
def node_scan(g: Graph) -> DataFrame:
    return g.nodes.select("id", "kind", "path", "name", "start_line", "end_line")


@query("nodes_by_kind", "SELECT id, name FROM nodes WHERE kind = 'java_class'")
def nodes_by_kind(g: Graph) -> DataFrame:
    return g.nodes.filter("kind = 'java_class'").select("id", "name")


@query("edges_by_kinds", "SELECT id, from_id, to_id, kind FROM edges WHERE kind IN ('contains', 'imports', 'persists_to')")
def edges_by_kinds(g: Graph) -> DataFrame:
    return g.edges.filter(F.col("kind").isin("contains", "imports", "persists_to")).select("id", "from_id", "to_id", "kind")


@query("kind_counts", "SELECT kind, count(*) AS n FROM nodes GROUP BY kind")
def kind_counts(g: Graph) -> DataFrame:
    return g.nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("family_counts", f"""SELECT CASE WHEN kind IN {literals(K.of_family("callable"))} THEN 'callable' WHEN kind IN {literals(K.of_family("type"))} THEN 'type' WHEN kind IN {literals(K.of_family("module"))} THEN 'module'
 WHEN kind IN ('test_case', 'test_group') THEN 'test' WHEN kind IN ('requirement', 'adr', 'doc_section', 'acceptance_criterion') THEN 'doc' WHEN kind IN ('db_table', 'sql_mapper_stmt') THEN 'schema' END AS family,
 count(*) AS n, sum(CASE WHEN kind IN {literals(K.CODE)} THEN 1 ELSE 0 END)::BIGINT AS code FROM nodes GROUP BY 1""")
def family_counts(g: Graph) -> DataFrame:
    # 83 rows, whatever the input
    both = g.nodes.join(F.broadcast(K.kind_traits(g.spark)), "kind")
    return both.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_code").alias("code"))


@query("edge_confidence", f"SELECT kind, source, {_TIER} AS tier, count(*) AS n FROM edges GROUP BY 1, 2, 3")
def edge_confidence(g: Graph) -> DataFrame:
    return tiered(g.edges).groupBy("kind", "source", "tier").agg(F.count(F.lit(1)).alias("n"))


@query("confidence_summary", f"""WITH t AS (SELECT to_id AS id, {_TIER} AS tier FROM edges WHERE status <> 'deprecated' AND kind IN {literals(K.USAGE)}),
s AS (SELECT id, count(*) FILTER (tier = 'high') AS high, count(*) FILTER (tier = 'medium') AS medium, count(*) FILTER (tier = 'low') AS low FROM t GROUP BY id)
SELECT id, high, medium, low, CASE WHEN high >= medium AND high >= low THEN 'high' WHEN medium >= low THEN 'medium' ELSE 'low' END AS dominant, high = 0 AND medium = 0 AND low > 0 AS only_low FROM s""")
def confidence_summary(g: Graph) -> DataFrame:
    rows = tiered(g.edges.filter(F.col("kind").isin(K.USAGE) & (F.col("status") != "deprecated")))
    s = rows.groupBy(F.col("to_id").alias("id")).agg(*[F.count_if(F.col("tier") == t).alias(t) for t in ("high", "medium", "low")])
    dominant = F.when((F.col("high") >= F.col("medium")) & (F.col("high") >= F.col("low")), "high").when(F.col("medium") >= F.col("low"), "medium").otherwise("low")
    return s.select("id", "high", "medium", "low", dominant.alias("dominant"), ((F.col("high") == 0) & (F.col("medium") == 0) & (F.col("low") > 0)).alias("only_low"))


@query("path_classes", r"""SELECT path, regexp_matches(path, '(^|/)(test|tests|testing|integration_test|test_driver|__tests__|spec|specs)(/|$)', 'i') OR regexp_matches(lower(path), '(^|/)test_[^/]*$|_test\.|\.test\.|\.spec\.|_spec\.') OR regexp_matches(path, 'Tests?/|(^|/)[^/.]*Tests?(\.[^/]*)?$') AS is_test,
 regexp_matches(lower(path), '(^|/)(tools?|scripts?|bench|benches|benchmarks?|examples?|demos?|samples?|fixtures|playground)(/|$)') AS is_auxiliary, count(*) AS n FROM nodes GROUP BY 1, 2, 3""")
def path_classes(g: Graph) -> DataFrame:
    p = F.col("path")
    return g.nodes.groupBy("path", exprs.is_test_path(p).alias("is_test"), exprs.is_auxiliary_path(p).alias("is_auxiliary")).agg(F.count(F.lit(1)).alias("n"))


@query("layers", """SELECT CASE WHEN kind = 'db_table' THEN 'table' WHEN path LIKE '%Controller%' OR path LIKE '%/controller/%' THEN 'controller' WHEN path LIKE '%ServiceImpl%' OR path LIKE '%/impl/%' THEN 'service_impl'
 WHEN path LIKE '%Service%' OR path LIKE '%/service/%' THEN 'service' WHEN path LIKE '%Mapper%' OR path LIKE '%/mapper/%' OR path LIKE '%/dao/%' THEN 'mapper' ELSE 'other' END AS layer, count(*) AS n FROM nodes GROUP BY 1""")
def layers(g: Graph) -> DataFrame:
    return g.nodes.groupBy(exprs.layer(F.col("kind"), F.col("path")).alias("layer")).agg(F.count(F.lit(1)).alias("n"))


@query("labels", "SELECT id, split_part(split_part(id, '::', -1), '#', -1) AS label FROM nodes WHERE kind <> 'file'")
def labels(g: Graph) -> DataFrame:
    return g.nodes.filter("kind <> 'file'").select("id", exprs.label_of(F.col("id")).alias("label"))


@query("interval_join", "SELECT r.file_path, symbol_id, hunk FROM ranges r JOIN hunks h ON r.file_path = h.file_path AND start_line <= new_end AND end_line >= new_start")
def interval_join(g: Graph) -> DataFrame:
    return joins.interval_join(g.ranges, g.hunks).select("file_path", "symbol_id", "hunk")


_HITS = "hits AS (SELECT r.file_path, symbol_id, start_line, end_line, hunk FROM ranges r JOIN hunks h ON r.file_path = h.file_path AND start_line <= new_end AND end_line >= new_start)"


@query("innermost_range", f"WITH {_HITS}, n AS (SELECT *, row_number() OVER (PARTITION BY file_path, hunk ORDER BY end_line - start_line, start_line DESC, symbol_id) AS n FROM hits WHERE start_line > 0) SELECT file_path, hunk, symbol_id FROM n WHERE n = 1")
def innermost_range(g: Graph) -> DataFrame:
    return joins.innermost_join(g.ranges, g.hunks).select("file_path", "hunk", "symbol_id")


@query("most_specific_ranges", f"WITH {_HITS} SELECT file_path, hunk, symbol_id FROM hits a WHERE NOT EXISTS (SELECT 1 FROM hits b WHERE a.file_path = b.file_path AND a.hunk = b.hunk AND a.start_line <= b.start_line AND a.end_line >= b.end_line AND a.end_line - a.start_line > b.end_line - b.start_line)")
def most_specific_ranges(g: Graph) -> DataFrame:
    return joins.most_specific(joins.interval_join(g.ranges, g.hunks)).select("file_path", "hunk", "symbol_id")


@query("broken_links", "SELECT id, 'from' AS side FROM edges WHERE from_id NOT IN (SELECT id FROM nodes) UNION ALL SELECT id, 'to' FROM edges WHERE to_id NOT IN (SELECT id FROM nodes)")
def broken_links(g: Graph) -> DataFrame:
    return joins.dangling(g.edges, g.nodes)


@query("orphan_requirements", "SELECT id FROM nodes WHERE kind = 'requirement' AND id NOT IN (SELECT to_id FROM edges WHERE kind = 'declares_verification')")
def orphan_requirements(g: Graph) -> DataFrame:
    met = g.edges.filter("kind = 'declares_verification'").select(F.col("to_id").alias("id"))
    return g.nodes.filter("kind = 'requirement'").select("id").join(met, "id", "left_anti")


_BASE, _HEAD = "from_id NOT LIKE '%7'", "from_id NOT LIKE '%3'"
_HEAD_STATUS = "CASE WHEN to_id LIKE '%1' THEN 'deprecated' ELSE status END"


@query("graph_diff", f"""WITH b AS (SELECT id, kind, status FROM edges WHERE {_BASE}), h AS (SELECT id, kind, {_HEAD_STATUS} AS status FROM edges WHERE {_HEAD})
SELECT change, count(*) AS n FROM (SELECT CASE WHEN b.id IS NULL THEN 'added' WHEN h.id IS NULL THEN 'removed' WHEN b.kind IS DISTINCT FROM h.kind THEN 'kind_changed' WHEN b.status IS DISTINCT FROM h.status THEN 'status_changed' END AS change FROM b FULL JOIN h ON b.id = h.id) x WHERE change IS NOT NULL GROUP BY change""")
def graph_diff(g: Graph) -> DataFrame:
    base = g.edges.filter(_BASE).select("id", "kind", "status")
    head = g.edges.filter(_HEAD).select("id", "kind", F.expr(_HEAD_STATUS).alias("status"))
    return joins.diff(base, head, "id", ["kind", "status"]).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("upsert", f"WITH new AS (SELECT id, kind, 'renamed' AS name FROM nodes WHERE id LIKE '%5') SELECT n.id, n.kind, coalesce(new.name, n.name) AS name FROM nodes n LEFT JOIN new ON n.id = new.id")
def upsert(g: Graph) -> DataFrame:
    old = g.nodes.select("id", "kind", "name")
    new = old.filter("id like '%5'").withColumn("name", F.lit("old name")).withColumn("seq", F.lit(1))
    new = new.unionAll(new.withColumn("name", F.lit("renamed")).withColumn("seq", F.lit(2)))
    return store.upsert(old, new, ["id"], "seq")


@query("clear_indexer", "SELECT id, indexer FROM edges WHERE indexer IS NULL OR indexer <> 'python_ast'")
def clear_indexer(g: Graph) -> DataFrame:
    return store.clear_indexer(g.edges, "python_ast").select("id", "indexer")


@query("orphan_sweep", "SELECT id, from_id FROM edges WHERE from_id IN (SELECT id FROM nodes WHERE kind <> 'test_case')")
def orphan_sweep(g: Graph) -> DataFrame:
    return store.sweep_orphans(g.edges, g.nodes.filter("kind <> 'test_case'"), "from_id").select("id", "from_id")


@query("precision_suppression", "SELECT id FROM edges WHERE NOT (kind IN ('calls', 'references') AND coalesce(indexer, '') <> 'scip:python' AND from_id LIKE 'python::app/o1%')")
def precision_suppression(g: Graph) -> DataFrame:
    covered = g.nodes.filter("id like 'python::app/o1%'").select("id")
    return store.suppress_imprecise(g.edges, covered, "scip:python").select("id")


@query("degree", "WITH p AS (SELECT DISTINCT from_id, to_id, kind FROM edges WHERE from_id <> to_id), e AS (SELECT from_id AS id FROM p UNION ALL SELECT to_id FROM p) SELECT id, count(*) AS degree FROM e GROUP BY id")
def degree(g: Graph) -> DataFrame:
    """Degree after the same pair and kind count once; self loops don't."""
    pairs = g.edges.filter("from_id <> to_id").select("from_id", "to_id", "kind").distinct()
    ends = pairs.select(F.explode(F.array("from_id", "to_id")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


@query("graph_stats", """SELECT count(*) AS edges, count(*) FILTER (kind = 'calls') AS calls, count(*) FILTER (kind = 'references') AS refs, count(*) FILTER (kind = 'contains') AS contains, count(*) FILTER (status = 'deprecated') AS deprecated,
 count(*) FILTER (certainty = 'declared') AS declared, count(*) FILTER (indexer IS NULL) AS unattributed, count(DISTINCT from_id) AS sources, count(DISTINCT to_id) AS targets FROM edges""")
def graph_stats(g: Graph) -> DataFrame:
    c = F.col
    return g.edges.agg(F.count(F.lit(1)).alias("edges"), *[F.count_if(c("kind") == k).alias(a) for k, a in (("calls", "calls"), ("references", "refs"), ("contains", "contains"))], F.count_if(c("status") == "deprecated").alias("deprecated"), F.count_if(c("certainty") == "declared").alias("declared"), F.count_if(c("indexer").isNull()).alias("unattributed"), F.countDistinct("from_id").alias("sources"), F.countDistinct("to_id").alias("targets"))


@query("port_coverage", """WITH b AS (SELECT DISTINCT path, lower(regexp_replace(name, '^_+', '')) AS k FROM nodes WHERE kind = 'python_function'), p AS (SELECT DISTINCT lower(regexp_replace(name, '^_+', '')) AS k FROM nodes WHERE kind = 'python_function' AND indexer = 'scip:python')
SELECT path, count(*) AS keys, count(p.k) AS ported, count(*) - count(p.k) AS missing, count(p.k) / count(*) AS ratio FROM b LEFT JOIN p ON b.k = p.k GROUP BY path""")
def port_coverage(g: Graph) -> DataFrame:
    keyed = g.nodes.filter("kind = 'python_function'").withColumn("k", exprs.name_key(F.col("name")))
    return joins.coverage(keyed, keyed.filter("indexer = 'scip:python'"), "k", "path")


@query("route_coverage", r"""WITH r AS (SELECT page_id, list_transform(list_filter(string_split(regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '[?#].*$', ''), '/'), lambda s: s <> '' AND NOT regexp_matches(s, '^(\{.*\}|<.*>|[:*$].*)$')), lambda s: lower(s)) AS segs FROM pages),
k AS (SELECT page_id, CASE WHEN len(segs) > 0 THEN segs[1] ELSE '' END AS service, array_to_string(CASE WHEN len(segs) > 2 THEN segs[-2:] ELSE segs END, '/') AS k FROM r),
b AS (SELECT DISTINCT service, k FROM k WHERE k <> ''), p AS (SELECT DISTINCT k FROM k WHERE page_id % 2 = 0 AND k <> '')
SELECT service, count(*) AS keys, count(p.k) AS ported, count(*) - count(p.k) AS missing, count(p.k) / count(*) AS ratio FROM b LEFT JOIN p ON b.k = p.k GROUP BY service""")
def route_coverage(g: Graph) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "^https?://[^/]+", ""), "[?#].*$", "")
    keyed = g.table("pages").select("page_id", exprs.route_service(path).alias("service"), exprs.route_key(path, 2).alias("k"))
    return joins.coverage(keyed, keyed.filter("page_id % 2 = 0"), "k", "service")


@query("graph_equivalence", """WITH a AS (SELECT DISTINCT kind, lower(name) AS k FROM nodes WHERE id NOT LIKE '%3'), b AS (SELECT DISTINCT kind, lower(name) AS k FROM nodes WHERE id NOT LIKE '%7')
SELECT coalesce(a.kind, b.kind) AS kind, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS matched, count(*) FILTER (b.k IS NULL) AS missing, count(*) FILTER (a.k IS NULL) AS extra FROM a FULL JOIN b ON a.kind = b.kind AND a.k = b.k GROUP BY 1""")
def graph_equivalence(g: Graph) -> DataFrame:
    keyed = g.nodes.select("id", "kind", F.lower("name").alias("k"))
    a = keyed.filter("id not like '%3'").select("kind", "k").distinct().withColumn("a", F.lit(True))
    b = keyed.filter("id not like '%7'").select("kind", "k").distinct().withColumn("b", F.lit(True))
    both = a.join(b, ["kind", "k"], "full_outer")
    return both.groupBy("kind").agg(F.count_if(F.col("a") & F.col("b")).alias("matched"), F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("extra"))


@query("column_coverage", """WITH a AS (SELECT concat('o', o_orderpriority) AS t, concat('c', o_custkey % 40) AS c FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderpriority <> '1-URGENT'), b AS (SELECT concat('o', o_orderpriority) AS t, concat('c', o_custkey % 40) AS c FROM orders WHERE o_orderkey % 11 = 0 AND o_orderpriority <> '5-LOW'),
x AS (SELECT t, list_sort(list(DISTINCT c)) AS cols FROM a GROUP BY t), y AS (SELECT t, list_sort(list(DISTINCT c)) AS cols FROM b GROUP BY t)
SELECT x.t, y.t IS NOT NULL AS matched_table, CAST(len(list_intersect(x.cols, coalesce(y.cols, []))) AS BIGINT) AS matched, CAST(len(list_filter(x.cols, lambda c: NOT list_contains(coalesce(y.cols, []), c))) AS BIGINT) AS missing, CAST(coalesce(len(list_filter(y.cols, lambda c: NOT list_contains(x.cols, c))), 0) AS BIGINT) AS extra FROM x LEFT JOIN y ON x.t = y.t""")
def column_coverage(g: Graph) -> DataFrame:
    """Per table of one schema the columns that another has, lacks, or has beside them."""
    o = g.table("orders").select("o_orderkey", F.concat(F.lit("o"), "o_orderpriority").alias("t"), F.concat(F.lit("c"), (F.col("o_custkey") % 40).cast("string")).alias("c"))
    a = o.filter("o_orderkey % 3 <> 0 and t <> 'o1-URGENT'").groupBy("t").agg(F.collect_set("c").alias("x"))
    b = o.filter("o_orderkey % 11 = 0 and t <> 'o5-LOW'").groupBy("t").agg(F.collect_set("c").alias("y"))
    none = F.array().cast("array<string>")
    both = a.join(b, "t", "left").withColumn("z", F.coalesce("y", none))
    size = lambda x: F.size(x).cast("bigint")
    return both.select("t", F.col("y").isNotNull().alias("matched_table"), size(F.array_intersect("x", "z")).alias("matched"), size(F.array_except("x", "z")).alias("missing"), size(F.array_except("z", "x")).alias("extra"))


@query("staleness", "SELECT o_orderkey, sha256(CAST(o_orderkey AS VARCHAR)) <> sha256(CAST(o_orderkey + CASE WHEN o_custkey % 10 = 0 THEN 1 ELSE 0 END AS VARCHAR)) AS stale FROM orders")
def staleness(g: Graph) -> DataFrame:
    """Rows whose stored hash differs from that of what is there now."""
    hashed = lambda x: F.sha2(x.cast("string"), 256)
    then = g.table("orders").select("o_orderkey", hashed(F.col("o_orderkey")).alias("then"))
    now = g.table("orders").select("o_orderkey", hashed(F.col("o_orderkey") + F.when(F.col("o_custkey") % 10 == 0, 1).otherwise(0)).alias("now"))
    return then.join(now, "o_orderkey").select("o_orderkey", (F.col("then") != F.col("now")).alias("stale"))


@query("modules", "WITH m AS (SELECT DISTINCT path FROM nodes WHERE path LIKE '%/%'), d AS (SELECT path, unnest(range(1, len(string_split(path, '/')))) AS i FROM m) SELECT DISTINCT concat('module::', array_to_string(string_split(path, '/')[:i], '/')) AS id FROM d")
def modules(g: Graph) -> DataFrame:
    """A module for each directory that a path lies in, at any depth."""
    parts = g.nodes.filter("path like '%/%'").select("path").distinct().select(F.split("path", "/").alias("p"))
    depth = parts.select("p", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("i"))
    return depth.select(F.concat(F.lit("module::"), F.array_join(F.slice("p", F.lit(1), F.col("i")), "/")).alias("id")).distinct()


@query("file_graph", """WITH w AS (SELECT a.path AS p, b.path AS q, CASE WHEN e.kind = 'imports' THEN 1.0 ELSE 2.0 END AS w FROM edges e JOIN nodes a ON e.from_id = a.id JOIN nodes b ON e.to_id = b.id WHERE e.kind IN ('calls', 'references', 'imports') AND a.path <> b.path)
SELECT least(p, q) AS a, greatest(p, q) AS b, CAST(sum(w) AS DOUBLE) AS weight FROM w GROUP BY 1, 2""")
def file_graph(g: Graph) -> DataFrame:
    """Undirected weights between files: calls and references count 2, imports 1."""
    paths = g.nodes.select("id", "path")
    e = g.edges.filter(F.col("kind").isin("calls", "references", "imports"))
    both = e.join(paths.select(F.col("id").alias("from_id"), F.col("path").alias("p")), "from_id").join(paths.select(F.col("id").alias("to_id"), F.col("path").alias("q")), "to_id").filter("p <> q")
    weight = F.when(F.col("kind") == "imports", 1.0).otherwise(2.0)
    return both.groupBy(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.sum(weight).alias("weight"))


@query("cohesion", """WITH w AS (SELECT split_part(a.path, '/', 1) AS m, split_part(b.path, '/', 1) AS o, CASE WHEN e.kind = 'imports' THEN 1.0 ELSE 2.0 END AS w FROM edges e JOIN nodes a ON e.from_id = a.id JOIN nodes b ON e.to_id = b.id WHERE e.kind IN ('calls', 'references', 'imports'))
SELECT m, CAST(sum(CASE WHEN m = o THEN w ELSE 0 END) AS DOUBLE) AS internal, CAST(sum(w) AS DOUBLE) AS total, CAST(sum(CASE WHEN m = o THEN w ELSE 0 END) / sum(w) AS DOUBLE) AS cohesion FROM w GROUP BY m""")
def cohesion(g: Graph) -> DataFrame:
    """Share of a top directory's outgoing weight that stays in it."""
    top = g.nodes.select("id", F.substring_index("path", "/", 1).alias("m"))
    e = g.edges.filter(F.col("kind").isin("calls", "references", "imports"))
    both = e.join(top.withColumnRenamed("id", "from_id"), "from_id").join(top.select(F.col("id").alias("to_id"), F.col("m").alias("o")), "to_id")
    w = F.when(F.col("kind") == "imports", 1.0).otherwise(2.0)
    inside, total = F.sum(F.when(F.col("m") == F.col("o"), w).otherwise(0.0)), F.sum(w)
    return both.groupBy("m").agg(inside.alias("internal"), total.alias("total"), (inside / total).alias("cohesion"))


@query("signal_score", "WITH d AS (SELECT from_id AS id, count(*) FILTER (kind = 'calls') AS calls, count(*) FILTER (kind = 'references') AS refs, count(*) FILTER (kind = 'persists_to') AS stores FROM edges GROUP BY 1) SELECT id, CAST(least(calls, 5) * 2 + least(refs, 3) * 3 + least(stores, 1) * 10 AS BIGINT) AS score FROM d")
def signal_score(g: Graph) -> DataFrame:
    """A weighted sum of capped counts."""
    d = g.edges.groupBy(F.col("from_id").alias("id")).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("calls", "references", "persists_to")])
    capped = lambda c, cap: F.least(F.col(c), F.lit(cap))
    return d.select("id", (capped("calls", 5) * 2 + capped("references", 3) * 3 + capped("persists_to", 1) * 10).cast("bigint").alias("score"))


@query("noise_calls", f"SELECT id FROM nodes WHERE split_part(split_part(split_part(id, '::', -1), '#', -1), '.', -1) IN {literals(K.TRACE_NOISE)}")
def noise_calls(g: Graph) -> DataFrame:
    return g.nodes.filter(exprs.leaf_method(F.col("id"), trace=True).isin(K.TRACE_NOISE)).select("id")


@query("link_gaps", """WITH r AS (SELECT id FROM nodes WHERE kind = 'requirement'), c AS (SELECT to_id AS id, count(*) FILTER (kind = 'declares_implementation') AS implementations, count(*) FILTER (kind = 'declares_verification') AS tests FROM edges GROUP BY 1)
SELECT r.id, coalesce(implementations, 0) AS implementations, coalesce(tests, 0) AS tests, CASE WHEN coalesce(implementations, 0) = 0 THEN 'missing' WHEN coalesce(tests, 0) = 0 THEN 'unverified' ELSE 'linked' END AS verdict FROM r LEFT JOIN c ON r.id = c.id""")
def link_gaps(g: Graph) -> DataFrame:
    """What each requirement lacks, and the verdict on its logic."""
    e = g.edges.filter(F.col("kind").isin("declares_implementation", "declares_verification"))
    counts = e.groupBy(F.col("to_id").alias("id")).agg(F.count_if(F.col("kind") == "declares_implementation").alias("i"), F.count_if(F.col("kind") == "declares_verification").alias("t"))
    r = g.nodes.filter("kind = 'requirement'").select("id").join(counts, "id", "left").select("id", F.coalesce("i", F.lit(0)).alias("implementations"), F.coalesce("t", F.lit(0)).alias("tests"))
    return r.withColumn("verdict", F.when(F.col("implementations") == 0, "missing").when(F.col("tests") == 0, "unverified").otherwise("linked"))


@query("node_lookup", "SELECT n.id, n.kind, n.path FROM nodes n JOIN (SELECT DISTINCT concat('python::lib/p', l_partkey % 40, '.py::part_', l_partkey) AS id FROM lineitem) a ON n.id = a.id")
def node_lookup(g: Graph) -> DataFrame:
    """Nodes by id, in bulk: the asked ids are a table."""
    asked = g.table("lineitem").select(F.concat(F.lit("python::lib/p"), F.col("l_partkey") % 40, F.lit(".py::part_"), "l_partkey").alias("id")).distinct()
    return g.nodes.join(asked, "id", "left_semi").select("id", "kind", "path")


@query("evidence_of", "SELECT e.artifact_id, n.name, count(*) AS n, count(*) FILTER (e.kind = 'symbol') AS symbols, min(e.id) AS first FROM evidence e JOIN nodes n ON e.artifact_id = n.id GROUP BY 1, 2")
def evidence_of(g: Graph) -> DataFrame:
    """How much evidence each artifact has, by an equi-join on its id."""
    both = g.evidence.join(g.nodes.select(F.col("id").alias("artifact_id"), "name"), "artifact_id")
    return both.groupBy("artifact_id", "name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "symbol").alias("symbols"), F.min("id").alias("first"))


@query("stale_files", """WITH now AS (SELECT concat('src/f', o_custkey) AS path, md5(CAST(max(o_orderkey) + CASE WHEN o_custkey % 10 = 0 THEN 1 ELSE 0 END AS VARCHAR)) AS hash FROM orders GROUP BY o_custkey UNION ALL SELECT 'src/new', md5('new'))
SELECT coalesce(i.path, now.path) AS path, CASE WHEN i.path IS NULL THEN 'new' WHEN now.path IS NULL THEN 'gone' WHEN i.hash <> now.hash THEN 'stale' ELSE 'fresh' END AS state FROM file_index i FULL JOIN now ON i.path = now.path""")
def stale_files(g: Graph) -> DataFrame:
    """The index of files against the hashes of what is there now."""
    now = g.sql("SELECT concat('src/f', o_custkey) AS path, md5(CAST(max(o_orderkey) + CASE WHEN o_custkey % 10 = 0 THEN 1 ELSE 0 END AS STRING)) AS now FROM {orders} GROUP BY o_custkey UNION ALL SELECT 'src/new', md5('new')")
    both = g.file_index.select("path", "hash").join(now, "path", "full_outer")
    state = F.when(F.col("hash").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("hash") != F.col("now"), "stale").otherwise("fresh")
    return both.select("path", state.alias("state"))


@query("in_degree", "SELECT to_id AS id, count(*) AS callers, least(count(*), 20) AS capped FROM edges WHERE kind = 'calls' AND from_id <> to_id GROUP BY 1")
def in_degree(g: Graph) -> DataFrame:
    """Callers of each callable, and their number as entry points are ranked by it: 20 at most."""
    calls = g.edges.filter("kind = 'calls' and from_id <> to_id")
    return calls.groupBy(F.col("to_id").alias("id")).agg(F.count(F.lit(1)).alias("callers")).withColumn("capped", F.least("callers", F.lit(20)))


@query("logic_summary", """WITH r AS (SELECT id FROM nodes WHERE kind = 'requirement'), c AS (SELECT to_id AS id, count(*) FILTER (kind = 'declares_implementation') AS i, count(*) FILTER (kind = 'declares_verification') AS t FROM edges GROUP BY 1)
SELECT CASE WHEN coalesce(i, 0) = 0 THEN 'missing' WHEN coalesce(t, 0) = 0 THEN 'unverified' ELSE 'linked' END AS verdict, count(*) AS n FROM r LEFT JOIN c ON r.id = c.id GROUP BY 1""")
def logic_summary(g: Graph) -> DataFrame:
    return link_gaps(g).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("check_findings", """WITH links AS (SELECT * FROM edges WHERE kind IN ('documents', 'declares_implementation', 'declares_verification')), ids AS (SELECT id FROM nodes), r AS (SELECT id FROM nodes WHERE kind = 'requirement'),
c AS (SELECT r.id, bool_or(coalesce(l.kind = 'declares_implementation', false)) AS impl, bool_or(coalesce(l.kind = 'declares_verification', false)) AS test FROM r LEFT JOIN links l ON l.to_id = r.id GROUP BY 1)
SELECT 'broken_link' AS code, 'error' AS severity, from_id AS artifact, count(*) AS n FROM links WHERE to_id NOT IN (SELECT id FROM ids) OR from_id NOT IN (SELECT id FROM ids) GROUP BY 3
UNION ALL SELECT 'missing_linked_test', 'warning', id, 1 FROM c WHERE impl AND NOT test UNION ALL SELECT 'orphan_requirement', 'warning', id, 1 FROM c WHERE NOT impl AND NOT test""")
def check_findings(g: Graph) -> DataFrame:
    """Consistency findings at the usual levels: broken links are errors."""
    return checks.consistency(g.nodes, g.edges, {"broken_link": "error", "missing_linked_test": "warn", "orphan_requirement": "unheard of"})


@query("stale_references", r"""WITH d AS (SELECT o_orderkey AS doc, concat('See `lib/p', o_orderkey % 60, '.py` and `', CASE WHEN o_custkey % 3 = 0 THEN 'Widget.' ELSE '' END, 'part_', o_custkey, '()` in `Q', o_orderkey % 5, '.py`') AS body FROM orders),
x AS (SELECT DISTINCT doc, unnest(regexp_extract_all(body, '`([^`]+)`', 1)) AS ref FROM d), k AS (SELECT doc, ref, CASE WHEN regexp_matches(ref, '^[\w.-]+(/[\w.-]+)+$') THEN 'path' WHEN regexp_matches(ref, '^[\w-]+\.(rs|dart|py|go|ts|swift|java|kt)$') THEN 'file' ELSE 'symbol' END AS kind FROM x),
p AS (SELECT DISTINCT path FROM nodes WHERE path IS NOT NULL), b AS (SELECT DISTINCT lower(split_part(path, '/', -1)) AS base FROM p), n AS (SELECT DISTINCT lower(name) AS name FROM nodes)
SELECT doc, kind, ref FROM k WHERE CASE kind WHEN 'path' THEN ref NOT IN (SELECT path FROM p) WHEN 'file' THEN lower(ref) NOT IN (SELECT base FROM b) ELSE lower(split_part(regexp_replace(ref, '\(\)$', ''), '.', -1)) NOT IN (SELECT name FROM n WHERE name IS NOT NULL) END""")
def stale_references(g: Graph) -> DataFrame:
    """Inline code of documents that names no path, file or symbol of the graph."""
    member = F.when(F.col("o_custkey") % 3 == 0, "Widget.").otherwise("")
    docs = g.table("orders").select(F.col("o_orderkey").alias("doc"), F.concat(F.lit("See `lib/p"), F.col("o_orderkey") % 60, F.lit(".py` and `"), member, F.lit("part_"), "o_custkey", F.lit("()` in `Q"), F.col("o_orderkey") % 5, F.lit(".py`")).alias("body"))
    return checks.drift(docs, "doc", "body", g.nodes)


@query("port_coverage_with_aliases", """WITH b AS (SELECT DISTINCT path, lower(regexp_replace(name, '^_+', '')) AS k FROM nodes WHERE kind = 'python_function'), p AS (SELECT DISTINCT lower(regexp_replace(name, '^_+', '')) AS k FROM nodes WHERE kind = 'python_function' AND indexer = 'scip:python'),
m AS (SELECT k, min(concat('alias_', k)) AS alias FROM b WHERE length(k) % 2 = 0 GROUP BY k), q AS (SELECT k FROM p UNION SELECT concat('alias_', k) FROM b WHERE length(k) % 3 = 0),
j AS (SELECT b.path, b.k, coalesce(x.k, y.k) AS found, x.k IS NULL AND y.k IS NOT NULL AS by_alias FROM b LEFT JOIN q x ON x.k = b.k LEFT JOIN m ON m.k = b.k LEFT JOIN q y ON y.k = m.alias)
SELECT path, count(*) AS keys, count(found) AS ported, count(*) FILTER (by_alias) AS by_alias FROM j GROUP BY path""")
def port_coverage_with_aliases(g: Graph) -> DataFrame:
    """Keys found under their own name, else under the one that a port map gives them."""
    k = exprs.name_key(F.col("name"))
    base = g.nodes.filter("kind = 'python_function'").select("path", k.alias("k"), "indexer")
    alias = F.concat(F.lit("alias_"), "k")
    port_map = base.filter("length(k) % 2 = 0").select("k", alias.alias("alias")).distinct()
    port = base.filter("indexer = 'scip:python'").select("k").unionAll(base.filter("length(k) % 3 = 0").select(alias.alias("k")))
    return joins.aliased(base, port, "k", "path", port_map).groupBy("path").agg(F.count(F.lit(1)).alias("keys"), F.count("found").alias("ported"), F.count_if("by_alias").alias("by_alias"))


@query("coverage_report", """WITH b AS (SELECT DISTINCT path, lower(regexp_replace(name, '^_+', '')) AS k FROM nodes WHERE kind = 'python_function'), p AS (SELECT DISTINCT lower(regexp_replace(name, '^_+', '')) AS k FROM nodes WHERE kind = 'python_function' AND indexer = 'scip:python'),
c AS (SELECT path, count(*) AS keys, count(p.k) AS ported FROM b LEFT JOIN p ON b.k = p.k GROUP BY path)
SELECT row_number() OVER (ORDER BY ported / keys, keys DESC, path) AS place, path, keys, ported FROM c QUALIFY place <= 50""")
def coverage_report(g: Graph) -> DataFrame:
    """The 50 least covered groups first, large ones before small ones, then by name (a top-k report)."""
    rows = port_coverage(g).select("path", "keys", "ported", "ratio")
    return joins.placed(rows, [F.col("ratio"), F.col("keys").desc(), F.col("path")], 50).select("place", "path", "keys", "ported")
