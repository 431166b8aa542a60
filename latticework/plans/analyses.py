"""Queries on resolution, facts, candidates and views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions import lexers
from latticework.functions.tables import dealt, keep
from latticework.operators import facts as A
from latticework.operators import resolve as R
from latticework.operators import similar
from latticework.operators.joins import placed
from latticework.plans.registry import query
from latticework.plans.texts import _lines
from latticework.sources.derived import Graph

_CAT = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string") if isinstance(c, str) else c.cast("string"))


@query("def_use", "WITH o AS (SELECT l_partkey % 500 AS sym, l_orderkey AS node, l_linenumber AS line, l_linenumber = 1 AS is_def FROM lineitem), d AS (SELECT sym, min(node) AS d FROM o WHERE is_def GROUP BY 1) SELECT node AS from_id, d AS to_id, array_to_string(list_sort(list(DISTINCT line)), ',') AS lines FROM o JOIN d USING (sym) WHERE NOT is_def AND node <> d GROUP BY 1, 2")
def def_use(g: Graph) -> DataFrame:
    o = g.table("lineitem").select((F.col("l_partkey") % 500).alias("symbol"), F.col("l_orderkey").alias("node"), F.col("l_linenumber").alias("line"), (F.col("l_linenumber") == 1).alias("is_def"))
    return R.def_use(o).select("from_id", "to_id", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"))


@query("resolution", """WITH d AS (SELECT concat('Name', p_partkey % 300) AS name, p_partkey AS target, p_partkey % 60 AS placed FROM part), r AS (SELECT o_orderkey AS ref, concat('Name', o_custkey % 300) AS name, o_orderkey % 40 AS file FROM orders), f AS (SELECT name FROM d GROUP BY 1 HAVING count(*) <= 32),
e AS (SELECT ref, target, 1 AS tier FROM r JOIN d USING (name) WHERE file = placed UNION SELECT ref, target, 2 FROM r JOIN d USING (name) WHERE placed IN (file + 1, file + 2) UNION SELECT ref, target, 3 FROM r JOIN d USING (name) WHERE name IN (SELECT name FROM f)),
b AS (SELECT *, min(tier) OVER (PARTITION BY ref) AS best FROM e), n AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY target) AS n FROM b WHERE tier = best) SELECT ref, target, tier FROM n WHERE n <= 16""")
def resolution(g: Graph) -> DataFrame:
    """Names resolved in the same file, else in imported files, else module-wide."""
    defs = g.table("part").select(F.col("p_partkey").alias("id"), _CAT("Name", F.col("p_partkey") % 300).alias("name"), (F.col("p_partkey") % 60).alias("file"))
    refs = g.table("orders").select(F.col("o_orderkey").alias("ref"), _CAT("Name", F.col("o_custkey") % 300).alias("name"), (F.col("o_orderkey") % 40).alias("file"))
    files = g.spark.range(40).select(F.col("id").alias("file"), F.explode(F.array(F.col("id") + 1, F.col("id") + 2)).alias("target"))
    return R.resolve(refs, defs, files)


@query("spec_resolution", "WITH s AS (SELECT DISTINCT concat('schema/tables.sql#', CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'NONE' END) AS spec FROM customer), n AS (SELECT concat(path, '#', name) AS spec, min(id) AS found FROM nodes GROUP BY 1) SELECT s.spec, coalesce(found, concat('unresolved::', s.spec)) AS id, found IS NOT NULL AS resolved FROM s LEFT JOIN n ON s.spec = n.spec")
def spec_resolution(g: Graph) -> DataFrame:
    name = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("NONE")
    return R.resolve_specs(g.table("customer").select(F.concat(F.lit("schema/tables.sql#"), name).alias("spec")).distinct(), g.nodes)


_CANDIDATES = "c AS (SELECT CASE WHEN p_partkey % 9 = 0 THEN concat('Bad ', p_partkey) ELSE concat('cand-', p_partkey % 50) END AS id, CASE WHEN p_partkey % 7 = 0 THEN ' ' ELSE p_name END AS name, p_partkey AS seq FROM part), w AS (SELECT *, CASE WHEN NOT regexp_matches(id, '^[a-z0-9][a-z0-9_-]*$') THEN 'invalid id' WHEN row_number() OVER (PARTITION BY id ORDER BY seq) > 1 THEN 'duplicate id' WHEN trim(name) = '' THEN 'empty name' END AS warning FROM c)"


def _candidates(g: Graph) -> DataFrame:
    k = F.col("p_partkey")
    return g.table("part").select(F.when(k % 9 == 0, _CAT("Bad ", k)).otherwise(_CAT("cand-", k % 50)).alias("id"), F.when(k % 7 == 0, " ").otherwise(F.col("p_name")).alias("name"), k.alias("seq"))


@query("candidate_scan", f"WITH {_CANDIDATES} SELECT id, name FROM w WHERE warning IS NULL")
def candidate_scan(g: Graph) -> DataFrame:
    return R.scan_candidates(_candidates(g))[0].select("id", "name")


@query("candidate_warnings", f"WITH {_CANDIDATES} SELECT warning, count(*) AS n FROM w WHERE warning IS NOT NULL GROUP BY 1")
def candidate_warnings(g: Graph) -> DataFrame:
    return R.scan_candidates(_candidates(g))[1].groupBy("warning").agg(F.count(F.lit(1)).alias("n"))


@query("candidate_review", f"WITH {_CANDIDATES}, r AS (SELECT concat('cand-', o_custkey % 60) AS id, arg_max(CASE WHEN o_orderstatus = 'F' THEN 'confirmed' ELSE 'rejected' END, o_orderkey) AS verdict FROM orders GROUP BY 1) SELECT w.id, coalesce(verdict, 'proposed') AS status FROM w LEFT JOIN r ON w.id = r.id WHERE warning IS NULL")
def candidate_review(g: Graph) -> DataFrame:
    reviews = g.table("orders").select(_CAT("cand-", F.col("o_custkey") % 60).alias("id"), F.when(F.col("o_orderstatus") == "F", "confirmed").otherwise("rejected").alias("status"), F.col("o_orderkey").alias("at"))
    return R.review(candidate_scan(g).withColumn("status", F.lit("proposed")), reviews).select("id", "status")


@query("connect", """WITH m AS (SELECT to_id AS requirement, from_id AS target FROM edges WHERE kind = 'declares_implementation'), l AS (SELECT e.to_id AS requirement, e.from_id AS target FROM edges e WHERE kind = 'declares_verification' AND to_id IN (SELECT id FROM nodes) AND from_id IN (SELECT id FROM nodes)),
u AS (SELECT * FROM m UNION SELECT * FROM l) SELECT requirement, count(*) AS targets FROM u GROUP BY 1""")
def connect(g: Graph) -> DataFrame:
    """Requirements' targets after valid proposals are merged in."""
    e = g.edges
    manifest = e.filter("kind = 'declares_implementation'").groupBy(F.col("to_id").alias("requirement")).agg(F.array_sort(F.collect_set("from_id")).alias("targets"))
    links = e.filter("kind = 'declares_verification'").select(F.col("to_id").alias("requirement"), F.col("from_id").alias("target"))
    links = links.unionAll(links.limit(1).select("requirement", F.lit("no such node").alias("target")))
    return R.connect(manifest, links, g.nodes).select("requirement", F.size("targets").cast("bigint").alias("targets"))


@query("doc_votes", """WITH o AS (SELECT DISTINCT concat('n', CASE WHEN p_size > 10 THEN p_partkey ELSE p_partkey % 50 END) AS name, p_brand AS module FROM part), s AS (SELECT name, min(module) AS module FROM o GROUP BY 1 HAVING count(*) = 1), d AS (SELECT DISTINCT o_orderkey % 200 AS doc, concat('n', o_custkey) AS name FROM orders),
v AS (SELECT doc, module, count(*) AS votes FROM d JOIN s USING (name) GROUP BY 1, 2), t AS (SELECT *, max(votes) OVER (PARTITION BY doc) AS top FROM v) SELECT doc, module, votes FROM t WHERE votes = top AND votes >= 2""")
def doc_votes(g: Graph) -> DataFrame:
    owners = g.table("part").select(_CAT("n", F.when(F.col("p_size") > 10, F.col("p_partkey")).otherwise(F.col("p_partkey") % 50)).alias("name"), F.col("p_brand").alias("module"))
    mentions = g.table("orders").select((F.col("o_orderkey") % 200).alias("doc"), _CAT("n", F.col("o_custkey")).alias("name"))
    return R.doc_votes(mentions, owners)


@query("snippets", "WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), l AS (SELECT doc_id, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS row_no FROM t), h AS (SELECT *, contains(lower(line), 'tion')::INT + contains(lower(line), 'the')::INT + contains(lower(line), 'license')::INT AS hits FROM l), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, row_no) AS n FROM h WHERE hits > 0) SELECT doc_id AS key, row_no, hits FROM n WHERE n = 1")
def snippets(g: Graph) -> DataFrame:
    rows = _lines(g).select(F.col("doc_id").alias("key"), F.col("row_no").alias("at"), "line")
    return R.best_snippets(rows, ["tion", "the", "license"]).select("key", F.col("at").cast("bigint").alias("row_no"), "hits")


@query("business_view", "WITH s AS (SELECT id FROM nodes WHERE kind = 'requirement') SELECT id FROM s UNION SELECT to_id FROM edges WHERE from_id IN (SELECT id FROM s) AND to_id IN (SELECT id FROM nodes) UNION SELECT from_id FROM edges WHERE to_id IN (SELECT id FROM s) AND from_id IN (SELECT id FROM nodes)")
def business_view(g: Graph) -> DataFrame:
    return R.visible(g.nodes, g.edges, "business")


@query("graph_order", "WITH d AS (SELECT id, sum(n) AS degree FROM (SELECT from_id AS id, count(*) AS n FROM edges GROUP BY 1 UNION ALL SELECT to_id, count(*) FROM edges GROUP BY 1) x GROUP BY 1), t AS (SELECT nodes.id, CASE WHEN kind = 'rust_module' THEN 0 WHEN kind = 'requirement' THEN 1 WHEN kind = 'db_table' THEN 2 ELSE 3 END AS tier, CAST(coalesce(degree, 0) AS BIGINT) AS degree FROM nodes LEFT JOIN d ON nodes.id = d.id) SELECT id, tier, degree FROM t ORDER BY tier, degree DESC, id LIMIT 200")
def graph_order(g: Graph) -> DataFrame:
    """The 200 nodes that a bounded view shows first (a top-k report)."""
    ends = g.edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    tier = F.when(F.col("kind") == "rust_module", 0).when(F.col("kind") == "requirement", 1).when(F.col("kind") == "db_table", 2).otherwise(3)
    both = g.nodes.join(ends, "id", "left").select("id", tier.alias("tier"), F.coalesce("degree", F.lit(0)).alias("degree"))
    return both.orderBy("tier", F.col("degree").desc(), "id").limit(200)


def _varied(g: Graph) -> DataFrame:
    """Bodies of the parts that branch, loop, throw, catch, await and touch the outside in turn."""
    k, size = F.col("p_partkey"), F.col("p_size")
    line = lambda test, text: F.when(test, text).otherwise("")
    noise = "  # if return raise await\n  s = 'for open( await'\n"
    parts = [
        F.lit("def f(x):\n" + noise), line(size % 2 == 0, "  if x > 1:\n    y = 2\n"), line(k % 3 == 0, "  for i in x:\n    while i:\n      g(i)\n"), line(k % 5 == 0, "  raise E\n"),
        line(k % 7 == 0, "  try:\n    g()\n  except E:\n    pass\n"), line(k % 4 == 1, "  z = x == None\n"), line(k % 11 == 0, "  await h()\n"),
        line(size % 9 == 0, "  print(x)\n"), line(size % 9 == 1, "  setState(x)\n"), line(size % 9 == 2, "  t = Date.now\n"), line(size % 9 == 3, "  r = random\n"), line(size % 9 == 4, "  global q\n"), F.lit("  return x\n"),
    ]
    return dealt(g.table("part").select("p_partkey", "p_size"), "p_partkey").select(k.alias("id"), F.concat(*parts).alias("body"))


_FACTS = """f AS (SELECT p_partkey AS id, CAST(p_size % 2 = 0 AS INT) AS branches, 2 * CAST(p_partkey % 3 = 0 AS INT) AS loops, 1 AS early_returns, CAST(p_partkey % 5 = 0 AS INT) AS throws, CAST(p_partkey % 7 = 0 AS INT) AS catches, CAST(p_partkey % 4 = 1 AS INT) AS null_checks, CAST(p_partkey % 11 = 0 AS INT) AS awaits,
CAST(p_size % 2 = 0 AS INT) + CAST(p_partkey % 4 = 1 AS INT) AS comparisons, list_filter([CASE WHEN p_partkey % 11 = 0 THEN 'async' END, CASE p_size % 9 WHEN 0 THEN 'io' WHEN 1 THEN 'ui' WHEN 2 THEN 'time' WHEN 3 THEN 'randomness' WHEN 4 THEN 'global_mutation' END], lambda x: x IS NOT NULL) AS reasons FROM part)"""


@query("symbol_facts", f"WITH {_FACTS} SELECT id, branches, loops, early_returns, throws, catches, null_checks, awaits, comparisons, array_to_string(list_sort(reasons), ',') AS impurity, CASE WHEN len(reasons) = 0 THEN 'pure' ELSE 'impure' END AS purity FROM f")
def symbol_facts(g: Graph) -> DataFrame:
    """What each body does: counts, signals of impurity, purity."""
    counts = ["branches", "loops", "early_returns", "throws", "catches", "null_checks", "awaits", "comparisons"]
    return A.symbol_facts(_varied(g)).select("id", *counts, F.array_join("impurity", ",").alias("impurity"), "purity")


@query("suggested_tests", f"""WITH {_FACTS}, r AS (SELECT 'smoke' AS suggestion, 1 AS priority FROM f UNION ALL SELECT 'branch', 2 FROM f WHERE branches > 0 UNION ALL SELECT 'boundary', 2 FROM f WHERE comparisons > 0 UNION ALL SELECT 'null', 2 FROM f WHERE null_checks > 0 UNION ALL SELECT 'error', 1 FROM f WHERE throws > 0
UNION ALL SELECT 'loop', 3 FROM f WHERE loops > 0 UNION ALL SELECT 'purity', 3 FROM f WHERE len(reasons) = 0 UNION ALL SELECT 'dependency', 2 FROM f WHERE len(reasons) > 0) SELECT suggestion, priority, count(*) AS n FROM r GROUP BY 1, 2""")
def suggested_tests(g: Graph) -> DataFrame:
    """How many symbols ask for each kind of test."""
    return A.suggest_tests(A.symbol_facts(_varied(g))).groupBy("suggestion", "priority").agg(F.count(F.lit(1)).alias("n"))


@query("similarity_clusters")
def similarity_clusters(g: Graph) -> DataFrame:
    """Clusters of near duplicate bodies: size, upper median of tokens, least likeness (hashes that SQL does not have)."""
    marks = keep(_varied(g).select("id", lexers.fingerprint("body").alias("f")).select("id", "f.*"), "marks")
    return similar.cluster_stats(marks, keep(similar.near_clusters(marks), "clusters"))


@query("similarity_report")
def similarity_report(g: Graph) -> DataFrame:
    """The first 50 of these clusters: most tokens, then largest, then most alike."""
    return placed(similarity_clusters(g), [F.col("tokens").desc(), F.col("members").desc(), F.col("similarity").desc(), F.col("cluster")], 50)
