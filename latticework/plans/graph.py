"""Iterative queries over the derived graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions import exprs
from latticework.functions import kinds as K
from latticework.operators import communities as C
from latticework.operators import checks, reach
from latticework.operators import features as features_
from latticework.operators import impact as impact_
from latticework.operators import resolve as R
from latticework.operators import search as S
from latticework.operators import traverse as T
from latticework.operators.joins import placed
from latticework.plans.analyses import candidate_review
from latticework.plans.registry import literals, query
from latticework.plans.relations import file_graph
from latticework.sources.derived import Graph

_SEED = "id LIKE 'python::app/o7.py%'"
_WALK = f"""p AS (SELECT DISTINCT from_id AS src, to_id AS dst FROM edges WHERE kind IN {literals(K.TRACE_KINDS)} AND from_id <> to_id),
r(id, depth) AS (SELECT id, 0 FROM nodes WHERE {_SEED} UNION SELECT p.dst, r.depth + 1 FROM r JOIN p ON r.id = p.src WHERE r.depth < 4), d AS (SELECT id, min(depth) AS depth FROM r GROUP BY id)"""
_LAYER = "CASE WHEN n.kind = 'db_table' THEN 'table' WHEN n.path LIKE '%ServiceImpl%' OR n.path LIKE '%/impl/%' THEN 'service_impl' WHEN n.path LIKE '%Service%' OR n.path LIKE '%/service/%' THEN 'service' ELSE 'other' END"


@query("trace", f"WITH {_WALK} SELECT d.id, CAST(d.depth AS BIGINT) AS depth, coalesce(n.kind, 'unknown') AS kind, {_LAYER} AS layer FROM d LEFT JOIN nodes n ON d.id = n.id", recursive=True)
def trace(g: Graph) -> DataFrame:
    """What the methods of a file lead to within four hops, with its layer."""
    edges = g.edges.filter(F.col("kind").isin(K.TRACE_KINDS))
    noisy = (F.col("kind") == "calls") & exprs.leaf_method(F.col("to_id"), trace=True).isin(K.TRACE_NOISE)
    found = T.bfs(T.adjacency(edges.filter(~noisy)), g.nodes.filter(_SEED), 4)
    n = found.join(g.nodes.select("id", "kind", "path"), "id", "left")
    return n.select("id", F.col("depth").cast("bigint").alias("depth"), F.coalesce("kind", F.lit("unknown")).alias("kind"), exprs.layer(F.col("kind"), F.col("path")).alias("layer"))


@query("trace_layers", f"WITH {_WALK} SELECT depth, layer, count(*) AS n FROM (SELECT CAST(d.depth AS BIGINT) AS depth, {_LAYER} AS layer FROM d LEFT JOIN nodes n ON d.id = n.id) x GROUP BY 1, 2", recursive=True)
def trace_layers(g: Graph) -> DataFrame:
    return trace(g).groupBy("depth", "layer").agg(F.count(F.lit(1)).alias("n"))


@query("impact", """WITH p AS (SELECT DISTINCT to_id AS src, from_id AS dst FROM edges WHERE kind IN ('calls', 'references') AND from_id <> to_id),
r(id, depth) AS (SELECT id, 0 FROM nodes WHERE kind = 'python_function' AND path = 'lib/p3.py' UNION SELECT p.dst, r.depth + 1 FROM r JOIN p ON r.id = p.src WHERE r.depth < 3)
SELECT r.id, CAST(min(depth) AS BIGINT) AS depth, bool_or(coalesce(n.kind = 'test_case', false)) AS is_test FROM r LEFT JOIN nodes n ON r.id = n.id GROUP BY r.id""", recursive=True)
def impact(g: Graph) -> DataFrame:
    """Callers of a changed file's functions within three hops, tests marked."""
    found = T.bfs(T.adjacency(g.edges, ["calls", "references"], reverse=True), g.nodes.filter("kind = 'python_function' and path = 'lib/p3.py'"), 3)
    tests = g.nodes.filter("kind = 'test_case'").select("id").withColumn("t", F.lit(True))
    return found.join(tests, "id", "left").select("id", F.col("depth").cast("bigint").alias("depth"), F.coalesce("t", F.lit(False)).alias("is_test"))


_NEAR = f"""sym AS (SELECT DISTINCT from_id AS src, to_id AS dst FROM edges WHERE kind IN {literals(K.EXPANSION_KINDS)} AND from_id <> to_id UNION SELECT to_id, from_id FROM edges WHERE kind IN {literals(K.EXPANSION_KINDS)} AND from_id <> to_id),
r(id, depth) AS (SELECT id, 0 FROM nodes WHERE id = 'db_table::BUILDING' UNION SELECT sym.dst, r.depth + 1 FROM r JOIN sym ON r.id = sym.src WHERE r.depth < 2), ids AS (SELECT DISTINCT id FROM r)"""


@query("subgraph", f"WITH {_NEAR} SELECT id, kind FROM edges WHERE kind IN {literals(K.EXPANSION_KINDS)} AND from_id IN (SELECT id FROM ids) AND to_id IN (SELECT id FROM ids)", recursive=True)
def subgraph(g: Graph) -> DataFrame:
    """Edges among the nodes within two hops of a table, in either direction."""
    return T.expand(g.edges, g.nodes.filter("id = 'db_table::BUILDING'"), K.EXPANSION_KINDS, 2)[1].select("id", "kind")


@query("explain_symbol", "SELECT 'in' AS direction, kind, count(*) AS n FROM edges WHERE to_id = 'python::lib/p4.py::part_4' OR to_id LIKE 'python::lib/p4::part_4' OR to_id = 'python::lib/p4.py::part_44' GROUP BY kind UNION ALL SELECT 'out', kind, count(*) FROM edges WHERE from_id = 'python::lib/p4.py::part_4' OR from_id = 'python::lib/p4.py::part_44' GROUP BY kind")
def explain_symbol(g: Graph) -> DataFrame:
    asked = ["python::lib/p4.py::part_4", "python::lib/p4.py::part_44"]
    side = lambda c, d: g.edges.filter(F.col(c).isin(asked)).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit(d).alias("direction"), "kind", "n")
    return side("to_id", "in").unionAll(side("from_id", "out"))


@query("descendants", "WITH p AS (SELECT from_id, to_id FROM edges WHERE kind = 'contains'), r(id) AS (SELECT 'mod::r2' UNION SELECT p.to_id FROM r JOIN p ON r.id = p.from_id) SELECT id FROM r", recursive=True)
def descendants(g: Graph) -> DataFrame:
    return T.closure(T.adjacency(g.edges, ["contains"]), g.nodes.filter("id = 'mod::r2'"))


@query("ancestors", """WITH p AS (SELECT to_id AS id, arg_min(from_id, id) AS parent FROM edges WHERE kind = 'contains' GROUP BY to_id), r(id, ancestor, hop) AS (SELECT n.id, p.parent, 1 FROM nodes n JOIN p ON n.id = p.id WHERE n.kind = 'test_case' UNION ALL SELECT r.id, p.parent, r.hop + 1 FROM r JOIN p ON r.ancestor = p.id WHERE r.hop < 17)
SELECT id, ancestor, CAST(hop AS BIGINT) AS hop FROM r""", recursive=True)
def ancestors(g: Graph) -> DataFrame:
    return T.ancestors(g.edges, g.nodes.filter("kind = 'test_case'")).select("id", "ancestor", F.col("hop").cast("bigint").alias("hop"))


_ENTRY = r"""entry AS (SELECT id FROM nodes WHERE (kind IN """ + literals(K.CODE_OR_TEST) + r""" AND regexp_matches(lower(path), '(^|/)(tools?|scripts?|bench|benches|benchmarks?|examples?|demos?|samples?|fixtures|playground)(/|$)')) OR kind IN ('route', 'dart_provider', 'test_case', 'test_group')
 OR (kind IN ('python_function', 'python_method') AND regexp_matches(split_part(name, '.', -1), '^(main|__main__|app|cli|test_.*|__.*__)$')))"""
_REACH = f"""k AS (SELECT id, kind FROM nodes), fwd AS (SELECT DISTINCT from_id AS src, to_id AS dst FROM edges WHERE kind IN {literals([*K.USAGE, "contains"])} UNION SELECT e.to_id, e.from_id FROM edges e JOIN k ON k.id = e.from_id WHERE e.kind = 'contains' AND k.kind IN {literals(K.of_family("module"))}),
r1(id) AS (SELECT id FROM entry UNION SELECT fwd.dst FROM r1 JOIN fwd ON r1.id = fwd.src),
up AS (SELECT DISTINCT e.to_id AS src, e.from_id AS dst FROM edges e JOIN k ON k.id = e.from_id WHERE e.kind = 'contains' AND k.kind IN {literals(K.of_family("module", "type"))}),
r2(id) AS (SELECT id FROM r1 UNION SELECT up.dst FROM r2 JOIN up ON r2.id = up.src)"""


@query("dead_code", rf"""WITH {_ENTRY}, {_REACH}, u AS (SELECT id, path, name FROM nodes WHERE kind IN {literals(K.CODE)} AND NOT regexp_matches(path, '(^|/)(test|tests)(/|$)') AND id NOT IN (SELECT id FROM r2)),
c AS (SELECT u.id, count(e.id) AS inbound, count(r2.id) AS live_inbound FROM u LEFT JOIN edges e ON e.to_id = u.id AND e.kind IN {literals(K.USAGE)} LEFT JOIN r2 ON r2.id = e.from_id GROUP BY u.id)
SELECT u.id, u.path, CASE WHEN inbound > 0 THEN 'low' WHEN u.name NOT LIKE '\_%' ESCAPE '\' THEN 'medium' ELSE 'high' END AS confidence, inbound, live_inbound FROM u JOIN c ON u.id = c.id""", recursive=True)
def dead_code(g: Graph) -> DataFrame:
    return reach.dead_code(g.nodes, g.edges)


@query("impurity", "WITH p AS (SELECT DISTINCT to_id AS src, from_id AS dst FROM edges WHERE kind = 'calls' AND from_id <> to_id), r(id) AS (SELECT id FROM nodes WHERE kind = 'python_function' AND end_line - start_line > 45 UNION SELECT p.dst FROM r JOIN p ON r.id = p.src) SELECT id FROM r", recursive=True)
def impurity(g: Graph) -> DataFrame:
    """Callables that are impure themselves (here: long ones) or call an impure one."""
    facts = g.nodes.filter("kind = 'python_function' and end_line - start_line > 45")
    return reach.impure(g.edges.filter("kind = 'calls'"), facts).select("id")


_CLAIMS = """f AS (SELECT id, path FROM nodes WHERE kind IN ('file', 'python_module', 'dart_class', 'swift_class') AND path IS NOT NULL AND NOT regexp_matches(path, '(^|/)(test|tests)(/|$)')),
c AS (SELECT DISTINCT from_id, to_id FROM edges WHERE kind = 'contains'), i(seed, id) AS (SELECT id, id FROM f UNION SELECT i.seed, c.to_id FROM i JOIN c ON i.id = c.from_id),
r AS (SELECT seed, count(metadata_json) AS roles FROM i JOIN nodes n ON i.id = n.id GROUP BY 1), x AS (SELECT i.seed, count(*) AS refs FROM edges e JOIN i ON e.to_id = i.id WHERE e.kind IN ('calls', 'references', 'imports') AND NOT EXISTS (SELECT 1 FROM i j WHERE j.seed = i.seed AND j.id = e.from_id) GROUP BY 1),
s AS (SELECT f.id, f.path, 1 + 5 * coalesce(r.roles, 0) + least(coalesce(x.refs, 0), 20) AS score FROM f LEFT JOIN r ON f.id = r.seed LEFT JOIN x ON f.id = x.seed)"""


@query("seed_scores", f"WITH {_CLAIMS} SELECT id, CAST(score AS BIGINT) AS score FROM s", recursive=True)
def seed_scores(g: Graph) -> DataFrame:
    """How much each file speaks for a feature: framework roles and outside references of all that it contains."""
    return features_.seeds(g.nodes, g.edges).select("id", "score")


@query("features", f"""WITH {_CLAIMS}, k AS (SELECT count(*) AS code FROM nodes WHERE kind IN {literals(K.CODE)}),
t AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, path, id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, id) AS n FROM s) y WHERE n = 1 QUALIFY rank <= (SELECT least(greatest(code // 250, 20), 80) FROM k)),
p AS (SELECT DISTINCT from_id AS src, to_id AS dst FROM edges WHERE kind IN ('contains', 'imports', 'calls', 'references') AND from_id <> to_id UNION SELECT to_id, from_id FROM edges WHERE kind = 'contains' AND from_id <> to_id),
w(id, rank, depth) AS (SELECT id, rank, 0 FROM t UNION SELECT p.dst, w.rank, w.depth + 1 FROM w JOIN p ON w.id = p.src WHERE w.depth < 3), b AS (SELECT id, min(rank) AS rank FROM w GROUP BY id) SELECT b.id, t.id AS seed FROM b JOIN t ON b.rank = t.rank""", recursive=True)
def features(g: Graph) -> DataFrame:
    """The feature that each node within three hops of a seed belongs to."""
    return features_.claims(g.nodes, g.edges)


@query("components")
def components(g: Graph) -> DataFrame:
    """Connected components of all call edges (recursive SQL would hold all pairs of one; no SQL)."""
    pairs = g.edges.filter("kind = 'calls' and from_id <> to_id")
    return T.label_components(pairs.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")))


_CHANGED = f"""hit AS (SELECT DISTINCT n.id, n.path, n.start_line, n.end_line, c.hunk FROM nodes n JOIN changes c ON n.path = c.path AND n.start_line <= c.new_end AND n.end_line >= c.new_start WHERE n.kind IN {literals(K.CODE_OR_TEST)}),
changed AS (SELECT DISTINCT id FROM hit a WHERE NOT EXISTS (SELECT 1 FROM hit b WHERE a.path = b.path AND a.hunk = b.hunk AND a.start_line <= b.start_line AND a.end_line >= b.end_line AND a.end_line - a.start_line > b.end_line - b.start_line)),
rev AS (SELECT DISTINCT to_id AS src, from_id AS dst FROM edges WHERE kind IN ('calls', 'references') AND from_id <> to_id), w(id, depth) AS (SELECT id, 0 FROM changed UNION SELECT rev.dst, w.depth + 1 FROM w JOIN rev ON w.id = rev.src WHERE w.depth < 2),
d AS (SELECT id, min(depth) AS depth FROM w GROUP BY id)"""


@query("impact_of_diff", f"""WITH {_CHANGED}, req AS (SELECT DISTINCT e.to_id AS id FROM edges e JOIN changed c ON e.from_id = c.id WHERE e.kind = 'declares_implementation')
SELECT d.id, CASE WHEN d.depth = 0 THEN 'changed' WHEN n.kind IN ('test_case', 'test_group') THEN 'test' ELSE 'propagated' END AS role, CAST(d.depth AS BIGINT) AS depth FROM d LEFT JOIN nodes n ON d.id = n.id
UNION ALL SELECT id, 'requirement', 0 FROM req UNION ALL SELECT DISTINCT e.from_id, 'linked_test', 0 FROM edges e JOIN req ON e.to_id = req.id WHERE e.kind = 'declares_verification'""", recursive=True)
def impact_of_diff(g: Graph) -> DataFrame:
    """A diff's changed symbols, what depends on them, the requirements that they
    (or what contains them) implement, and these requirements' tests."""
    return impact_.impact(g.nodes, g.edges, g.changes, depth=2)


@query("select_tests", f"""WITH {_CHANGED}, t AS (SELECT id, path FROM nodes WHERE kind IN ('test_case', 'test_group')), x AS (SELECT id FROM d),
own AS (SELECT t.id, 'test_file_directly_changed' AS reason, 3 AS rank FROM t WHERE path IN (SELECT path FROM changes)),
cites AS (SELECT e.from_id AS id, 'references_changed_symbol' AS reason, 3 AS rank FROM edges e JOIN x ON e.to_id = x.id JOIN t ON e.from_id = t.id WHERE e.kind IN ('calls', 'references')),
m AS (SELECT DISTINCT n.id FROM nodes n JOIN nodes s ON n.path = s.path JOIN x ON s.id = x.id WHERE n.kind IN {literals(K.of_family("module"))}),
imp AS (SELECT t.id, 'imports_changed_module' AS reason, 2 AS rank FROM edges e JOIN m ON e.to_id = m.id JOIN nodes n ON e.from_id = n.id JOIN t ON t.path = n.path WHERE e.kind = 'imports'),
every AS (SELECT * FROM own UNION SELECT * FROM cites UNION SELECT * FROM imp)
SELECT id, array_to_string(list_sort(list(DISTINCT reason)), ',') AS reasons, CASE max(rank) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence FROM every GROUP BY id""", recursive=True)
def select_tests(g: Graph) -> DataFrame:
    """Tests to run for a diff, with their reasons and the confidence of the best one."""
    return impact_.select_tests(g.nodes, g.edges, g.changes, depth=2)


@query("questions", f"""WITH {_ENTRY}, used AS (SELECT to_id FROM edges WHERE kind IN ('calls', 'references', 'imports', 'reads_provider', 'navigates_to', 'persists_to', 'subscribes_stream', 'declares_implementation')),
cand AS (SELECT CASE WHEN p_partkey % 9 = 0 THEN concat('Bad ', p_partkey) ELSE concat('cand-', p_partkey % 50) END AS id, CASE WHEN p_partkey % 7 = 0 THEN ' ' ELSE p_name END AS name, p_partkey AS seq FROM part),
good AS (SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS n FROM cand WHERE regexp_matches(id, '^[a-z0-9][a-z0-9_-]*$')) y WHERE n = 1 AND trim(name) <> ''),
verdict AS (SELECT concat('cand-', o_custkey % 60) AS id, arg_max(CASE WHEN o_orderstatus = 'F' THEN 'confirmed' ELSE 'rejected' END, o_orderkey) AS v FROM orders GROUP BY 1),
q AS (SELECT 'orphan_symbol' AS category, 'info' AS severity, id, path FROM nodes WHERE kind IN {literals(K.CODE)} AND metadata_json IS NULL AND name NOT IN ('main', '__main__') AND id NOT IN (SELECT to_id FROM used) AND id NOT IN (SELECT id FROM entry)
UNION ALL SELECT 'pending_candidate', 'warn', id, NULL FROM good WHERE id NOT IN (SELECT id FROM verdict)
UNION ALL SELECT 'test_without_references', 'info', id, path FROM nodes WHERE kind = 'test_case' AND id NOT IN (SELECT from_id FROM edges WHERE kind IN ('calls', 'references'))
UNION ALL SELECT DISTINCT 'dangling_import', 'info', e.to_id, n.path FROM edges e JOIN nodes n ON e.from_id = n.id WHERE e.kind = 'imports' AND e.to_id NOT IN (SELECT id FROM nodes) AND regexp_matches(n.path, '^test|/tests?/')),
n AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY id, path) AS n FROM q) SELECT category, severity, id, path FROM n WHERE n <= 20""")
def questions(g: Graph) -> DataFrame:
    """Open questions, at most 20 of each of the four categories, in id order."""
    entries = g.nodes.filter(reach.implicit_entry())
    every = checks.questions(g.nodes, g.edges, candidate_review(g), entries, K.CODE)
    order = Window.partitionBy("category").orderBy("id", "path")
    # the rank is limited before the shuffle, so a category sends 20 rows a task
    return every.withColumn("n", F.row_number().over(order)).filter("n <= 20").drop("n")


@query("dead_code_report", rf"""WITH {_ENTRY}, {_REACH}, u AS (SELECT id, path, name FROM nodes WHERE kind IN {literals(K.CODE)} AND NOT regexp_matches(path, '(^|/)(test|tests)(/|$)') AND id NOT IN (SELECT id FROM r2)),
c AS (SELECT u.id, count(e.id) AS inbound FROM u LEFT JOIN edges e ON e.to_id = u.id AND e.kind IN {literals(K.USAGE)} GROUP BY u.id),
x AS (SELECT u.id, u.path, split_part(split_part(u.id, '::', -1), '#', -1) AS label, CASE WHEN inbound > 0 THEN 1 WHEN u.name NOT LIKE '\_%' ESCAPE '\' THEN 2 ELSE 3 END AS rank FROM u JOIN c ON u.id = c.id)
SELECT row_number() OVER (ORDER BY rank DESC, path, label, id) AS place, id, CASE rank WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS confidence FROM x WHERE rank >= 2 QUALIFY place <= 100""", recursive=True)
def dead_code_report(g: Graph) -> DataFrame:
    """The first 100 dead symbols of medium confidence or more: confidence down, then path, label, id."""
    rank = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).otherwise(1)
    rows = dead_code(g).withColumn("rank", rank).filter("rank >= 2").withColumn("label", exprs.label_of(F.col("id")))
    return placed(rows, [F.col("rank").desc(), F.col("path"), F.col("label"), F.col("id")], 100).select("place", "id", "confidence")


@query("trace_report", f"WITH {_WALK} SELECT row_number() OVER (ORDER BY depth, id) AS place, id, CAST(depth AS BIGINT) AS depth FROM d QUALIFY place <= 100", recursive=True)
def trace_report(g: Graph) -> DataFrame:
    """The first 100 nodes of the trace by depth and id."""
    return placed(trace(g).select("id", "depth"), [F.col("depth"), F.col("id")], 100)


@query("module_parents", """WITH m AS (SELECT DISTINCT path FROM nodes WHERE path LIKE '%/%'), d AS (SELECT path, unnest(range(1, len(string_split(path, '/')))) AS i FROM m), dirs AS (SELECT DISTINCT array_to_string(string_split(path, '/')[:i], '/') AS dir FROM d),
inner_ AS (SELECT to_id AS id, arg_min(from_id, id) AS parent FROM edges WHERE kind = 'contains' GROUP BY 1)
SELECT concat('module::', dir) AS id, CASE WHEN dir LIKE '%/%' THEN concat('module::', regexp_replace(dir, '/[^/]*$', '')) END AS parent FROM dirs
UNION ALL SELECT n.id, coalesce(i.parent, CASE WHEN n.path LIKE '%/%' THEN concat('module::', regexp_replace(n.path, '/[^/]*$', '')) END) FROM nodes n LEFT JOIN inner_ i ON n.id = i.id""")
def module_parents(g: Graph) -> DataFrame:
    """The parent of each module of a directory and of each node: what contains it, else its directory."""
    parts = g.nodes.filter("path like '%/%'").select("path").distinct().select(F.split("path", "/").alias("p"))
    dirs = parts.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.array_join(F.slice("p", F.lit(1), i), "/"))).alias("dir")).distinct()
    above = lambda c: F.when(F.contains(F.col(c), F.lit("/")), F.concat(F.lit("module::"), F.regexp_replace(c, "/[^/]*$", "")))
    mods = dirs.select(F.concat(F.lit("module::"), "dir").alias("id"), above("dir").alias("parent"))
    own = g.nodes.select("id", "path").join(T.first_parent(g.edges), "id", "left")
    return mods.unionAll(own.select("id", F.coalesce("parent", above("path")).alias("parent")))


@query("focus_subgraph", f"""WITH p AS (SELECT DISTINCT from_id, to_id FROM edges WHERE kind = 'contains'), r(id) AS (SELECT id FROM nodes WHERE kind = 'file' AND path = 'src/n3/lib.rs' UNION SELECT p.to_id FROM r JOIN p ON r.id = p.from_id),
h AS (SELECT id FROM r UNION SELECT e.to_id FROM edges e JOIN r ON e.from_id = r.id UNION SELECT e.from_id FROM edges e JOIN r ON e.to_id = r.id),
s AS (SELECT id FROM h UNION SELECT e.to_id FROM edges e JOIN h ON e.from_id = h.id WHERE e.kind IN {literals(K.SEMANTIC)}) SELECT s.id FROM s JOIN nodes n ON s.id = n.id""", recursive=True)
def focus_subgraph(g: Graph) -> DataFrame:
    """A file with all that it contains, one hop around, and one semantic hop further."""
    inner = T.closure(T.adjacency(g.edges, ["contains"]), g.nodes.filter("kind = 'file' and path = 'src/n3/lib.rs'"))
    around = T.neighbours(g.edges, inner)
    further = T.neighbours(g.edges.filter(F.col("kind").isin(K.SEMANTIC)), around, backward=False)
    return further.join(g.nodes.select("id"), "id", "left_semi")


@query("focus_card", """WITH x AS (SELECT CASE WHEN from_id = 'python::lib/p4.py::part_4' THEN to_id ELSE from_id END AS other, kind FROM edges WHERE from_id = 'python::lib/p4.py::part_4' OR to_id = 'python::lib/p4.py::part_4'),
b AS (SELECT other, max(CASE kind WHEN 'declares_verification' THEN 5 WHEN 'persists_to' THEN 4 WHEN 'calls' THEN 3 WHEN 'references' THEN 3 WHEN 'contains' THEN 2 ELSE 1 END) AS priority FROM x WHERE other <> 'python::lib/p4.py::part_4' GROUP BY 1)
SELECT row_number() OVER (ORDER BY priority DESC, other) AS place, other, CAST(priority AS BIGINT) AS priority FROM b QUALIFY place <= 24""")
def focus_card(g: Graph) -> DataFrame:
    """The canvas of a hit: its 24 neighbours of the highest edge priority, then by id."""
    near = S.card(g.edges, "python::lib/p4.py::part_4")
    return placed(near, [F.col("priority").desc(), F.col("other")], 24).select("place", "other", "priority")


@query("overview_view", "SELECT id FROM nodes WHERE kind IN ('rust_module', 'module') AND id NOT IN (SELECT to_id FROM edges WHERE kind = 'contains')")
def overview_view(g: Graph) -> DataFrame:
    return R.visible(g.nodes, g.edges, "overview")


@query("context_pack", """WITH i AS (SELECT from_id AS id, kind AS role FROM edges WHERE to_id = 'req::Brand#7' AND kind IN ('declares_implementation', 'declares_verification')), src AS (SELECT p_partkey, concat('lib/p', p_partkey % 40, '.py') AS file, p_partkey AS at FROM part)
SELECT i.id, i.role, n.path, n.start_line, least(n.end_line, n.start_line + 39) AS end_line FROM i JOIN nodes n ON i.id = n.id WHERE n.start_line IS NOT NULL""")
def context_pack(g: Graph) -> DataFrame:
    """What an agent reads for a requirement: the spans of its implementations and tests, 40 lines of each at most."""
    near = g.edges.filter("to_id = 'req::Brand#7' and kind in ('declares_implementation', 'declares_verification')").select(F.col("from_id").alias("id"), F.col("kind").alias("role"))
    spans = near.join(g.nodes.select("id", "path", "start_line", "end_line"), "id").filter("start_line is not null")
    return spans.select("id", "role", "path", "start_line", F.least("end_line", F.col("start_line") + 39).alias("end_line"))


@query("slice", """WITH i AS (SELECT from_id AS id, kind AS role FROM edges WHERE to_id = 'req::Brand#7' AND kind IN ('declares_implementation', 'declares_verification', 'documents')), f AS (SELECT DISTINCT e.to_id AS id FROM edges e JOIN i ON e.from_id = i.id WHERE i.role = 'declares_implementation' AND e.kind IN ('calls', 'references') AND e.to_id NOT IN (SELECT id FROM i))
SELECT id, role FROM i UNION SELECT id, 'fan_out' FROM f""")
def slice_(g: Graph) -> DataFrame:
    """A requirement's implementations, tests and documents, and what the first call."""
    inner = g.edges.filter("to_id = 'req::Brand#7'").filter(F.col("kind").isin("declares_implementation", "declares_verification", "documents")).select(F.col("from_id").alias("id"), F.col("kind").alias("role")).distinct()
    impl = inner.filter("role = 'declares_implementation'").select(F.col("id").alias("from_id"))
    out = g.edges.filter(F.col("kind").isin("calls", "references")).join(impl, "from_id", "left_semi").select(F.col("to_id").alias("id")).distinct()
    return inner.unionAll(out.join(inner, "id", "left_anti").select("id", F.lit("fan_out").alias("role")))


@query("communities")
def communities(g: Graph) -> DataFrame:
    """Louvain modules of the graph of files (sequential by definition; no SQL)."""
    return C.communities(file_graph(g))


@query("business_modules")
def business_modules(g: Graph) -> DataFrame:
    """The modules that a proposal starts from: communities, large ones split again (no SQL)."""
    return C.communities(file_graph(g), refine=True)
