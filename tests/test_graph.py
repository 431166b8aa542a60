"""Small graphs with the traps that the graph operators must get right."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from latticework.functions import exprs
from latticework.functions import kinds as K
from latticework.operators import communities, joins, reach, similar, store
from latticework.operators import traverse as T
from latticework.plans import catalogue
from latticework.sources.derived import VIEWS, Graph

FOLDER = "/root/testdata/sf0.001"

def edges(spark, pairs, kind="calls"):
    rows = [(f"e{i}", a, b, k[0] if k else kind) for i, (a, b, *k) in enumerate(pairs)]
    return spark.createDataFrame(rows, "id string, from_id string, to_id string, kind string")


def nodes(spark, rows):
    return spark.createDataFrame([(i, k, p, n) for i, k, p, n in rows], "id string, kind string, path string, name string")


def test_bfs_on_chain_diamond_cycle_and_loop(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "a"), ("d", "d"), ("d", "gone")])
    seeds = spark.createDataFrame([("a",)], "id string")
    depth = {r.id: r.depth for r in T.bfs(T.adjacency(e), seeds).collect()}
    assert depth == {"a": 0, "b": 1, "c": 1, "d": 2, "gone": 3}
    assert {r.id for r in T.bfs(T.adjacency(e), seeds, 1).collect()} == {"a", "b", "c"}
    assert [r.id for r in T.bfs(T.adjacency(e), seeds, None, 3).collect()] == ["a", "b", "c"]
    assert {r.id for r in T.closure(T.adjacency(e, reverse=True), spark.createDataFrame([("c",)], "id string")).collect()} == {"a", "b", "c", "d"}


def test_expand_keeps_inner_edges(spark):
    e = edges(spark, [("a", "b"), ("c", "b"), ("c", "d"), ("d", "e")])
    seen, inner = T.expand(e, spark.createDataFrame([("b",)], "id string"), ["calls"], 1)
    assert {r.id for r in seen.collect()} == {"a", "b", "c"}
    assert {(r.from_id, r.to_id) for r in inner.collect()} == {("a", "b"), ("c", "b")}


def test_label_components(spark):
    draw = random.Random(2)
    pairs = [(f"n{draw.randrange(60):02d}", f"n{draw.randrange(60):02d}") for _ in range(45)] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(30)]
    pairs = [p for p in pairs if p[0] != p[1]]
    up = {n: n for p in pairs for n in p}
    for _ in up:
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    got = {r.id: r.root for r in T.label_components(spark.createDataFrame(pairs, "src string, dst string")).collect()}
    assert got == up


@pytest.mark.parametrize("chunk,clash", [(4, False), (4, True), (1 << 20, False)])
def test_components_in_few_rounds(spark, monkeypatch, chunk, clash):
    from latticework.operators import contract

    rounds, counted = [], contract.counted
    monkeypatch.setattr(contract, "CHUNK", chunk)
    monkeypatch.setattr(contract, "counted", lambda *a: rounds.append(1) or counted(*a))
    if clash:
        monkeypatch.setattr(T, "_number", lambda c: F.pmod(F.xxhash64(c), F.lit(50)))
    # a chain of 300 in the order of its ids, a star, a loop: the chain took as many rounds as its logarithm, each over all ids
    pairs = [(f"a{i:03d}", f"a{i + 1:03d}") for i in range(300)] + [(f"b{i}", "b9") for i in range(9)] + [("c", "c")]
    got = {r.id: r.root for r in T.label_components(spark.createDataFrame(pairs, "src string, dst string")).collect()}
    assert got == {x: {"a": "a000", "b": "b0", "c": "c"}[x[0]] for p in pairs for x in p} and len(rounds) <= (20 if chunk == 4 else 1)


def test_call_components_take_every_call(spark):
    edges = Graph(spark, FOLDER).edges.filter("kind = 'calls'").select("from_id", "to_id").collect()
    up = {n: n for e in edges if e.from_id != e.to_id for n in e}

    def root(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r.id: r.root for r in catalogue.queries()["components"](spark, FOLDER).collect()}
    assert got == {n: root(n) for n in up}
    assert any(n.startswith("python::app") for n in got)


def test_ancestors_take_the_first_parent(spark):
    e = edges(spark, [("f", "c", "contains"), ("x", "c", "contains"), ("m", "f", "contains")])
    got = {(r.ancestor, r.hop) for r in T.ancestors(e, spark.createDataFrame([("c",)], "id string")).collect()}
    assert got == {("f", 1), ("m", 2)}


def test_claims_go_to_the_higher_score(spark):
    pairs = spark.createDataFrame([("s", "x"), ("t", "x"), ("t", "y"), ("y", "z")], "src string, dst string")
    seeds = spark.createDataFrame([("s", 5, 1), ("t", 9, 2)], "id string, score int, rank int")
    assert {r.id: r.seed for r in T.claim(pairs, seeds, 2).collect()} == {"s": "s", "t": "t", "x": "t", "y": "t", "z": "t"}


def test_dead_code(spark):
    n = nodes(spark, [
        ("main", "python_function", "a.py", "main"), ("used", "python_function", "a.py", "used"), ("isle_a", "python_function", "a.py", "isle_a"), ("isle_b", "python_function", "a.py", "isle_b"),
        ("_gone", "python_function", "a.py", "_gone"), ("open", "python_function", "a.py", "open"), ("helper", "python_function", "tests/a.py", "helper"), ("tool", "python_function", "tools/x.py", "_t"),
        ("box", "java_class", "B.java", "Box"), ("live", "java_method", "B.java", "live"), ("file", "file", "B.java", "B.java"), ("t", "test_case", "tests/t.py", "t"),
    ])
    e = edges(spark, [("main", "used"), ("isle_b", "isle_a"), ("isle_a", "isle_b"), ("box", "live", "contains"), ("file", "box", "contains"), ("t", "live")])
    got = {r.id: (r.confidence, r.inbound, r.live_inbound) for r in reach.dead_code(n, e).collect()}
    assert got == {"isle_a": ("low", 1, 0), "isle_b": ("low", 1, 0), "_gone": ("high", 0, 0), "open": ("medium", 0, 0)}
    public = {r.id: r.confidence for r in reach.dead_code(n, e, ("a.*",)).collect()}
    assert public["_gone"] == "medium"


def test_entry_names(spark):
    rows = [("go_function", "TestX", True), ("go_function", "Testing", False), ("go_method", "T.init", True), ("java_method", "A.toString", True), ("java_method", "A.run", False), ("python_method", "C.__init__", True), ("rust_function", "main", True), ("c_function", "WinMain", True), ("route", "r", True), ("swift_method", "A.testIt", True), ("dart_method", "W.build", True), ("dart_function", "build", False)]
    table = nodes(spark, [(str(i), k, "lib/x", n) for i, (k, n, _) in enumerate(rows)])
    assert [r.e for r in table.orderBy(F.col("id").cast("int")).select(reach.implicit_entry().alias("e")).collect()] == [e for *_, e in rows]


def test_impurity_spreads_to_callers(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("d", "a"), ("c", "e")])
    assert {r.id for r in reach.impure(e, spark.createDataFrame([("b",)], "id string")).collect()} == {"a", "b", "d"}


def tier(kind, source, certainty, status, indexer):
    if status == "deprecated" or kind == "derives_from" or source == "git_diff":
        return "low"
    if kind in ("contains", "imports") or (kind, source) == ("documents", "markdown") or (kind.startswith("declares") and source == "external_manifest"):
        return "high"
    if kind in K.SEMANTIC:
        precise = indexer and (indexer.endswith("_lsp") or indexer in ("dart_analyzer", "scip") or indexer.startswith("scip:"))
        return "high" if certainty == "declared" or precise else "medium"
    return "medium"


def test_edge_tiers(spark):
    rows = list(itertools.product(K.EDGE_KINDS, K.SOURCES, K.CERTAINTIES, K.STATUSES, [None, "go_lsp", "dart_analyzer", "scip", "scip:rust", "python_ast", "scipio"]))
    table = spark.createDataFrame(rows, "kind string, source string, certainty string, status string, indexer string")
    got = table.withColumn("tier", K.edge_tier(*[F.col(c) for c in table.columns])).collect()
    assert all(r.tier == tier(*r[:5]) for r in got) and len(got) == len(rows)


def test_kinds(spark):
    assert len(K.traits()) == 83 and len(K.EDGE_KINDS) == 12 and len(K.SEARCHED) == 57
    assert "rust_macro" not in K.SEARCHED and "requirement" not in K.SEARCHED and "kotlin_class" not in K.SEARCHED
    assert K.kind_traits(spark).filter("is_code").count() == len(K.CODE)
    bad = K.unknown_kinds(spark.createDataFrame([("a", "file"), ("b", "odd"), ("c", None)], "id string, kind string"))
    assert {r.id for r in bad.collect()} == {"b", "c"}
    c = spark.createDataFrame([(float("nan"),), (-1.0,), (0.5,), (float("inf"),)], "x double").select(K.confidence(F.col("x"))).collect()
    assert [r[0] for r in c] == [1.0, 0.0, 0.5, 1.0]


@pytest.mark.parametrize("path,test,aux", [("lib/a.dart", False, False), ("contest_results.py", False, False), ("a/test_x.py", True, False), ("x_test.go", True, False), ("AppUITests/x.swift", True, False), ("contests/latest.rs", False, False), ("FooTest.java", True, False), ("a\\Tests\\b.cs", True, False), ("Tools/x.py", False, True), ("src/demo/x.py", False, True), ("a.spec.ts", True, False)])
def test_path_classes(spark, path, test, aux):
    r = spark.createDataFrame([(path,)], "p string").select(exprs.is_test_path(F.col("p")), exprs.is_auxiliary_path(F.col("p"))).first()
    assert tuple(r) == (test, aux)


def test_generated_noise_and_routes(spark):
    def one(value, expr):
        return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x"))).first()[0]

    assert one("a/b.g.dart", exprs.is_generated_path) and one("l10n/app_localizations_en.dart", exprs.is_generated_path) and not one("a/bg.dart", exprs.is_generated_path)
    assert one("dart_method::lib/a.dart#A.build", exprs.leaf_method) == "build"
    assert one("java::A.java::A.build", exprs.leaf_method) == ""
    assert one("java::A.java::A.build", lambda c: exprs.leaf_method(c, True)) == "build"
    assert one("/style/app/x/getY", lambda c: exprs.route_key(c, 2)) == "x/gety"
    assert one("/x/{id}/getY", lambda c: exprs.route_key(c, 2)) == "x/gety"
    assert one("/:p/*", lambda c: exprs.route_key(c, 2)) == ""
    assert one("/Svc/<int:id>/$x", exprs.route_service) == "svc"
    assert one("__Private_x", exprs.name_key) == "private_x" and one("a_B-1", lambda c: exprs.name_key(c, True)) == "ab1"
    assert one("lib/src/a.py", lambda c: exprs.glob_match(c, ["lib/**"])) and not one("lib/src/a.py", lambda c: exprs.glob_match(c, ["lib/*"]))
    assert one("Hello,  World!", exprs.slug) == "hello-world"


def test_interval_joins(spark):
    draw = random.Random(3)
    ranges = [(f"f{draw.randrange(3)}", f"s{i}", a := draw.randrange(0, 300), a + draw.randrange(0, 200)) for i in range(80)] + [("f0", "open", None, None), ("f1", "tail", 50, None)]
    hunks = [(f"f{draw.randrange(3)}", f"h{i}", a := draw.randrange(0, 400), a + draw.randrange(0, 30)) for i in range(40)]
    r = spark.createDataFrame(ranges, "file_path string, symbol_id string, start_line bigint, end_line bigint")
    h = spark.createDataFrame(hunks, "file_path string, hunk string, new_start bigint, new_end bigint")
    want = sorted((f, s, k) for f, s, a, b in ranges for g, k, x, y in hunks if f == g and (a or 0) <= y and (b if b is not None else 1 << 40) >= x)
    hits = joins.interval_join(r, h, bucket=16)
    assert sorted((x.file_path, x.symbol_id, x.hunk) for x in hits.collect()) == want
    nested = spark.createDataFrame([("f", "outer", 1, 90, "h"), ("f", "mid", 5, 20, "h"), ("f", "same", 6, 21, "h"), ("f", "zero", 0, 3, "h")], "file_path string, symbol_id string, start_line bigint, end_line bigint, hunk string")
    assert [x.symbol_id for x in joins.innermost(nested).collect()] == ["same"]
    assert {x.symbol_id for x in joins.most_specific(nested).collect()} == {"mid", "same", "zero"}


def test_innermost_without_pairs(spark):
    draw = random.Random(4)
    ranges = [(f"f{draw.randrange(3)}", f"s{i:03d}", a := draw.choice([0, None, *range(1, 60)]), draw.choice([None, -1, *[(a or 0) + draw.randrange(0, 50)] * 6])) for i in range(160)]
    hunks = [(f"f{draw.randrange(4)}", f"h{i}", a := draw.randrange(0, 120), a + draw.choice([0, 0, 3, 40])) for i in range(80)]
    r = spark.createDataFrame(ranges, "file_path string, symbol_id string, start_line bigint, end_line bigint")
    h = spark.createDataFrame(hunks, "file_path string, hunk string, new_start bigint, new_end bigint")
    want = set()
    for g, k, x, y in hunks:
        met = [((b - a if b is not None else 1 << 40), -a, s) for f, s, a, b in ranges if f == g and a and (b is None or b >= a) and a <= y and (b is None or b >= x)]
        want |= {(g, k, min(met)[2])} if met else set()
    assert {tuple(x) for x in joins.innermost_join(r, h, bucket=16).collect()} == want


def test_equal_ranges_and_points_make_no_pairs(spark):
    r = spark.range(3000).selectExpr("'f' as file_path", "cast(id as string) as symbol_id", "7L as start_line", "20L as end_line")
    h = spark.range(3000).selectExpr("'f' as file_path", "cast(id as string) as hunk", "9L as new_start", "9L as new_end")
    out = joins.innermost_join(r, h)
    assert {x.symbol_id for x in out.collect()} == {"0"}
    assert most_rows(out) <= 6000  # 9,000,000 pairs before


def most_rows(frame, metric: str = "numOutputRows") -> int:
    """The most rows that a step of the frame's plan puts out (or has of another metric)."""
    frame.collect()
    steps, most = [frame._jdf.queryExecution().executedPlan()], 0
    while steps:
        step = steps.pop()
        found = step.metrics().get(metric)
        most = max(most, found.get().value() if found.isDefined() else 0)
        inner = step.children().toList()
        name = step.getClass().getSimpleName()
        steps += [inner.apply(i) for i in range(inner.size())]
        steps += [step.executedPlan()] if name == "AdaptiveSparkPlanExec" else [step.plan()] if name.endswith("QueryStageExec") else []
    return most


def test_most_specific_against_pairs(spark):
    draw = random.Random(8)
    rows = [(f"f{draw.randrange(2)}", f"s{i}", a := draw.randrange(0, 12), draw.choice([None, *range(a, a + 9)]), f"h{draw.randrange(3)}") for i in range(120)]
    table = spark.createDataFrame(rows, "file_path string, symbol_id string, start_line bigint, end_line bigint, hunk string")
    holds = lambda x, y: x[0] == y[0] and x[4] == y[4] and None not in (x[3], y[3]) and x[2] <= y[2] and x[3] >= y[3] and x[3] - x[2] > y[3] - y[2]
    assert sorted(r.symbol_id for r in joins.most_specific(table).collect()) == sorted(x[1] for x in rows if not any(holds(x, y) for y in rows))


def test_interval_queries_take_every_range_and_hunk(spark):
    g = Graph(spark, FOLDER)
    assert g.ranges.count() == g.table("lineitem").count() and g.hunks.count() == g.table("orders").count()
    hits = {tuple(r) for r in catalogue.queries()["interval_join"](spark, FOLDER).collect()}
    for name in ("innermost_range", "most_specific_ranges"):
        assert {r.hunk for r in catalogue.queries()[name](spark, FOLDER).collect()} == {h for *_, h in hits}


def test_graph_is_stored_by_kind(spark):
    g = Graph(spark, FOLDER)
    calls = g.edges.filter("kind = 'calls'")
    assert all("/kind=" in f for f in g.edges.inputFiles())
    assert "kind=calls" in calls._jdf.queryExecution().executedPlan().toString() or "PartitionFilters: [isnotnull(kind" in calls._jdf.queryExecution().toString()
    assert g.edges.columns == g.sql(VIEWS["edges"]).columns and sorted(map(str, g.nodes.collect())) == sorted(map(str, g.sql(VIEWS["nodes"]).collect()))


def test_edges_are_distinct_branch_by_branch(spark, tmp_path):
    from latticework.sources.derived import LEAN_EDGES

    odd = {"lineitem": "l_orderkey", "orders": "o_orderkey", "customer": "c_nationkey", "part": "p_partkey", "supplier": "s_suppkey"}
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        rows = spark.read.parquet(f"{FOLDER}/{t}.parquet").limit(800)
        again = rows.limit(60)
        again = again.unionAll(again.withColumn(odd[t], F.lit(None).cast(again.schema[odd[t]].dataType))) if t in odd else again
        rows.unionAll(again).write.parquet(f"{tmp_path}/{t}.parquet")
    g = Graph(spark, str(tmp_path))
    want = g.sql(VIEWS["edges"])
    assert g.edges.columns == want.columns and sorted(map(str, g.edges.collect())) == sorted(map(str, want.collect()))
    # no distinct over whole rows: what is shuffled for the two large branches are keys
    assert LEAN_EDGES.count("(SELECT DISTINCT l_orderkey") == 2 and "id" not in spark.read.parquet(g.edges.inputFiles()[0]).columns


@pytest.mark.parametrize("few", [0, 2, 100_000])
def test_walks_find_the_same_by_bitmap(spark, monkeypatch, few):
    from latticework.functions import tables

    monkeypatch.setattr(tables, "FEW", few)
    monkeypatch.setattr(T, "FEW", few)
    draw = random.Random(9)
    pairs = {(draw.randrange(60), draw.randrange(60)) for _ in range(90)}
    depth, ring = {0: 0, 1: 0}, {0, 1}
    while ring:
        ring = {b for a, b in pairs if a in ring} - set(depth)
        depth |= {b: max(depth.values()) + 1 for b in ring}
    frame = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in [*pairs, *pairs]], "src string, dst string")
    got = T.bfs(frame, spark.createDataFrame([("n0",), ("n1",)], "id string"))
    assert sorted((r.id, r.depth) for r in got.collect()) == sorted((f"n{a}", d) for a, d in depth.items())


def test_matching_shuffles_little_more_than_what_matches(spark, monkeypatch):
    from latticework.functions import tables

    monkeypatch.setattr(tables, "FEW", 0)
    monkeypatch.setitem(tables.__dict__, "LEAST_BITS", 1 << 16)
    rows = spark.range(20000).selectExpr("concat('n', id) as a", "id as b")
    ids = spark.range(0, 20000, 50).selectExpr("concat('n', id) as id")
    found = tables.matching(rows, "a", ids, 400)
    assert sorted(r.b for r in found.collect()) == list(range(0, 20000, 50))
    assert most_rows(found, "shuffleRecordsWritten") < 2000


def test_broken_links_do_not_shuffle_edges(spark):
    edges = spark.range(5000).selectExpr("concat('e', id) as id", "concat('n', id % 3) as from_id", "concat('n', id % 4) as to_id")
    nodes = spark.createDataFrame([("n0",), ("n1",)], "id string")
    out = joins.dangling(edges, nodes)
    want = sorted([(f"e{i}", "from") for i in range(5000) if i % 3 == 2] + [(f"e{i}", "to") for i in range(5000) if i % 4 > 1])
    assert sorted(map(tuple, out.collect())) == want and most_rows(out, "shuffleRecordsWritten") < 100


def test_diff_coverage_and_store(spark):
    base = spark.createDataFrame([("a", "x", 1), ("b", "x", 2), ("c", None, 3)], "id string, kind string, n int")
    head = spark.createDataFrame([("a", "y", 1), ("b", "x", 2), ("c", None, 4), ("d", "x", 5)], "id string, kind string, n int")
    assert {tuple(r) for r in joins.diff(base, head, "id", ["kind", "n"]).collect()} == {("a", "kind_changed"), ("c", "n_changed"), ("d", "added")}
    got = store.upsert(base, head.withColumn("seq", F.lit(1)), ["id"], "seq").collect()
    assert sorted((r.id, r.n) for r in got) == [("a", 1), ("b", 2), ("c", 4), ("d", 5)]
    table = spark.createDataFrame([("1", "p", "calls", "ast"), ("2", "p", "calls", None), ("3", "q", "calls", "ast"), ("4", "p", "contains", "ast"), ("5", "p", "calls", "scip")], "id string, from_id string, kind string, indexer string")
    assert {r.id for r in store.clear_indexer(table, "ast").collect()} == {"2", "5"}
    covered = spark.createDataFrame([("p",)], "id string")
    assert {r.id for r in store.suppress_imprecise(table, covered, "scip").collect()} == {"3", "4", "5"}
    keyed = spark.createDataFrame([("g", "k1"), ("g", "k2"), ("h", ""), ("h", "k3")], "g string, k string")
    assert {tuple(r) for r in joins.coverage(keyed, keyed.filter("k = 'k1'"), "k", "g").collect()} == {("g", 2, 1, 1, 0.5), ("h", 1, 0, 1, 0.0)}
    lines = spark.createDataFrame([("a", 2, 1), ("b", 1, 2), ("c", None, 2)], "id string, start_line int, end_line int")
    assert {r.id for r in store.valid_nodes(lines).collect()} == {"b", "c"}


def test_export(spark, tmp_path):
    store.export_jsonl(spark.createDataFrame([("a", None)], "id string, name string"), str(tmp_path / "out"))
    assert "".join(p.read_text() for p in (tmp_path / "out").glob("*.json")).strip() == '{"id":"a","name":null}'


def _moves(n, edges, resolution=1.0):
    """Louvain with plain dictionaries, as the method is told."""
    w = {}
    for a, b, x in edges:
        if x > 0:
            w[min(a, b), max(a, b)] = w.get((min(a, b), max(a, b)), 0.0) + x
    total, member = sum(w.values()), list(range(n))
    while total > 0:
        size = max(member, default=-1) + 1
        near = [{} for _ in range(size)]
        for (a, b), x in w.items():
            near[a][b] = near[b][a] = near[a].get(b, 0.0) + x if a != b else near[a].get(a, 0.0) + x
        k = [sum(x * (2 if j == i else 1) for j, x in near[i].items()) for i in range(size)]
        home, held = list(range(size)), list(k)
        for _ in range(100):
            still = True
            for i in range(size):
                links = {}
                for j, x in near[i].items():
                    if j != i:
                        links[home[j]] = links.get(home[j], 0.0) + x
                own = home[i]
                held[own] -= k[i]
                gain = {c: links.get(c, 0.0) - resolution * k[i] * held[c] / (2 * total) for c in [own, *links]}
                best = own
                for c in sorted(links):
                    if gain[c] > gain[best] + 1e-9:
                        best = c
                held[best] += k[i]
                if best != own:
                    home[i], still = best, False
            if still:
                break
        if home == list(range(size)):
            break
        order = {c: i for i, c in enumerate(dict.fromkeys(home))}
        member = [order[home[m]] for m in member]
        merged = {}
        for (a, b), x in w.items():
            key = tuple(sorted((order[home[a]], order[home[b]])))
            merged[key] = merged.get(key, 0.0) + x
        w = merged
    order = {c: i for i, c in enumerate(dict.fromkeys(member))}
    return [order[m] for m in member]


def test_louvain_against_dictionaries():
    draw = random.Random(3)
    for n in (5, 30, 80):
        edges = [(draw.randrange(n), draw.randrange(n), float(draw.choice([0, 1, 1, 2, 3]))) for _ in range(3 * n)]
        assert communities.louvain(n, edges) == _moves(n, edges)


def test_communities_of_components(spark):
    """Each component by itself moves as it does in the whole graph; large ones come apart."""
    draw = random.Random(4)
    rows = [(f"{g}{draw.randrange(25):02}", f"{g}{draw.randrange(25):02}", float(draw.randrange(1, 4))) for g in "abc" for _ in range(60)] + [("x", "y", 0.0)]
    pairs = spark.createDataFrame(rows, "a string, b string, weight double").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("weight").alias("weight"))
    held = [r for r in pairs.collect() if r.weight > 0]
    names = sorted({x for r in held for x in (r.a, r.b)})
    at = {x: i for i, x in enumerate(names)}
    want = communities.louvain(len(names), [(at[r.a], at[r.b], r.weight) for r in held])
    first = {}
    for name, c in zip(names, want):
        first.setdefault(c, name)
    assert {r.path: r.community for r in communities.communities(pairs).collect()} == {x: first[c] for x, c in zip(names, want)}
    ring = [(i, (i + 1) % 90, 1.0) for i in range(90)]
    parts = communities.refined(90, ring, 4, 90.0)
    for c, size in Counter(parts).items():
        inside = [i for i, p in enumerate(parts) if p == c]
        rest = [(inside.index(a), inside.index(b), w) for a, b, w in ring if a in inside and b in inside]
        assert size <= 4 or set(communities.louvain(size, rest)) == {0}
    assert len(set(parts)) > len(set(communities.louvain(90, ring)))


def test_neighbour_lists_in_pieces(monkeypatch):
    import numpy as np

    draw = random.Random(12)
    edges = [(draw.randrange(50), draw.randrange(50), draw.choice([1.0, 2.0, 0.1])) for _ in range(260)]
    want = _moves(50, edges), communities.refined(50, edges, 6, sum(w for *_, w in edges))
    rows = sorted([(a, b, w) for a, b, w in edges] + [(b, a, w) for a, b, w in edges if a != b] + [(i, i, 0.0) for i in range(50)])
    cut = lambda i: tuple(np.array(x, t) for x, t in zip(zip(*rows[i : i + 7]), (np.int32, np.int32, np.float64)))
    monkeypatch.setattr(communities, "AT_ONCE", 16)
    level = communities._level_of_rows([cut(i) for i in range(0, len(rows), 7)])
    # small integers take 4 bytes; nothing of the size of the graph is made of Python's numbers
    assert communities._small(np.array([1.0, 2.0])).dtype == np.float32 and communities._small(np.array([0.1])).dtype == np.float64
    assert communities._louvain(level).tolist() == want[0] and level.near.dtype == np.int32
    assert communities._refined(level, 6, sum(w for *_, w in edges)).tolist() == want[1]


def test_entries_by_path_and_by_base(spark):
    n = spark.createDataFrame(
        [("v", "swift_class", "a.swift", "MyView", '{"inherits":["BaseView"]}'), ("b", "swift_class", "a.swift", "BaseView", '{"inherits":["UIView"]}'), ("m", "swift_method", "a.swift", "draw", None), ("o", "swift_class", "b.swift", "Other", '{"inherits":["Codable"]}'), ("p", "python_function", "run.py", "_go", None), ("q", "python_function", "x.py", "_idle", None), ("r", "python_function", "x.py", "shown", None)],
        "id string, kind string, path string, name string, metadata_json string",
    )
    e = edges(spark, [("v", "m", "contains"), ("q", "r", "contains")])
    assert {r.id for r in reach.framework_types(n, e, ["UIView"]).collect()} == {"v", "b", "m"}
    dead = lambda **k: {(r.id, r.confidence) for r in reach.dead_code(n, e, **k).collect()}
    every = {("v", "medium"), ("b", "medium"), ("m", "medium"), ("o", "medium"), ("p", "high"), ("q", "high"), ("r", "medium")}
    assert dead() == every
    assert dead(entry_paths=("run.py",), framework_roots=("UIView",)) == {("o", "medium"), ("q", "high"), ("r", "medium")}
    assert dead(least="high") == {("p", "high"), ("q", "high")}


def test_budget_stops_the_walk(spark):
    chain = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(20)], "src string, dst string")
    got = T.bfs(chain, spark.createDataFrame([("n00",)], "id string"), max_nodes=4).collect()
    assert sorted((r.id, r.depth) for r in got) == [("n00", 0), ("n01", 1), ("n02", 2), ("n03", 3)]


def test_louvain():
    two = [(a, b, 1.0) for g in (range(4), range(4, 8)) for a in g for b in g if a < b] + [(3, 4, 0.5)]
    assert communities.louvain(8, two) == [0] * 4 + [1] * 4
    assert communities.louvain(3, []) == [0, 1, 2]
    assert communities.louvain(2, [(0, 0, 3.0), (0, 1, 0.1)]) in ([0, 0], [0, 1])


@pytest.mark.parametrize("radius", [0, 3, 10])
def test_near_pairs_are_all_found(spark, radius):
    draw = random.Random(radius)
    marks = [draw.getrandbits(64) for _ in range(20)]
    for m in list(marks):
        x = m
        for bit in draw.sample(range(64), 12):
            x ^= 1 << bit
            marks.append(x)
    signed = sorted({m - (1 << 64) if m >> 63 else m for m in marks})
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if bin((a ^ b) & (1 << 64) - 1).count("1") <= radius}
    table = spark.createDataFrame([(str(i), m) for i, m in enumerate(signed)], "id string, simhash bigint")
    assert {(r.src, r.dst) for r in similar.near_pairs(table, radius).collect()} == want


def test_resolution_tiers_and_caps(spark):
    from latticework.operators import resolve as R

    defs = spark.createDataFrame([("d1", "foo", "a"), ("d2", "foo", "b"), ("d3", "MakeIt", "c"), ("d4", "plain", "c")] + [(f"m{i:02d}", "many", "a") for i in range(20)] + [(f"w{i:02d}", "WideName", f"z{i}") for i in range(40)], "id string, name string, file string")
    refs = spark.createDataFrame([("r1", "foo", "a"), ("r2", "foo", "x"), ("r3", "MakeIt", "x"), ("r4", "plain", "x"), ("r5", "many", "a"), ("r6", "WideName", "x")], "ref string, name string, file string")
    imports = spark.createDataFrame([("x", "b"), ("x", "b")], "file string, target string")
    got = {}
    for r in R.resolve(refs, defs, imports).collect():
        got.setdefault(r.ref, []).append((r.target, r.tier))
    assert got["r1"] == [("d1", 1)] and got["r2"] == [("d2", 2)] and got["r3"] == [("d3", 3)]
    assert "r4" not in got and "r6" not in got and len(got["r5"]) == 16


def test_resolution_against_pairs(spark):
    from latticework.operators import resolve as R

    draw = random.Random(6)
    names = ["foo", "MakeIt", "AB_c", "x"]
    defs = [(draw.randrange(90), draw.choice(names), draw.choice([None, *range(6)])) for _ in range(110)]
    refs = [(draw.randrange(70), draw.choice([None, *names]), draw.choice([None, *range(8)])) for _ in range(90)]
    imports = [(draw.randrange(8), draw.randrange(6)) for _ in range(9)]
    want = set()
    for ref in {r for r, *_ in refs}:
        found = set()
        for _, name, file in [x for x in refs if x[0] == ref and x[1]]:
            named = [(i, at) for i, n, at in defs if n == name]
            found |= {(1, i) for i, at in named if at is not None and at == file} | {(2, i) for i, at in named if (file, at) in imports}
            found |= {(3, i) for i, _ in named if len(named) <= R.MOST_FAN_IN and name in ("MakeIt", "AB_c")}
        best = sorted((t, i) for t, i in found if t == min(found)[0])
        want |= {(ref, i, t) for t, i in best[: R.MOST_TARGETS]}
    frames = [spark.createDataFrame(rows, f"{a} bigint, {b}") for rows, a, b in ((refs, "ref", "name string, file bigint"), (defs, "id", "name string, file bigint"), (imports, "file", "target bigint"))]
    assert {tuple(r) for r in R.resolve(*frames).select("ref", "target", "tier").collect()} == want


def test_a_name_resolves_once_for_all_its_references(spark):
    from latticework.operators import resolve as R

    refs = spark.range(2000).selectExpr("id as ref", "'foo' as name", "1 as file")
    defs = spark.range(2000).selectExpr("id", "'foo' as name", "1 as file")
    out = R.resolve(refs, defs, spark.createDataFrame([(1, 2)], "file int, target int"))
    assert out.count() == 2000 * 16 and most_rows(out) <= 2000 * 16  # 4,000,000 pairs before


def test_candidates_reviews_and_views(spark):
    from latticework.operators import resolve as R

    rows = spark.createDataFrame([("ok", "A", 1), ("ok", "B", 2), ("Bad id", "C", 3), ("blank", " ", 4)], "id string, name string, seq int")
    kept, warned = R.scan_candidates(rows)
    assert [r.name for r in kept.collect()] == ["A"]
    assert {tuple(r) for r in warned.collect()} == {("ok", "duplicate id"), ("Bad id", "invalid id"), ("blank", "empty name")}
    n = nodes(spark, [("m", "rust_module", "m", "m"), ("f", "file", "f", "f"), ("r", "requirement", "r", "r"), ("p", "python_function", "p", "p")])
    e = edges(spark, [("m", "f", "contains"), ("p", "r", "declares_implementation"), ("p", "gone")])
    assert {r.id for r in R.visible(n, e, "overview").collect()} == {"m"}
    assert {r.id for r in R.visible(n, e, "business").collect()} == {"r", "p"}
    assert R.visible(n, e, "focus").count() == 4
