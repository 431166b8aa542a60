"""Tokenisers, lexers, parsers, ranking and the ledger."""

import random
import re
import time

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from latticework.functions import lexers, text
from latticework.operators import ledger as L
from latticework.operators import search as S
from latticework.plans import catalogue
from latticework.sources import parsers as P


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("ident,parts", [("HTTPServer", ["httpserver"]), ("v2Api", ["v2api"]), ("sign_in.user-x", ["sign", "in", "user"]), ("é", ["é"]), ("AuthService.signIn", ["auth", "service", "sign", "in"]), ("", [])])
def test_split_identifier(spark, ident, parts):
    assert one(spark, ident, text.split_identifier) == parts


def test_tokenisers_disagree_by_design(spark):
    assert one(spark, "错位竞争 byte_x é caféX a byte_x", text.tokenise_keywords) == ["错位", "位竞", "竞争", "byte_x", "é", "caf"]
    assert one(spark, "错位竞争 byteX 界", text.fts_tokens) == ["错位", "位竞", "竞争", "byte", "界"]
    assert one(spark, "cafés bar", text.fts_tokens) == ["caf", "bar"]
    assert one(spark, "a bb a bb", text.tokenise_keywords) == ["bb"]
    assert one(spark, "Ab.cD_e", text.compact_segments) == ["ab", "cd_e"]
    assert len(one(spark, " ".join(f"tok{i}" for i in range(40)), text.query_tokens)) == 24


def test_bm25_ranks_rare_and_short(spark):
    docs = spark.createDataFrame([("a", "alpha beta"), ("b", "alpha alpha alpha beta gamma delta"), ("c", "beta beta"), ("d", "")], "id string, body string")
    index = text.postings(docs, "id", "body")
    assert [r.id for r in text.bm25(index, 4, 2.5, ["alpha"], False).collect()] == ["b", "a"]
    assert {r.id for r in text.bm25(index, 4, 2.5, ["alpha", "beta"], True).collect()} == {"a", "b"}


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=120))
def test_lexers_are_total(body):
    assert len(lexers.strip_noise(body)) == len(body)
    tokens = lexers.normalise(body)
    assert 0 <= lexers.simhash(tokens) < 1 << 64 and lexers.token_hash(tokens) == lexers.token_hash(list(tokens))


def test_index_tokens_of_long_and_odd_bodies(spark):
    def parts(run):
        return [p.lower() for p in re.sub("(?<=[a-z])(?=[A-Z])|_", " ", run).split() if len(p) >= 2]

    draw = random.Random(5)
    bodies = ["".join(draw.choices("abzAZ09_ .-é中", k=60)) for _ in range(80)] + ["aB1cD2" * 20000, "a1" * 40000, "", None, "中", "中文字 a中文b"]
    got = {r.i: r.t for r in spark.createDataFrame(list(enumerate(bodies)), "i int, b string").select("i", text.fts_tokens(F.col("b")).alias("t")).collect()}
    for i, b in enumerate(bodies):
        runs = re.findall("[A-Za-z0-9_]+|[\u4e00-\u9fff]+", b or "")
        want = [t for r in runs for t in (parts(r) if r[0] < "\u4e00" else [r[j : j + 2] for j in range(max(len(r) - 1, 1))])]
        assert got[i] == (None if b is None else want), b


def test_asked_postings_are_those_of_the_index(spark):
    docs = spark.createDataFrame([(1, "the fooBar the"), (2, "foo the"), (2, "bar foo"), (3, "x"), (4, None), (5, "license bar")], "d long, b string")
    index, n, mean = text.asked(docs, "d", "b", ["the", "foo", "none"])
    assert {(r.id, r.token, r.tf, r.length) for r in index.collect()} == {(1, "the", 2, 4), (1, "foo", 1, 4), (2, "foo", 2, 4), (2, "the", 1, 4)}
    assert (n, mean) == (3, 10 / 3)


def test_bodies_alike_are_hashed_once(spark):
    lexers.marks_of.cache_clear()
    rows = [lexers.marks_of(tuple(lexers.normalise(f"def f{i}(x):\n  return {i}"))) for i in range(50)]
    assert len(set(rows)) == 1 and lexers.marks_of.cache_info().misses == 1


def test_normaliser():
    a = lexers.normalise("def f(x):  # note\n  return g('a', 10) + x.y")
    b = lexers.normalise('def other(zz):\n  return h("longer", 0xFF) + q.r')
    assert a == b and "STR" in a and "NUM" in a and "return" in a
    assert lexers.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    assert lexers.strip_noise("x = 'ab' # c\ny") == "x = '  '    \ny"


def test_literals(spark):
    got = spark.createDataFrame([("x = 'a'\nif true: y = 1.5",)], "b string").select(F.explode(lexers.literals("b")).alias("l")).select("l.*").collect()
    assert {tuple(r) for r in got} == {("string", "'a'", 1), ("bool", "true", 2), ("number", "1.5", 2)}


DIFF = """diff --git a/x.py b/x.py
--- a/x.py
+++ b/x.py
@@ -1,2 +3,4 @@ def f
+a
@@ -9 +12,0 @@
-b
diff --git a/n.md b/n.md
new file mode 100644
@@ -0,0 +1 @@
+z
diff --git a/gone b/gone
deleted file mode 100644"""


def test_diff_parser(spark):
    got = {tuple(r)[1:] for r in P.parse_diffs(spark.createDataFrame([(1, DIFF), (2, "")], "id int, diff string")).collect()}
    assert got == {("x.py", "modified", 3, 6), ("x.py", "modified", 12, 12), ("n.md", "added", 1, 1), ("gone", "deleted", None, None)}


MARKDOWN = """# REQ-1 First one
- docs: a.md, b.md
```
# not a heading
- tests: nope
```
- implementations: x.py#f
## Part ##
text
# Other
- tests: y"""


def test_headings_and_requirements(spark):
    table = spark.createDataFrame([("d.md", MARKDOWN)], "path string, text string")
    assert [(r.at, r.level, r.title, r.end_at) for r in P.headings(table).orderBy("at").collect()] == [(1, 1, "REQ-1 First one", 9), (8, 2, "Part", 9), (10, 1, "Other", 11)]
    refs = {(r.requirement, r.relation, r.target) for r in P.requirements(table).collect()}
    assert {("REQ-1", "documents", "a.md"), ("REQ-1", "documents", "b.md"), ("REQ-1", "declares_implementation", "x.py#f")} <= refs
    assert not any(t == "y" for *_, t in refs)


def _sections(body):
    """Headings of a text by a scan, and the references of its requirements."""
    heads, items, fenced = [], [], False
    rows = body.split("\n")
    for at, line in enumerate(rows, 1):
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        elif not fenced and (m := re.match(r"(#{1,6})\s+(\S.*)", line)):
            heads.append([at, len(m[1]), m[2].rstrip().rstrip("#").rstrip(), len(rows)])
        elif not fenced and (m := re.match(r"\s*[-*]\s*(docs|implementation|test)s?\s*:\s*(\S.*)", line)):
            items += [(at, m[1], t.strip()) for t in m[2].split(",")]
    for i, h in enumerate(heads):
        h[3] = next((at - 1 for at, level, *_ in heads[i + 1 :] if level <= h[1]), len(rows))
    names = {"docs": "documents", "implementation": "declares_implementation", "test": "declares_verification"}
    refs = [(*(t.split(" ", 1) + [""])[:2], names[w], x) for top, _, t, end in heads if re.match(r"[A-Z][A-Z0-9]*-\d", t) for at, w, x in items if top < at <= end]
    return [(*h[:3], [g[2] for g in heads[: i + 1]].count(h[2]), h[3]) for i, h in enumerate(heads)], refs


def test_headings_and_requirements_of_all_documents(spark, tmp_path):
    draw = random.Random(5)
    bank = ["# REQ-1 One", "# REQ-2", "## Part ##", "### Part", "# Other", "#none", "```", "~~~ x", "- docs: a.md, b.md", "* tests: t ", "- implementations: x.py#f\r", "# Last\r", "text", ""]
    texts = {i: "\n".join(draw.choice(bank) for _ in range(draw.randrange(1, 40))) for i in range(60)} | {60: MARKDOWN}
    spark.createDataFrame([*texts.items(), (61, None)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    both = {i: _sections(t) for i, t in texts.items()}
    for name, columns, want in (("headings", "doc_id, row_no, level, title, nth, end_at", [(i, *h) for i, (hs, _) in both.items() for h in hs]), ("requirements", "doc_id, requirement, title, relation, target", [(i, *r) for i, (_, rs) in both.items() for r in rs])):
        assert len(want) > 50
        assert sorted(map(tuple, catalogue.queries()[name](spark, str(tmp_path)).select(*columns.split(", ")).collect())) == sorted(want)
        assert sorted(con.sql(f"select {columns} from ({catalogue.oracle_sql()[name]})").fetchall()) == sorted(want)


def test_slugs_of_whole_documents(spark, tmp_path):
    spark.createDataFrame([(1, "-- A title " + "x" * 40 + " and THE end! "), (2, "é"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.slug for r in catalogue.queries()["slugs"](spark, str(tmp_path)).collect()}
    assert got == {1: "a-title-" + "x" * 40 + "-and-the-end", 2: "", 3: None}


def test_reference_parsers(spark):
    assert one(spark, "WITH r AS (SELECT 1) SELECT * FROM Users u JOIN r ON 1 LEFT JOIN db.Orders; insert into log values (1) on duplicate key update x = 2", P.sql_table_refs) == ["users", "db.orders", "log"]
    assert [tuple(r) for r in one(spark, "see `src/a.py`, `b.md`, `Foo::bar()` and `x + y`", P.inline_refs)] == [("src/a.py", "path"), ("b.md", "file"), ("Foo::bar()", "symbol"), ("x + y", "none")]
    assert one(spark, "a['k'] + d.get(\"m.n\", 1)", P.json_keys) == ["k", "m.n"]
    assert tuple(one(spark, '@GetMapping("/users/{id}")', P.http_routes)) == ("GET", "/users/{id}")
    assert tuple(one(spark, "app.post('/x', handler)", P.http_routes)) == ("POST", "/x")
    assert one(spark, "plain text", P.http_routes) is None


def test_search_tiers_and_boosts(spark):
    n = spark.createDataFrame([("order", "file", "x/a", "zz"), ("b", "python_class", "lib/order/b.py", "B"), ("c", "python_function", "lib/c.py", "makeOrder"), ("t", "test_case", "x/t.py", "orderTest"), ("d", "python_function", "tools/d.py", "order"), ("e", "requirement", "order/e", "order")], "id string, kind string, path string, name string")
    scores = {r.id: r.score for r in S.structural(n, ["order"]).collect()}
    assert scores == {"order": 100, "b": 60, "c": 50, "t": 45, "d": 80}
    e = spark.createDataFrame([("1", "c", "z", "calls", "language_adapter", "fact", "confirmed", "scip"), ("2", "b", "t", "references", "language_adapter", "fact", "confirmed", None)], "id string, from_id string, to_id string, kind string, source string, certainty string, status string, indexer string")
    ranked = [(r.id, r.score) for r in S.ranked(S.structural(n, ["order"]), e).collect()]
    assert ranked == [("order", 100), ("b", 80), ("c", 80), ("t", 65), ("d", 60)]


def test_schema_parsers(spark):
    ddl = "create table if not exists a.B (id int, `n` varchar(10) default 'x,y', d decimal(3, 1),\n unique (id, n), key k (n)); CREATE TABLE c(x int"
    rows = P.table_columns(spark.createDataFrame([(1, ddl), (2, None), (3, "")], "k int, t string"), "k", "t").collect()
    assert sorted((r.table, r.position, r.name, r.definition) for r in rows) == [("a.B", 1, "id", "int"), ("a.B", 2, "n", "varchar(10) default 'x,y'"), ("a.B", 3, "d", "decimal(3, 1)")]
    xml = '<mapper namespace="n.M"><sql id="b">from t1</sql><sql id="a"><include refid="b"/> join t2</sql><select id="s">select 1 <include refid="a" /></select><delete id="d">delete from t3 where x = $x</delete><selectKey id="no">x</selectKey></mapper>'
    got = {(r.id, r.verb, r.sql) for r in P.mapper_statements(spark.createDataFrame([(1, xml), (2, "<select id='q'>x</select>")], "k int, x string"), "k", "x").collect()}
    assert got == {("s", "select", "select 1 from t1 join t2"), ("d", "delete", "delete from t3 where x = $x")}
    for line, want in (("await dio.get<T>('/a/$id/b?x=1')", ("GET", "/a/:param/b")), ("cache.get('key')", None), ('http.post("/x#y", 1)', ("POST", "/x"))):
        r = one(spark, line, P.consumed_route)
        assert (tuple(r) if r else None) == want
    text = "version: 1\nrequirements:\n  REQ-1:\n    docs: [a.md, 'b.md']\n    implementation:\n      - x.py#f\n\n    # no\n    tests:\n      - t\n  REQ-2:\n    tests: []\nother:\n  REQ-9:\n    docs: [z]\n"
    got = {(r.requirement, r.relation, r.target) for r in P.links_manifest(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").collect()}
    assert got == {("REQ-1", "documents", "a.md"), ("REQ-1", "documents", "b.md"), ("REQ-1", "declares_implementation", "x.py#f"), ("REQ-1", "declares_verification", "t")}
    assert {tuple(r) for r in P.port_map(spark.createDataFrame([("# c\na: b\n 'x y' : \"z\"\n\nbad",)], "t string"), "t").collect()} == {("a", "b"), ("x y", "z")}
    assert [tuple(r) for r in one(spark, "a['k'] + d.get(\"m\", 1) + d.get('n')", P.json_reads)] == [("k", None), ("m", "1"), ("n", None)]


def test_spans(spark):
    rows = [(["a", "// one", "# two", "def f", "x"], 4, 5), (["#include <x>", "def f"], 2, 9), (["# n"] * 60 + ["f"], 61, 61), (["é" * 9000], 1, 1), (["a"], 5, 9), (["# c", "a"], 0, 1)]
    got = [r.s for r in spark.createDataFrame(rows, "l array<string>, a int, b int").select(P.span(F.col("l"), F.col("a"), F.col("b")).alias("s")).collect()]
    assert got[0] == "// one\n# two\ndef f\nx" and got[1] == "def f" and got[2].count("# n") == 40 and got[3] == "é" * 4000 and got[4] == "" and got[5] == "# c"
    assert [r.s for r in spark.createDataFrame(rows[:1], "l array<string>, a int, b int").select(P.span(F.col("l"), F.col("a"), F.col("b"), comments=False).alias("s")).collect()] == ["def f\nx"]


def test_checks_and_levels(spark):
    from latticework.operators import checks

    assert [checks.severity(x) for x in ("error", " WARN", "info", "off", "None", "ignore", "loud")] == ["error", "warning", "info", None, None, None, "warning"]
    n = spark.createDataFrame([("r1", "requirement"), ("r2", "requirement"), ("r3", "requirement"), ("f", "python_function"), ("t", "test_case")], "id string, kind string")
    e = spark.createDataFrame([("1", "f", "r1", "declares_implementation"), ("2", "f", "r2", "declares_implementation"), ("3", "t", "r2", "declares_verification"), ("4", "f", "gone", "documents"), ("5", "f", "gone", "calls")], "id string, from_id string, to_id string, kind string")
    levels = {"broken_link": "error", "orphan_requirement": "info"}
    assert {tuple(r) for r in checks.consistency(n, e, levels).collect()} == {("broken_link", "error", "f", 1), ("missing_linked_test", "warning", "r1", 1), ("orphan_requirement", "info", "r3", 1)}
    assert {r.code for r in checks.consistency(n, e, {"broken_link": "off"}).collect()} == {"missing_linked_test", "orphan_requirement"}


def test_ignore_patterns(spark):
    from latticework.functions import exprs

    paths = ["a/b.log", "keep.log", "build/x", "src/build/y", "docs/a/b.md", "top.txt", "src/top.txt", "x/node_modules/y"]
    match = exprs.ignored(F.col("p"), ["# c", "", "*.log", "!keep.log", "build/", "docs/**/b.md", "/top.txt", "node_modules"])
    got = {r.p for r in spark.createDataFrame([(p,) for p in paths], "p string").filter(match).collect()}
    assert got == {"a/b.log", "build/x", "src/build/y", "docs/a/b.md", "top.txt", "x/node_modules/y"}


def test_similarity_clusters_against_pairs(spark):
    from latticework.operators import similar

    rows = [(1, 10, 0b0), (2, 14, 0b111), (3, 12, 0b111), (4, 9, 0xFFFF << 40), (5, 8, (0xFFFF << 40) | 1), (6, 30, -1)]
    marks = spark.createDataFrame(rows, "id long, tokens int, simhash long")
    clusters = similar.near_clusters(marks, 3)
    got = {r.cluster: (r.members, r.tokens, r.similarity) for r in similar.cluster_stats(marks, clusters).collect()}
    assert got == {1: (3, 12, 1 - 3 / 64), 4: (2, 9, 1 - 1 / 64)}


def test_commit_is_all_or_none(spark, tmp_path):
    from latticework.operators import ledger, store

    folder = f"file://{tmp_path}/store"
    assert store.current(spark, folder) is None
    a = spark.createDataFrame([(1,)], "x int")
    first = store.commit({"n": a, "e": a}, folder)
    assert store.current(spark, folder) == first
    with pytest.raises(Exception):
        store.commit({"n": a, "e": a.select(F.raise_error(F.lit("stop")).alias("x"))}, folder)
    assert store.current(spark, folder) == first
    second = store.commit({"n": a.union(a), "e": a}, folder)
    assert store.current(spark, folder) == second and spark.read.parquet(f"{second}/n").count() == 2
    one_row = spark.createDataFrame([("a", 1, 2, True, {"n": 1})], ledger.SCHEMA)
    ledger.append(one_row, f"{folder}/ledger")
    ledger.append(one_row, f"{folder}/ledger")
    assert ledger.read_ledger(spark, f"{folder}/ledger").count() == 2


def test_code_tokens_and_candidates(spark):
    from latticework.functions import text

    assert one(spark, "foo.barBaz('Say it') # lib/a_b.py", text.tokenise_code) == ["say", "it", "foo", "barbaz", "bar", "baz", "lib", "a_b", "py", "a_b.py"]
    c = spark.createDataFrame([("one", "syncJob", "does sync and job"), ("two", None, None)], "id string, name string, description string")
    assert {tuple(r) for r in S.score_candidates(c, ["sync", "does", "and", "on"]).collect()} == {("one", 50 + 40 + 10)}


def test_ledger_batch_and_stream(spark, tmp_path):
    (tmp_path / "l").mkdir()
    lines = ['{"command":"a","ts_unix_ms":1000,"duration_ms":10,"ok":true,"metrics":{"n":2}}', "broken", '{"command":"a","ts_unix_ms":61000,"duration_ms":30,"ok":false,"metrics":{"n":3}}', '{"command":"b","ts_unix_ms":2000,"duration_ms":5,"ok":true,"metrics":null}']
    (tmp_path / "l" / "x.jsonl").write_text("\n".join(lines))
    table = L.read_ledger(spark, str(tmp_path / "l")).filter("command is not null")
    assert {tuple(r) for r in L.summarise(table).collect()} == {("a", 2, 1, 40, 20.0, 30), ("b", 1, 0, 5, 5.0, 5)}
    assert {tuple(r) for r in L.metric_sums(table).collect()} == {("a", "n", 5)}
    stream = spark.readStream.schema(L.SCHEMA).json(str(tmp_path / "l")).filter("command is not null")
    out = L.windowed(stream, F.timestamp_millis("ts_unix_ms"), "1 minute", late="10 minutes")
    q = out.writeStream.outputMode("complete").format("memory").queryName("ledger_test").start()
    q.processAllAvailable()
    q.stop()
    time.sleep(0.1)
    assert {(r.command, r.calls, r.total_ms) for r in spark.sql("select * from ledger_test").collect()} == {("a", 1, 10), ("a", 1, 30), ("b", 1, 5)}


def test_facts_and_suggestions(spark):
    from latticework.operators import facts as A

    body = "def f(x):\n  # if return\n  s = 'if'\n  for i in x:\n    if i == None: raise E\n  return open(p)"
    rows = spark.createDataFrame([("a", body), ("b", "x + 1"), ("c", None)], "id string, body string")
    got = {r.id: r for r in A.symbol_facts(rows).collect()}
    a = got["a"]
    assert (a.branches, a.loops, a.early_returns, a.throws, a.null_checks, a.comparisons) == (1, 1, 1, 1, 1, 1)
    assert (a.purity, a.impurity) == ("impure", ["io"]) and got["b"].purity == "pure" and got["c"].purity == "unknown"
    names = {r.suggestion for r in A.suggest_tests(A.symbol_facts(rows)).filter("id = 'a'").collect()}
    assert names == {"smoke", "branch", "boundary", "null", "error", "loop", "dependency"}


@pytest.mark.parametrize("decorator,role", [("router.get('/x')", "fastapi_route"), ("bp.route('/')", "flask_route"), ("shared_task", "background_task"), ("click.command()", "cli_command"), ("app.middleware('http')", "asgi_infrastructure"), ("field_validator('x')", "pydantic_validator"), ("dataclass", "data_class"), ("property", None)])
def test_framework_roles(spark, decorator, role):
    from latticework.operators.facts import framework_role

    assert one(spark, decorator, framework_role) == role


def test_watched_files(spark, tmp_path):
    from latticework.streaming import watch

    folder = tmp_path / "seen"
    folder.mkdir()
    step = lambda n, rows: (folder / f"{n}.json").write_text("".join('{"path":"%s","hash":%s,"at":"2024-01-01T00:00:%02dZ"}\n' % (p, f'"{h}"' if h else "null", t) for p, h, t in rows))
    stream = spark.readStream.schema("path string, hash string, at timestamp").option("maxFilesPerTrigger", 1).json(str(folder))
    q = watch.file_changes(stream).writeStream.outputMode("append").format("memory").queryName("watch_test").option("checkpointLocation", f"file://{tmp_path}/state").start()
    for n, rows in enumerate([[("a", "1", 1), ("b", "1", 1)], [("a", "1", 2), ("b", "2", 3), ("b", None, 4)], [("b", "3", 5), ("c", None, 5)]]):
        step(n, rows)
        q.processAllAvailable()
    q.stop()
    got = sorted((r.path, r.change, r.at.second) for r in spark.sql("select * from watch_test").collect())
    assert got == [("a", "added", 1), ("b", "added", 1), ("b", "added", 5), ("b", "deleted", 4), ("b", "modified", 3)]
