"""Reachability of code from its entry points, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.functions import exprs
from latticework.functions import kinds as K
from latticework.functions.tables import counted, keep, matching
from latticework.operators.traverse import adjacency, bfs, closure

# Names that frameworks and runtimes call.
LIFECYCLE = ["build", "initState", "dispose", "didChangeDependencies", "didUpdateWidget", "didChangeAppLifecycleState", "createState", "createElement", "main", "noSuchMethod", "toString", "hashCode", "==", "didChangeMetrics", "didChangePlatformBrightness", "didChangeLocales", "didHaveMemoryPressure"]
PYTHON_ENTRIES, JAVA_CONTRACT, C_ENTRIES = ["main", "__main__", "app", "cli"], ["main", "toString", "equals", "hashCode"], ["main", "wmain", "WinMain"]


def implicit_entry() -> Column:
    """Whether a node is called from outside the graph, by its kind, name and path."""
    kind, path = F.col("kind"), F.coalesce("path", F.lit(""))
    leaf = F.substring_index(F.substring_index(F.coalesce("name", F.lit("")), "#", -1), ".", -1)
    by_name = (
        F.when(kind == "dart_method", leaf.isin(LIFECYCLE))
        .when(kind == "dart_function", leaf.isin(LIFECYCLE) & exprs.is_plain_test_path(path))
        .when(kind.isin("go_function", "go_method"), leaf.isin("main", "init") | leaf.rlike(r"^(Test|Benchmark|Example)([A-Z]|\P{L}|$)"))
        .when(kind.isin("swift_function", "swift_method"), (leaf == "main") | F.startswith(leaf, F.lit("test")))
        .when(kind.isin("python_function", "python_method"), leaf.isin(PYTHON_ENTRIES) | leaf.rlike("^test_|^__.*__$"))
        .when(kind.isin("rust_function", "rust_method"), (F.col("name") == "main") | path.rlike("(^|/)(benches|examples)(/|$)|(^|/)build\\.rs$"))
        .when(kind.isin("c_function", "cpp_function"), F.col("name").isin(C_ENTRIES))
        .when(kind == "java_method", leaf.isin(JAVA_CONTRACT) | F.startswith(leaf, F.lit("test")))
        .otherwise(F.lit(False))
    )
    auxiliary = kind.isin(K.CODE_OR_TEST) & exprs.is_auxiliary_path(path)
    return F.coalesce(auxiliary | kind.isin("route", "dart_provider", "test_case", "test_group") | by_name, F.lit(False))


def framework_types(nodes: DataFrame, edges: DataFrame, roots: list[str]) -> DataFrame:
    """(id) of Swift types that inherit, by name and through others, from what a framework
    instantiates (``inherits`` in their metadata), and of all that these types contain."""
    types = nodes.filter(F.startswith("kind", F.lit("swift_")) & F.col("name").isNotNull()).select("id", "name", F.explode(F.from_json(F.get_json_object("metadata_json", "$.inherits"), "array<string>")).alias("base"))
    found = bfs(types.select(F.col("base").alias("src"), F.col("name").alias("dst")).filter("src <> dst").distinct(), types.filter(F.col("base").isin(roots)).select(F.col("name").alias("id")))
    own = types.join(found.select(F.col("id").alias("name")), "name", "left_semi").select("id").distinct()
    return closure(adjacency(edges, ["contains"]), own)


def reachable(nodes: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(id) reached from the entries: along usage and containment, up to module
    and file parents, from a constructor to its class; then up to the types and
    modules around anything reached."""
    kind = nodes.select("id", "kind")
    contains = edges.filter("kind = 'contains'").select("from_id", "to_id")
    forward = edges.filter(F.col("kind").isin([*K.USAGE, "contains"])).select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    parents = kind.filter(F.col("kind").isin(K.of_family("module", "type"))).select(F.col("id").alias("from_id"), F.col("kind").alias("parent_kind"))
    parent_kind = keep(contains.join(parents, "from_id"), "parents")
    up = parent_kind.filter(F.col("parent_kind").isin(K.of_family("module"))).select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"))
    owner = contains.join(kind.filter("kind = 'dart_constructor'").select(F.col("id").alias("to_id")), "to_id", "left_semi").select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"))
    first = bfs(forward.unionAll(up).unionAll(keep(owner, "owners")).filter("src <> dst"), entries).select("id")
    containers = parent_kind.filter(F.col("parent_kind").isin(K.of_family("module", "type"))).select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"))
    return bfs(containers.filter("src <> dst"), first).select("id")


def dead_code(nodes: DataFrame, edges: DataFrame, public_globs: tuple[str, ...] = (), entry_paths: tuple[str, ...] = (), framework_roots: tuple[str, ...] = (), least: str = "low") -> DataFrame:
    """(id, path, confidence, inbound, live_inbound) of code that no entry reaches.

    high: nothing uses it and nothing speaks for it (a name without leading
    underscore does, in every language, and so do public paths, lifecycle
    names and constructors); medium: nothing uses it; low: only unreached code
    does, or it is used but not reached. ``entry_paths``: files whose symbols are
    entries; ``framework_roots``: bases of Swift types that are; ``least``: the
    confidence from which code is told.
    """
    entries = nodes.filter(implicit_entry() | F.coalesce(F.col("path").isin(list(entry_paths)), F.lit(False))).select("id")
    if framework_roots:
        entries = entries.unionAll(framework_types(nodes, edges, list(framework_roots)))
    alive = keep(reachable(nodes, edges, entries), "reachable")
    code = nodes.filter(F.col("kind").isin(K.CODE) & ~F.coalesce(exprs.is_test_path(F.col("path")), F.lit(False)))
    unreached, n = counted(code.select("id", "kind", "path", "name").join(alive, "id", "left_anti"), "unreached")
    usage = edges.filter(F.col("kind").isin(K.USAGE)).select("from_id", F.col("to_id").alias("id"))
    live = alive.select(F.col("id").alias("from_id")).withColumn("live", F.lit(1))
    counts = matching(usage, "id", unreached.select("id").distinct(), n).join(live, "from_id", "left").groupBy("id").agg(F.count(F.lit(1)).alias("inbound"), F.count("live").alias("live_inbound"))
    out = unreached.join(counts, "id", "left").na.fill(0, ["inbound", "live_inbound"])
    leaf = F.substring_index(F.substring_index("name", "#", -1), ".", -1)
    spoken_for = ~F.startswith(F.coalesce(leaf, F.lit("")), F.lit("_")) | leaf.isin(LIFECYCLE) | (F.col("kind") == "dart_constructor") | exprs.glob_match(F.coalesce("path", F.lit("")), list(public_globs))
    grade = F.when(F.col("inbound") > 0, "low").when(spoken_for, "medium").otherwise("high")
    out = out.select("id", "path", grade.alias("confidence"), "inbound", "live_inbound")
    levels = ["low", "medium", "high"]
    return out.filter(F.col("confidence").isin(levels[levels.index(least) :]))


def impure(calls: DataFrame, facts: DataFrame) -> DataFrame:
    """(id, depth): what is impure itself (``facts.id``) or calls something impure."""
    return bfs(calls.select(F.col("to_id").alias("src"), F.col("from_id").alias("dst")).filter("src <> dst"), facts)
