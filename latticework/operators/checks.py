"""Consistency of declared links, drift of documents, levels of severity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of edges that people declare.
DECLARED = ["documents", "declares_implementation", "declares_verification"]
#: Endings of a file name that stands alone and surely means code.
CODE_FILES = ["rs", "dart", "py", "go", "ts", "swift", "java", "kt"]


def severity(level: str) -> str | None:
    """What a configured level means: a word that is none of them warns; off: null."""
    word = level.strip().lower()
    if word in ("off", "none", "ignore"):
        return None
    return {"error": "error", "info": "info"}.get(word, "warning")


def _at(findings: DataFrame, code: str, levels: dict[str, str]) -> DataFrame:
    found = severity(levels.get(code, "warning"))
    rows = findings.select(F.lit(code).alias("code"), F.lit(found).cast("string").alias("severity"), "artifact", "n")
    return rows if found else rows.limit(0)


def consistency(nodes: DataFrame, edges: DataFrame, levels: dict[str, str]) -> DataFrame:
    """(code, severity, artifact, n): declared links to or from nothing, requirements
    with implementations but no test, and those with neither."""
    links = edges.filter(F.col("kind").isin(DECLARED))
    ids = nodes.select("id")
    there = lambda c: ids.select(F.col("id").alias(c), F.lit(True).alias(f"{c}_there"))
    broken = links.join(there("to_id"), "to_id", "left").join(there("from_id"), "from_id", "left").filter("to_id_there is null or from_id_there is null")
    broken = broken.groupBy(F.col("from_id").alias("artifact")).agg(F.count(F.lit(1)).alias("n"))
    met = links.groupBy(F.col("to_id").alias("id")).agg(*[F.bool_or(F.col("kind") == k).alias(a) for k, a in (("declares_implementation", "impl"), ("declares_verification", "test"))])
    asked = nodes.filter("kind = 'requirement'").select("id").join(met, "id", "left").select(F.col("id").alias("artifact"), F.coalesce("impl", F.lit(False)).alias("impl"), F.coalesce("test", F.lit(False)).alias("test"), F.lit(1).cast("bigint").alias("n"))
    parts = [(broken, "broken_link"), (asked.filter("impl and not test"), "missing_linked_test"), (asked.filter("not impl and not test"), "orphan_requirement")]
    out = [_at(rows, code, levels) for rows, code in parts]
    return out[0].unionAll(out[1]).unionAll(out[2])


def drift(docs: DataFrame, key: str, body: str, nodes: DataFrame) -> DataFrame:
    """(key, kind, ref): inline code of documents, each once, that names a path, a file
    or a symbol which no node has."""
    spans = docs.select(key, F.explode(F.array_distinct(F.regexp_extract_all(body, F.lit("`([^`]+)`"), F.lit(1)))).alias("ref")).distinct()
    kind = F.when(F.col("ref").rlike(r"^[\w.-]+(/[\w.-]+)+$"), "path").when(F.col("ref").rlike(rf"^[\w-]+\.({'|'.join(CODE_FILES)})$"), "file").when(F.col("ref").rlike(r"^[A-Za-z_]\w*((::|\.)[A-Za-z_]\w*)*(\(\))?$"), "symbol")
    member = F.lower(F.regexp_extract("ref", r"(\w+)(?:\(\))?$", 1))
    what = F.when(F.col("kind") == "path", F.col("ref")).when(F.col("kind") == "file", F.lower("ref")).otherwise(member)
    spans = spans.withColumn("kind", kind).filter("kind is not null").withColumn("what", what)
    paths = nodes.filter("path is not null").select("path").distinct()
    known = paths.select(F.lit("path").alias("kind"), F.col("path").alias("what"))
    known = known.unionAll(paths.select(F.lit("file"), F.lower(F.element_at(F.split("path", r"[/\\]"), -1)))).unionAll(nodes.filter("name is not null").select(F.lit("symbol"), F.lower("name")))
    return spans.join(known.distinct(), ["kind", "what"], "left_anti").select(key, "kind", "ref")


def questions(nodes: DataFrame, edges: DataFrame, candidates: DataFrame, entries: DataFrame, code_kinds: list[str]) -> DataFrame:
    """(category, severity, id, path): code that nothing uses and no framework calls,
    candidates (id, status) that wait for a review, tests that touch no code, and
    imports by tests of what was never indexed."""
    used = ["calls", "references", "imports", "reads_provider", "navigates_to", "persists_to", "subscribes_stream", "declares_implementation"]
    row = lambda df, category, severity, path: df.select(F.lit(category).alias("category"), F.lit(severity).alias("severity"), "id", path.alias("path"))
    ends = lambda c, kinds: edges.filter(F.col("kind").isin(kinds)).select(F.col(c).alias("id"))
    code = nodes.filter(F.col("kind").isin(code_kinds) & F.col("metadata_json").isNull() & ~F.coalesce(F.col("name").isin("main", "__main__"), F.lit(False)))
    orphans = code.join(ends("to_id", used), "id", "left_anti").join(entries.select("id"), "id", "left_anti")
    waiting = candidates.filter("status is null or status in ('proposed', 'pending', 'needs_changes')")
    idle = nodes.filter("kind in ('test_case', 'test_group')").join(ends("from_id", ["calls", "references"]), "id", "left_anti")
    loose = edges.filter("kind = 'imports'").select("from_id", F.col("to_id").alias("id")).join(nodes.select("id"), "id", "left_anti")
    loose = loose.join(nodes.select(F.col("id").alias("from_id"), "path"), "from_id").filter("path like 'test%' or path like '%/tests/%' or path like '%/test/%'").select("id", "path").distinct()
    out = row(orphans, "orphan_symbol", "info", F.col("path")).unionAll(row(waiting, "pending_candidate", "warn", F.lit(None).cast("string")))
    return out.unionAll(row(idle, "test_without_references", "info", F.col("path"))).unionAll(row(loose, "dangling_import", "info", F.col("path")))
