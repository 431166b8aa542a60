"""Resolution joins: names to definitions, specs to nodes, candidates to evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions.tables import counted, matching

#: Definitions of a name beyond which it resolves to none module-wide; targets of a reference at most.
MOST_FAN_IN, MOST_TARGETS = 32, 16


def def_use(occurrences: DataFrame) -> DataFrame:
    """(from_id, to_id, lines): uses of a symbol (node, symbol, is_def, line) joined
    to its definition; a node's own uses don't count; lines sorted, each once."""
    defs = occurrences.filter("is_def").groupBy("symbol").agg(F.min("node").alias("to_id"))
    uses = occurrences.filter("not is_def").select(F.col("node").alias("from_id"), "symbol", "line")
    both = uses.join(defs, "symbol").filter("from_id <> to_id")
    return both.groupBy("from_id", "to_id").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def _first_targets(rows: DataFrame, *keys: str) -> DataFrame:
    """Of the distinct rows (keys, target) of each key the first ``MOST_TARGETS``."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("target"))
    return rows.select(*keys, "target").distinct().withColumn("n", nth).filter(F.col("n") <= MOST_TARGETS).drop("n")


def resolve(refs: DataFrame, defs: DataFrame, imports: DataFrame) -> DataFrame:
    """(ref, target, tier) of references (ref, name, file) to definitions (id,
    name, file): those of the same file (1), else of imported files (2), else
    of the whole module if the name is multi-word and defined at most
    ``MOST_FAN_IN`` times (3); the first ``MOST_TARGETS`` by id.

    A name of a file resolves once, whatever its references, and to the first targets
    of each file: pairs of a reference and a definition never are rows.
    """
    d = defs.select("name", F.col("id").alias("target"), F.col("file").alias("at"))
    held = _first_targets(d, "name", "at")
    asked = refs.filter("name is not null").select("name", "file").distinct()
    same = asked.join(held.withColumnRenamed("at", "file"), ["name", "file"]).withColumn("tier", F.lit(1))
    linked = asked.join(imports.select("file", F.col("target").alias("at")).distinct(), "file").join(held, ["name", "at"])
    linked = _first_targets(linked, "name", "file").withColumn("tier", F.lit(2))
    few = d.groupBy("name").agg(F.count(F.lit(1)).alias("fan_in")).filter(F.col("fan_in") <= MOST_FAN_IN).select("name")
    words = F.col("name").rlike(r"[a-z][A-Z]|[A-Za-z0-9]_[A-Za-z0-9]|^[A-Z][a-z0-9]")
    wide = asked.filter(words).join(_first_targets(d.join(few, "name", "left_semi"), "name"), "name").withColumn("tier", F.lit(3))
    columns = ["name", "file", "tier", "target"]
    every = same.select(columns).unionByName(linked.select(columns)).unionByName(wide.select(columns))
    found = every.groupBy("name", "file", "tier").agg(F.collect_list("target").alias("targets"))
    found = found.groupBy("name", F.col("file").alias("at")).agg(F.min_by(F.struct("tier", "targets"), "tier").alias("best"))
    named = refs.alias("r").join(found.alias("f"), (F.col("r.name") == F.col("f.name")) & F.col("r.file").eqNullSafe(F.col("at"))).select("ref", "best")
    # a reference that stands in several rows takes the best tier of them all
    best = named.groupBy("ref").agg(F.min("best.tier").alias("tier"), F.collect_set("best").alias("every"))
    targets = F.flatten(F.transform(F.filter("every", lambda x: x["tier"] == F.col("tier")), lambda x: x["targets"]))
    return best.select("ref", F.explode(F.slice(F.array_sort(F.array_distinct(targets)), 1, MOST_TARGETS)).alias("target"), "tier")


def resolve_specs(specs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(spec, id, resolved) of ``path#name`` specs; one that names no node keeps a placeholder."""
    at = nodes.groupBy(F.concat("path", F.lit("#"), "name").alias("spec")).agg(F.min("id").alias("found"))
    out = specs.join(at, "spec", "left")
    return out.select("spec", F.coalesce("found", F.concat(F.lit("unresolved::"), "spec")).alias("id"), F.col("found").isNotNull().alias("resolved"))


def scan_candidates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid candidates (id, name, …, seq) and warnings (id, warning): ids must be
    slugs, first of an id wins, names must not be blank."""
    nth = F.row_number().over(Window.partitionBy("id").orderBy("seq"))
    slug = F.coalesce(F.col("id").rlike("^[a-z0-9][a-z0-9_-]*$"), F.lit(False))
    why = F.when(~slug, "invalid id").when(nth > 1, "duplicate id").when(F.trim(F.coalesce("name", F.lit(""))) == "", "empty name")
    marked = rows.withColumn("warning", why)
    return marked.filter("warning is null").drop("warning"), marked.filter("warning is not null").select("id", "warning")


def review(candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    """Candidates with the status of their latest review (id, status, at), if any."""
    last = reviews.groupBy("id").agg(F.max_by("status", "at").alias("verdict"))
    return candidates.join(last, "id", "left").withColumn("status", F.coalesce("verdict", "status")).drop("verdict")


def connect(manifest: DataFrame, links: DataFrame, nodes: DataFrame) -> DataFrame:
    """The manifest (requirement, targets) with valid proposed links (requirement,
    target) merged in, each target once, in order; links to no node are left out."""
    ids = nodes.select("id")
    good = links.join(ids.withColumnRenamed("id", "target"), "target", "left_semi").join(ids.withColumnRenamed("id", "requirement"), "requirement", "left_semi")
    new = good.groupBy("requirement").agg(F.array_sort(F.collect_set("target")).alias("new"))
    none = F.array().cast("array<string>")
    both = manifest.join(new, "requirement", "full_outer")
    return both.select("requirement", F.array_union(F.coalesce("targets", none), F.coalesce("new", none)).alias("targets"))


def doc_votes(mentions: DataFrame, owners: DataFrame, least: int = 2) -> DataFrame:
    """(doc, module, votes): documents (doc, name) vote for the modules that own
    the names (name, module); names of several owners don't vote; all modules
    that tie at the top win, from ``least`` votes."""
    sole = owners.distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("module").alias("module")).filter("n = 1")
    votes = mentions.distinct().join(sole.select("name", "module"), "name").groupBy("doc", "module").agg(F.count(F.lit(1)).alias("votes"))
    top = F.max("votes").over(Window.partitionBy("doc"))
    return votes.withColumn("top", top).filter((F.col("votes") == F.col("top")) & (F.col("votes") >= least)).drop("top")


def best_snippets(rows: DataFrame, needles: list[str]) -> DataFrame:
    """(key, at, line, hits): of each text's lines (key, at, line) the one with
    the most needles, the earliest at a tie."""
    low = F.lower("line")
    hits = sum((F.contains(low, F.lit(n.lower())).cast("int") for n in needles[1:]), F.contains(low, F.lit(needles[0].lower())).cast("int"))
    order = Window.partitionBy("key").orderBy(F.col("hits").desc(), "at")
    return rows.withColumn("hits", hits).filter("hits > 0").withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def visible(nodes: DataFrame, edges: DataFrame, view: str) -> DataFrame:
    """(id) that a view shows: root modules (overview, code), requirements and
    candidates with what is one hop away (business), or all (focus)."""
    if view == "focus":
        return nodes.select("id")
    if view in ("overview", "code"):
        inner = edges.filter("kind = 'contains'").select(F.col("to_id").alias("id"))
        return nodes.filter(F.col("kind").isin("rust_module", "module")).select("id").join(inner, "id", "left_anti")
    surface, n = counted(nodes.filter(F.col("kind").isin("requirement", "business_candidate")).select("id").distinct(), "surface")
    step = lambda a, b: matching(edges.select(a, b), a, surface, n).select(F.col(b).alias("id"))
    shown, n = counted(surface.unionAll(step("from_id", "to_id")).unionAll(step("to_id", "from_id")).distinct(), "shown")
    return matching(nodes.select("id"), "id", shown, n).distinct()
