"""Features: files that speak for one, and the nodes that belong to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions import exprs
from latticework.functions import kinds as K
from latticework.functions.tables import counted, keep, matching
from latticework.operators import traverse as T

#: What may anchor a feature; what a role adds to its score, and outside references at most.
ANCHORS, ROLE, MOST_REFERENCES = ["file", "python_module", "dart_class", "swift_class"], 5, 20


def seeds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, path, score) of what may anchor a feature, tests left out: 1, and for all
    that it contains 5 for each framework role and 1 for each reference from outside,
    20 of these at most."""
    anchors = nodes.filter(F.col("kind").isin(ANCHORS) & F.col("path").isNotNull() & ~exprs.is_test_path(F.col("path"))).select("id", "path")
    pairs = keep(T.adjacency(edges, ["contains"]), "contains")
    level = keep(anchors.select(F.col("id").alias("seed"), "id"), "inside")
    inside = level
    while True:  # containment is a tree, or nearly: a node has few anchors above it
        step = level.join(pairs, level["id"] == pairs["src"]).select("seed", F.col("dst").alias("id")).distinct()
        level, n = counted(step.join(inside, ["seed", "id"], "left_anti"), "inside")
        if not n:
            break
        inside = inside.unionAll(level)
    roles = inside.join(nodes.filter("metadata_json is not null").select("id"), "id").groupBy("seed").agg(F.count(F.lit(1)).alias("roles"))
    ids, n = counted(inside.select("id").distinct(), "ids")
    refs = matching(edges.filter(F.col("kind").isin("calls", "references", "imports")).select("from_id", F.col("to_id").alias("id")), "id", ids, n).join(inside, "id")
    own = inside.select("seed", F.col("id").alias("from_id"))
    refs = refs.join(own, ["seed", "from_id"], "left_anti").groupBy("seed").agg(F.count(F.lit(1)).alias("refs"))
    both = anchors.join(roles, F.col("id") == roles["seed"], "left").drop("seed").join(refs, F.col("id") == refs["seed"], "left").drop("seed")
    score = 1 + ROLE * F.coalesce("roles", F.lit(0)) + F.least(F.coalesce("refs", F.lit(0)), F.lit(MOST_REFERENCES))
    return both.select("id", "path", score.cast("bigint").alias("score"))


def claims(nodes: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """(id, seed): the best seed within ``depth`` hops of each node. One seed for a
    path; one for each 250 code symbols, from 20 to 80."""
    code = nodes.filter(F.col("kind").isin(K.CODE)).count()
    first = Window.partitionBy("path").orderBy(F.col("score").desc(), "id")
    one = seeds(nodes, edges).withColumn("n", F.row_number().over(first)).filter("n = 1")
    best = one.orderBy(F.col("score").desc(), "path", "id").limit(min(max(code // 250, 20), 80))
    ranked = best.withColumn("rank", F.struct("path", "id"))
    walk = T.adjacency(edges, ["contains", "imports", "calls", "references"]).unionAll(T.adjacency(edges, ["contains"], reverse=True))
    return T.claim(walk, ranked, depth).select("id", "seed")


def cluster_name(path):
    """A feature's name: its path without lib, src, backend and a code ending, joined by a dot."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "lib", "src", "backend"))
    name = F.regexp_replace(F.array_join(parts, " \u00b7 "), r"\.(py|dart|swift|go|ts|js)$", "")
    return F.when(F.size(parts) == 0, path).otherwise(name)
