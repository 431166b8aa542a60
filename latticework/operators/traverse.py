"""Level-synchronous graph traversal: one join a hop, no adjacency on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.functions.tables import FEW, counted, keep, matching
from latticework.operators import contract


def adjacency(edges: DataFrame, kinds: list[str] | None = None, reverse: bool = False) -> DataFrame:
    """(src, dst) of the edges of some kinds, without self loops; a pair of several
    edges comes several times: walks take what it leads to once."""
    rows = edges.filter(F.col("kind").isin(kinds)) if kinds else edges
    a, b = ("to_id", "from_id") if reverse else ("from_id", "to_id")
    return rows.filter("from_id <> to_id").select(F.col(a).alias("src"), F.col(b).alias("dst"))


def bfs(pairs: DataFrame, seeds: DataFrame, max_depth: int | None = None, max_nodes: int | None = None) -> DataFrame:
    """(id, depth) of all nodes within ``max_depth`` hops of the seeds (column
    ``id``), with their least depth.

    ``max_nodes`` keeps the first ones by depth and id: no hop is made once there
    are as many. Each hop reads the pairs and shuffles those that start in the
    frontier, so all hops together shuffle a pair once; what has been seen is read
    but not shuffled for a small step. The driver only learns how many nodes are new.
    """
    seen, total = counted(seeds.select("id").distinct().withColumn("depth", F.lit(0)), "frontier")
    frontier, fresh, depth = seen, total, 0
    while (max_depth is None or depth < max_depth) and (max_nodes is None or total < max_nodes):
        depth += 1
        step = matching(pairs, "src", frontier, fresh).select(F.col("dst").alias("id")).distinct()
        if total > FEW:
            step, met = counted(step, "step")
            known = matching(seen.select("id"), "id", step, met)
            step = step.join(F.broadcast(known) if met <= FEW else known, "id", "left_anti")
        else:
            step = step.join(seen.select("id"), "id", "left_anti")
        step, fresh = counted(step.withColumn("depth", F.lit(depth)), "frontier")
        if not fresh:
            break
        total += fresh
        seen, frontier = seen.unionAll(step), step
    if max_nodes is None:
        return seen
    return seen.orderBy("depth", "id").limit(max_nodes)


def closure(pairs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id) of everything reachable from the seeds, these included."""
    return bfs(pairs, seeds).select("id")


def expand(edges: DataFrame, seeds: DataFrame, kinds: list[str], depth: int) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``depth`` hops in either direction, and the edges among them."""
    both = adjacency(edges, kinds).unionAll(adjacency(edges, kinds, reverse=True))
    nodes, n = counted(bfs(both, seeds, depth), "subgraph")
    ids = nodes.select("id")
    inside = matching(matching(edges.filter(F.col("kind").isin(kinds)), "from_id", ids, n), "to_id", ids, n)
    return nodes, inside


def neighbours(edges: DataFrame, ids: DataFrame, backward: bool = True) -> DataFrame:
    """(id): the ids and what one edge leads to from them (and, ``backward``, to them)."""
    step = lambda a, b: edges.join(ids.select(F.col("id").alias(a)), a, "left_semi").select(F.col(b).alias("id"))
    out = ids.select("id").unionAll(step("from_id", "to_id"))
    return (out.unionAll(step("to_id", "from_id")) if backward else out).distinct()


def first_parent(edges: DataFrame) -> DataFrame:
    """(id, parent): of several containers the one whose edge id is smallest."""
    return edges.filter("kind = 'contains'").groupBy(F.col("to_id").alias("id")).agg(F.min_by("from_id", "id").alias("parent"))


def ancestors(edges: DataFrame, seeds: DataFrame, hops: int = 17) -> DataFrame:
    """(id, ancestor, hop) along first parents."""
    parents = keep(first_parent(edges), "parents")
    at = seeds.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("hop"))
    every = None
    for hop in range(1, hops + 1):
        at = at.join(parents.select(F.col("id").alias("ancestor"), "parent"), "ancestor").select("id", F.col("parent").alias("ancestor"), F.lit(hop).alias("hop"))
        at, n = counted(at.filter("id <> ancestor"), "ancestors")
        if not n:
            break
        every = at if every is None else every.unionAll(at)
    return every if every is not None else at


def _number(c: str) -> Column:
    return F.xxhash64(c)


def label_components(pairs: DataFrame) -> DataFrame:
    """(id, root): the smallest id of each component.

    Ids are contracted by numbers, their hashes; should two ids share one (that is
    looked up), by numbers that are given out instead.
    """
    pairs = pairs.select("src", "dst")
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("id")).filter("id is not null").distinct()
    ids, n = counted(ends.select("id", _number("id").alias("node")), "ids")
    links = pairs.filter("src is not null and dst is not null")
    if ids.agg(F.count_distinct("node")).first()[0] == n:
        links = links.select(_number("src").alias("u"), _number("dst").alias("v"))
    else:
        ids = keep(ids.select("id", F.monotonically_increasing_id().alias("node")), "ids")
        to = lambda c, a: ids.select(F.col("id").alias(c), F.col("node").alias(a))
        links = links.join(to("src", "u"), "src").join(to("dst", "v"), "dst").select("u", "v")
    at = ids.join(contract.roots(links), "node", "left").select("id", F.coalesce("root", "node").alias("node"))
    at = keep(at, "labels")
    first, n = counted(at.groupBy("node").agg(F.min("id").alias("root")), "firsts")
    return at.join(F.broadcast(first) if n <= FEW else first, "node").select("id", "root")


def claim(pairs: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, seed): each node within ``depth`` hops goes to the seed with the highest
    score (columns id, score, rank); ties to the smaller rank.

    Only a node's best seed goes on at each hop: what a neighbour could hand over
    later is what is best for it by then, so a hub hands over one row an edge.
    """
    order = F.struct((-F.col("score")).alias("low"), "rank", "seed")
    best, n = counted(seeds.select("id", F.col("id").alias("seed"), "score", "rank").select("id", order.alias("best")), "claims")
    fresh = best
    for _ in range(depth):
        # pairs that start in what is fresh, found without shuffling the others
        near = matching(pairs, "src", fresh.select("id"), n)
        step = near.join(F.broadcast(fresh) if n <= FEW else fresh, F.col("src") == fresh["id"]).groupBy(F.col("dst").alias("id")).agg(F.min("best").alias("best"))
        new = step.join(best.withColumnRenamed("best", "old"), "id", "left").filter("old is null or best < old").select("id", "best")
        fresh, n = counted(new, "claims")
        if not n:
            break
        best = keep(best.unionAll(fresh).groupBy("id").agg(F.min("best").alias("best")), "claims")
    return best.select("id", F.col("best.seed").alias("seed"))
