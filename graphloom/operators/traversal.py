"""Walking the graph: trails, reachability, least depths and shortest paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import Scratch


def trails(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, depth): ends of all paths of 1..depth edges that use no edge twice; distinct.

    edges: src, dst, one row a pair; starts: node. Only an edge on a cycle can be met again, so a path carries
    only such edges with it: ways that differ in others are one row a level and node, however many there are.
    """
    one = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    if depth <= 2:  # only a loop of one edge is met again so soon
        e = one.withColumn("again", (F.col("node") == F.col("next")) & F.lit(depth > 1))
    else:
        scratch = Scratch(edges.sparkSession)
        near = least_depths(edges, starts, depth - 1).select("node").unionByName(starts.select("node")).distinct()
        one = scratch.keep(one.join(near, "node", "left_semi"))
        # Edges into a dead end or out of a beginning are on no cycle; taking them away bares others.
        ring = one
        for _ in range(2):
            ring = ring.join(ring.select(F.col("next").alias("node")).distinct(), "node", "left_semi")
            ring = scratch.keep(ring.join(ring.select(F.col("node").alias("next")).distinct(), "next", "left_semi").select("node", "next"))
        e = scratch.keep(one.join(ring.withColumn("again", F.lit(True)), ["node", "next"], "left").withColumn("again", F.coalesce("again", F.lit(False))))
    kind = "array<struct<node:string,next:string>>"
    state = starts.select(F.col("node").alias("start"), "node", F.array().cast(kind).alias("path")).distinct()
    found = []
    for d in range(1, depth + 1):
        step = F.struct("node", "next")
        state = state.join(e, "node").where(~(F.col("again") & F.array_contains("path", step)))
        path = F.when(F.col("again"), F.array_sort(F.concat("path", F.array(step)))).otherwise(F.col("path"))
        state = state.select("start", F.col("next").alias("node"), path.alias("path")).distinct()
        found.append(state.select("start", "node", F.lit(d).alias("depth")).distinct())
    return reduce(DataFrame.unionByName, found)


def least_depths(edges: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """(start, node, depth): every node reachable from a start over 1 or more edges, with the least number of edges.

    depth: the most edges; None: until nothing new is reached. A start is in its own result only
    if a cycle leads back to it. Each level joins the nodes found last; levels are written to the
    shared folder, and nodes met before leave by an anti join, so cycles end.
    """
    scratch = Scratch(edges.sparkSession)
    e = scratch.keep(edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct())
    frontier = starts.select(F.col("node").alias("start"), "node").distinct()
    seen: list[DataFrame] = []
    level = 0
    while depth is None or level < depth:
        level += 1
        new = frontier.join(e, "node").select("start", F.col("next").alias("node")).distinct()
        for s in seen:
            new = new.join(s.select("start", "node"), ["start", "node"], "left_anti")
        new = scratch.keep(new.withColumn("depth", F.lit(level)))
        if not new.limit(1).count():
            break
        seen.append(new)
        frontier = new.select("start", "node")
        if len(seen) > 6:  # keeps the plan short on long chains
            seen = [scratch.keep(reduce(DataFrame.unionByName, seen))]
    if not seen:
        return starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth")).limit(0)
    return reduce(DataFrame.unionByName, seen)


def closure(edges: DataFrame) -> DataFrame:
    """(start, node, depth): every pair of nodes joined by a path of 1 or more edges, with the least number of edges.

    For the closure of a whole graph: each round joins the pairs found so far with themselves and
    doubles the length of the paths covered, so chains and cycles of length n take log n rounds.
    Rounds are written to the shared folder; the last one changes nothing.
    """
    scratch = Scratch(edges.sparkSession)
    pairs = scratch.keep(edges.select(F.col("src").alias("start"), F.col("dst").alias("node")).distinct().withColumn("depth", F.lit(1)))
    before = None
    while True:
        total = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum("depth").alias("s")).first()
        if (total.n, total.s) == before:
            return pairs
        before = (total.n, total.s)
        further = pairs.select(F.col("start").alias("node"), F.col("node").alias("end"), F.col("depth").alias("more"))
        longer = pairs.join(further, "node").select("start", F.col("end").alias("node"), (F.col("depth") + F.col("more")).alias("depth"))
        new = scratch.keep(pairs.unionByName(longer).groupBy("start", "node").agg(F.min("depth").alias("depth")))
        scratch.drop(pairs)
        pairs = new


def shortest_path(edges: DataFrame, sources: DataFrame, targets: DataFrame, depth: int = 5) -> DataFrame:
    """(step, node): a shortest path between any of the sources and any other of the targets, over edges in either direction.

    edges: src, dst; sources, targets: node. Of several shortest paths the one whose nodes come
    first in byte order is taken; without a path of at most `depth` edges there is no row. A
    search by levels keeps for every node the least path that leads to it; no pair of nodes is
    ever formed, and the search ends at the first level that meets a target.
    """
    scratch = Scratch(edges.sparkSession)
    ends = F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("next")), F.struct(F.col("dst").alias("node"), F.col("src").alias("next")))
    both = scratch.keep(edges.select(F.inline(ends)).where("node <> next").distinct())
    goal = scratch.keep(targets.select("node").distinct())
    sources = scratch.keep(sources.select("node").distinct())
    # A node that is source and target at once is no end for its own paths: the search keeps sources apart.
    frontier = sources.select(F.col("node").alias("source"), "node", F.array("node").alias("path")).distinct()
    seen = frontier.select("source", "node")
    for _ in range(depth):
        new = frontier.join(both, "node").select("source", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"))
        new = new.join(seen, ["source", "node"], "left_anti").groupBy("source", "node").agg(F.min("path").alias("path"))
        new = scratch.keep(new)
        hits = new.join(goal, "node", "left_semi").where("source <> node")
        if hits.limit(1).count():
            best = hits.agg(F.min("path").alias("path"))
            return best.select(F.posexplode("path").alias("step", "node"))
        if not new.limit(1).count():
            break
        seen = scratch.keep(seen.unionByName(new.select("source", "node")))
        frontier = new
    return sources.select(F.lit(0).alias("step"), "node").limit(0)
