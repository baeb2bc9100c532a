"""Parent-child links to full hierarchies by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import Scratch


def resolve_hierarchy(links: DataFrame, with_path: bool = False) -> DataFrame:
    """Root and depth of every node of a forest: (tree, node, root, depth[, path, loop_path]).

    links: tree, node (each once a tree, not NULL), parent (NULL or no node of the tree: a root).
    A node whose chain ends in a loop gets root = smallest node on the loop in byte order and
    depth = -1 (and path NULL). path lists the nodes from the root to the node itself. loop_path does so for the nodes
    on or below a loop, which is cut above its smallest node; it is NULL for all others.

    Method: every node holds a pointer to an ancestor; each round joins the pointers with
    themselves and doubles the distance they reach, appending path segments. Nodes that have
    reached their root take no part in later rounds, so a root is a join key for its own children only, in the first
    two joins; the side that is looked up has one row a node, so Spark's skew join may split the other where a
    root has very many. A round that resolves nothing more shows that the rest leads into loops:
    the nodes at 2^k are at depth 2^k or more, and a deeper tree would hold some at every depth.
    On the rest, smallest values are doubled in the same way until they agree with the value one jump
    ahead. Each round is written to the shared folder.
    """
    scratch = Scratch(links.sparkSession)
    known = links.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    seg = F.array("node") if with_path else F.lit(None).cast("array<string>")
    first = links.join(known, ["tree", "parent"], "left").select(
        "tree", "node", F.when(F.col("known"), F.col("parent")).alias("up"),
        F.when(F.col("known"), 1).otherwise(0).alias("dist"), seg.alias("path"),
    )
    # up: the ancestor reached, NULL once it is the root; dist: steps to `up`, or to the root; last: the root once known.
    state = scratch.keep(first.select("tree", "node", "up", "dist", F.when(F.col("up").isNull(), F.col("node")).alias("root"), "path"))
    done, open_, before, kept = [state.where("up is null")], state.where("up is not null"), -1, state
    left = open_.count()
    while left and left != before:
        far = kept.select(
            "tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("dist").alias("dist2"), F.col("root").alias("root2"), F.col("path").alias("path2")
        )
        path = F.concat("path2", "path") if with_path else F.col("path")
        step = open_.join(far, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up"), (F.col("dist") + F.col("dist2")).alias("dist"), F.col("root2").alias("root"), path.alias("path"))
        new = scratch.keep(step)
        done.append(new.where("up is null"))
        open_ = new.where("up is not null")
        # Later pointers may lead to any node resolved so far, or to an open one.
        kept = _union([*done, open_])
        before, left = left, open_.count()
    none = F.lit(None).cast("array<string>")
    out = [d.select("tree", "node", "root", "dist", *(["path", none.alias("loop_path")] if with_path else [])) for d in done]
    if left:
        loops = scratch.keep(_loop_roots(links, open_.select("tree", "node"), scratch))
        if with_path:
            cut = links.join(loops, ["tree", "node"]).select("tree", "node", F.when(F.col("node") != F.col("root"), F.col("parent")).alias("parent"))
            out.append(resolve_hierarchy(cut, True).select("tree", "node", "root", F.lit(-1).alias("dist"), none.alias("path"), F.col("path").alias("loop_path")))
        else:
            out.append(loops.select("tree", "node", "root", F.lit(-1).alias("dist")))
    return _union(out).withColumnRenamed("dist", "depth").withColumn("depth", F.col("depth").cast("int"))


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def _loop_roots(links: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """For nodes that all lead into loops: the smallest node on the loop, as (tree, node, root)."""
    # Every node here has a parent that is here too. low: smallest node among the next 2^k, itself included.
    state = scratch.keep(links.join(nodes, ["tree", "node"], "left_semi").select("tree", "node", F.col("parent").alias("up"), F.col("node").alias("low")))
    ring_before = -1
    while True:
        far = state.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("low").alias("low2"))
        new = scratch.keep(state.join(far, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up"), F.least("low", "low2").alias("low"), (F.col("low") != F.least("low", "low2")).alias("moved")))
        # The nodes still pointed at; once their number stands still they are exactly those on loops.
        ring = new.select("tree", F.col("up").alias("node")).distinct()
        size = ring.count()
        settled = size == ring_before and not new.join(ring, ["tree", "node"], "left_semi").where("moved").limit(1).count()
        scratch.drop(state)
        state, ring_before = new, size
        if settled:
            break
    lows = state.join(ring, ["tree", "node"], "left_semi").select("tree", F.col("node").alias("up"), F.col("low").alias("root"))
    return state.select("tree", "node", "up").join(lows, ["tree", "up"]).select("tree", "node", "root")


def descendants(resolved: DataFrame) -> DataFrame:
    """(tree, ancestor, node, distance, loop) for every node and each node above it, from `resolve_hierarchy(..., with_path=True)`.

    loop: both are on or below a loop; the loop is cut above its smallest node, which is the ancestor of all others there.
    """
    return (
        resolved.select("tree", "node", F.coalesce("path", "loop_path").alias("path"), F.col("path").isNull().alias("loop"))
        .select("tree", "node", "loop", F.size("path").alias("_n"), F.posexplode("path").alias("_at", "ancestor"))
        .where("_at < _n - 1")
        .select("tree", "ancestor", "node", (F.col("_n") - 1 - F.col("_at")).cast("int").alias("distance"), "loop")
    )
