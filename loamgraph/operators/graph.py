"""Graph traversal by frontier joins; every round ends in a checkpoint, so lineage and lost executors don't matter.

The frontier and what is known are tables; the loop only looks at whether a round found anything.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .core import cut

__all__ = ["closure", "closure_pairs", "connected_components", "core_cycles", "cycle_nodes", "depths", "imports_dag", "neighbourhood", "outline", "paths", "scc"]


def closure(edges: DataFrame, starts, max_depth: int = 50, reverse: bool = False) -> DataFrame:
    """node and its smallest depth from the starts (depth 0), over at most max_depth (clamped to 1..50) edges."""
    max_depth = min(max(int(max_depth), 1), 50)
    src, dst = ("dst", "src") if reverse else ("src", "dst")
    e = edges.select(F.col(src).alias("node"), F.col(dst).alias("_next")).distinct()
    kind = e.schema["node"].dataType
    spark = edges.sparkSession
    known = starts if isinstance(starts, DataFrame) else spark.createDataFrame([(s,) for s in starts], "node string" if kind.simpleString() == "string" else "node long")
    known = cut(known.select(F.col("node").cast(kind)).distinct().withColumn("depth", F.lit(0)))
    frontier = known
    for depth in range(1, max_depth + 1):
        found = frontier.select("node").join(e, "node").select(F.col("_next").alias("node")).distinct()
        frontier = cut(found.join(known.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if not frontier.limit(1).count():
            break
        known = cut(known.unionByName(frontier))
    return known


def closure_pairs(edges: DataFrame, max_depth: int = 50) -> DataFrame:
    """src, dst and the smallest depth (from 1) for every pair within max_depth edges."""
    e = cut(edges.select("src", "dst").distinct())
    step = e.select(F.col("src").alias("dst"), F.col("dst").alias("_next"))
    rounds = [e.withColumn("depth", F.lit(1))]
    frontier = e
    for depth in range(2, max_depth + 1):
        found = frontier.join(step, "dst").select("src", F.col("_next").alias("dst")).distinct()
        for known in rounds:
            found = found.join(known.select("src", "dst"), ["src", "dst"], "left_anti")
        frontier = cut(found)
        if not frontier.limit(1).count():
            break
        rounds.append(frontier.withColumn("depth", F.lit(depth)))
    return reduce(DataFrame.unionByName, rounds)


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """Nodes left after nodes without incoming or outgoing edges are pruned again and again; none: the graph has no cycle."""
    e = cut(edges.select("src", "dst").distinct())
    n = e.count()
    while n:
        e2 = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        e2 = cut(e2.select("src", "dst"))
        left = e2.count()
        if left == n:
            break
        e, n = e2, left
    return e.select(F.col("src").alias("node")).distinct()


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges between nodes that are left when those without incoming or outgoing edges are pruned again and again."""
    core = cycle_nodes(edges)
    return cut(edges.join(core.withColumnRenamed("node", "src"), "src", "left_semi").join(core.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst").distinct())


def _coloured(e: DataFrame) -> DataFrame:
    """node and colour: the largest node that reaches it."""
    colour = cut(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumn("colour", F.col("node")))
    while True:
        sent = e.join(colour.select(F.col("node").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("got"))
        now = cut(colour.join(sent, "node", "left").select("node", F.greatest("colour", "got").alias("colour"), (F.col("got") > F.col("colour")).alias("new")))
        if not now.where("new").limit(1).count():
            return now.select("node", "colour")
        colour = now.select("node", "colour")


def scc(edges: DataFrame) -> DataFrame:
    """node and component (its smallest member) of strongly connected components with several nodes or a self loop.

    Every round colours each node by the largest node that reaches it; what reaches that node within its colour is its
    component.  At least one component of each connected part is found and removed, so the rounds end; no reachable pairs
    are made, and cycles may have any length.
    """
    e = _trimmed(edges.select("src", "dst"))
    loops = cut(e.where("src = dst").select(F.col("src").alias("node")).distinct())
    out = e.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    while e.limit(1).count():
        colour = _coloured(e)
        inside = e.join(colour.select(F.col("node").alias("src"), "colour"), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("_c")), "dst").where("colour = _c").select("src", "dst", "colour")
        inside = cut(inside)
        known = frontier = cut(colour.where("node = colour"))
        while frontier.limit(1).count():
            back = inside.join(frontier.select(F.col("node").alias("dst"), "colour"), ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct()
            frontier = cut(back.join(known, ["node", "colour"], "left_anti"))
            known = cut(known.unionByName(frontier))
        size = known.groupBy("colour").agg(F.count("*").alias("n"), F.min("node").alias("component"))
        found = known.join(size, "colour").join(loops.withColumn("_loop", F.lit(True)), "node", "left").where("n > 1 OR _loop")
        out = cut(out.unionByName(found.select("node", "component")))
        gone = known.select("node")
        e = _trimmed(e.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))
    return out


def core_cycles(edges: DataFrame) -> DataFrame:
    """All simple cycles as arrays that start with their smallest node; their number, not their length, bounds the work."""
    core = cycle_nodes(edges)
    e = cut(edges.join(core.withColumnRenamed("node", "src"), "src", "left_semi").select("src", "dst").distinct())
    found = e.where("src = dst").select(F.array("src").alias("cycle"))
    walk = cut(e.where("src < dst").select(F.array("src", "dst").alias("path")))
    while walk.limit(1).count():
        step = walk.withColumn("src", F.element_at("path", -1)).join(e, "src")
        closed = step.where(F.col("dst") == F.col("path")[0]).select(F.col("path").alias("cycle"))
        found = cut(found.unionByName(closed))
        walk = cut(step.where((F.col("dst") > F.col("path")[0]) & ~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path")))
    return found.distinct()


def depths(edges: DataFrame, cap: int = 20) -> DataFrame:
    """node and the longest path, up to cap edges, from it to a node without outgoing edges."""
    e = cut(edges.select("src", "dst").distinct())
    leaves = e.select(F.col("dst").alias("node")).distinct().join(e.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
    level = cut(leaves.withColumn("depth", F.lit(0)))
    out = level
    for depth in range(1, cap + 1):
        level = cut(level.select(F.col("node").alias("dst")).join(e, "dst").select(F.col("src").alias("node")).distinct().withColumn("depth", F.lit(depth)))
        if not level.limit(1).count():
            break
        out = out.unionByName(level)
    return out.groupBy("node").agg(F.max("depth").alias("depth"))


def neighbourhood(edges: DataFrame, domain: DataFrame) -> DataFrame:
    """node with the sorted sets of its parents, children and properties, one hop each."""
    parents = edges.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_set("dst")).alias("parents"))
    children = edges.groupBy(F.col("dst").alias("node")).agg(F.array_sort(F.collect_set("src")).alias("children"))
    props = domain.groupBy(F.col("class_key").alias("node")).agg(F.array_sort(F.collect_set("prop")).alias("props"))
    return parents.join(children, "node", "full_outer").join(props, "node", "full_outer")


def paths(edges: DataFrame, roots: DataFrame, cap: int | None = None) -> DataFrame:
    """Every simple path from the roots against the edges (parent to child), of at most cap edges if it is given: path, depth."""
    e = edges.select(F.col("dst").alias("node"), F.col("src").alias("_child"))
    walk = cut(roots.select("node", F.array("node").alias("path"), F.lit(0).alias("depth")))
    out, depth = walk, 0
    while cap is None or depth < cap:
        depth += 1
        step = walk.join(e, "node").where(~F.array_contains("path", F.col("_child")))
        walk = cut(step.select(F.col("_child").alias("node"), F.concat("path", F.array("_child")).alias("path"), F.lit(depth).alias("depth")))
        if not walk.limit(1).count():
            break
        out = out.unionByName(walk)
    return out


def outline(edges: DataFrame, roots: DataFrame, labels: DataFrame) -> DataFrame:
    """Indented lines in pre-order by label: sort_key (array of labels), line."""
    named = labels.select("node", "label")
    e = edges.join(named.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), F.col("src").alias("_child"), F.col("label").alias("_label"))
    walk = cut(roots.join(named, "node").select("node", F.array("label").alias("sort_key"), F.array("node").alias("path")))
    out = walk
    while True:
        step = walk.join(e, "node").where(~F.array_contains("path", F.col("_child")))
        walk = cut(step.select(F.col("_child").alias("node"), F.concat("sort_key", F.array("_label")).alias("sort_key"), F.concat("path", F.array("_child")).alias("path")))
        if not walk.limit(1).count():
            break
        out = out.unionByName(walk)
    line = F.concat(F.repeat(F.lit("  "), F.size("sort_key") - 1), F.lit("- "), F.element_at("sort_key", -1))
    return out.select(F.array_join("sort_key", "/").alias("sort_key"), line.alias("line"))


def shortest_paths(edges: DataFrame, start) -> DataFrame:
    """One shortest undirected path from start to every node it reaches: node, path (the smallest of equals)."""
    both = cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    known = cut(both.where(F.col("src") == start).select(F.col("src").alias("node")).distinct().select("node", F.array("node").alias("path")))
    frontier = known
    while True:
        step = frontier.join(both.select(F.col("src").alias("node"), "dst"), "node").join(known.select(F.col("node").alias("dst")), "dst", "left_anti")
        frontier = cut(step.groupBy(F.col("dst").alias("node")).agg(F.min(F.concat("path", F.array("dst"))).alias("path")))
        if not frontier.limit(1).count():
            break
        known = cut(known.unionByName(frontier))
    return known


def imports_dag(edges: DataFrame, names: DataFrame, root=None, direction: str = "both", max_depth: int = 20) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, name) and edges (src, dst) of the imports graph: all of it, or what the root imports (outbound), what imports it (inbound), or both.

    The depth is held to 1..50.  Nodes are sorted by lower-cased name and key, edges by their ends.
    """
    if direction not in ("outbound", "inbound", "both"):
        raise ValueError(f"no such direction: {direction}")
    e = edges.select("src", "dst").distinct()
    if root is not None:
        max_depth = max(1, min(int(max_depth), 50))
        sides = []
        for name, reverse, near in (("outbound", False, "src"), ("inbound", True, "dst")):
            if direction in (name, "both"):
                reached = closure(edges, [root], max_depth, reverse).where(F.col("depth") < max_depth)
                sides.append(e.join(reached.select(F.col("node").alias(near)), near, "left_semi").select("src", "dst"))
        e = reduce(DataFrame.unionByName, sides).distinct()
    nodes = incident(e)
    if root is not None:
        nodes = nodes.union(names.where(F.col("node") == root).select("node")).distinct()
    named = nodes.join(names.select("node", "name"), "node", "left").select("node", "name")
    return named.orderBy(F.lower(F.coalesce("name", F.col("node").cast("string"))), "node"), e.orderBy("src", "dst")


def incident(edges: DataFrame) -> DataFrame:
    """All end points of edges, once."""
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each group in the order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
