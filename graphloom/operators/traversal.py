"""Graph traversal over any edges(src, dst) table: bounded traces, closures, cycles, orders, dead code.

Loops run on the driver, rows stay distributed; every round's frontier is checkpointed and loops end at a fixed point.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.lineage import cut, is_empty


def trace(edges: DataFrame, start: DataFrame, depth: int, inbound: bool = False, max_results: int | None = None) -> DataFrame:
    """Edges met going out (or in) from the start nodes, each once with the hop at which it is first met.

    start: one column node. Breadth first, every node is expanded once. Result (src, dst, depth); max_results keeps the
    first in the order of (depth, src, dst).
    """
    a, b = ("dst", "src") if inbound else ("src", "dst")
    e = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    frontier = cut(start.select(F.col("node")).where("node is not null").distinct())
    seen, out = frontier, None
    for hop in range(1, depth + 1):
        step = cut(e.join(frontier, F.col(a) == F.col("node"), "left_semi").select("src", "dst", F.lit(hop).alias("depth")))
        out = step if out is None else out.unionAll(step)
        if hop == depth:
            break
        frontier = cut(step.select(F.col(b).alias("node")).distinct().join(seen, "node", "left_anti"))
        if is_empty(frontier):
            break
        seen = cut(seen.unionAll(frontier))
    if out is None:
        out = e.select("src", "dst", F.lit(0).alias("depth")).where(F.lit(False))
    return out if max_results is None else out.orderBy("depth", "src", "dst").limit(max_results)


def reach(edges: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, node, level): nodes reachable from each start node, at their least distance; the root itself is left out."""
    e = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    seen = cut(start.select(F.col("node").alias("root"), "node", F.lit(0).alias("level")).distinct())
    frontier, level = seen, 0
    while max_depth is None or level < max_depth:
        level += 1
        nxt = frontier.join(e, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        frontier = cut(nxt.join(seen, ["root", "node"], "left_anti").withColumn("level", F.lit(level)))
        if is_empty(frontier):
            break
        seen = cut(seen.unionAll(frontier))
    return seen.where("level > 0")


def strongly_connected(edges: DataFrame) -> DataFrame:
    """(node, component) of the strongly connected components with more than one node; component is the least node.

    Nodes without way in or out are trimmed; then each node takes the least node that reaches it (forward colours), and
    what the colour's own node is reached from within its colour is a component (backward). Repeats on the rest.
    """
    e = cut(edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct())
    out = None
    while True:
        while True:  # trim
            n = e.count()
            e = cut(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            if e.count() == n:
                break
        if is_empty(e):
            break
        colour = cut(e.select(F.col("src").alias("node")).unionAll(e.select("dst")).distinct().withColumn("colour", F.col("node")))
        while True:
            came = e.join(colour, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("c"))
            nxt = cut(colour.join(came, "node", "left").select("node", F.least("colour", "c").alias("colour"), (F.coalesce("c", "colour") < F.col("colour")).alias("moved")))
            colour = nxt.select("node", "colour")
            if is_empty(nxt.where("moved")):
                break
        inside = cut(
            e.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("cd")), "dst").where("cs = cd").select("src", "dst", "cs")
        )
        comp = frontier = cut(colour.where("node = colour"))
        while True:
            nxt = inside.join(frontier, (F.col("dst") == F.col("node")) & (F.col("cs") == F.col("colour")), "left_semi").select(F.col("src").alias("node"), F.col("cs").alias("colour")).distinct()
            frontier = cut(nxt.join(comp, ["node", "colour"], "left_anti"))
            if is_empty(frontier):
                break
            comp = cut(comp.unionAll(frontier))
        out = comp if out is None else out.unionAll(comp)
        e = cut(e.join(comp.select(F.col("node").alias("src")), "src", "left_anti").join(comp.select(F.col("node").alias("dst")), "dst", "left_anti"))
    if out is None:
        return e.select(F.col("src").alias("node"), F.col("src").alias("component"))
    size = out.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1")
    return out.join(size, "colour").select("node", F.col("colour").alias("component"))


def topological_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, level) with level 0 for nodes nothing uses; cycles share a level, as they are condensed first.

    Level of a node is one more than the greatest level of the components that lead to it.
    """
    scc = strongly_connected(edges)
    rep = cut(nodes.select("node").distinct().join(scc, "node", "left").select("node", F.coalesce("component", "node").alias("rep")))
    s, d = rep.select(F.col("node").alias("src"), F.col("rep").alias("s")), rep.select(F.col("node").alias("dst"), F.col("rep").alias("d"))
    e = cut(edges.select("src", "dst").join(s, "src").join(d, "dst").where("s <> d").select("s", "d").distinct())
    level = cut(rep.select(F.col("rep").alias("n")).distinct().withColumn("level", F.lit(0)))
    while True:
        up = e.join(level, F.col("s") == F.col("n")).groupBy(F.col("d").alias("n")).agg((F.max("level") + 1).alias("l2"))
        nxt = cut(level.join(up, "n", "left").select("n", F.greatest("level", F.coalesce("l2", F.lit(0))).alias("level"), (F.coalesce("l2", F.lit(0)) > F.col("level")).alias("moved")))
        level = nxt.select("n", "level")
        if is_empty(nxt.where("moved")):
            return rep.join(level, F.col("rep") == F.col("n")).select("node", "level")


def dead(nodes: DataFrame, edges: DataFrame, rounds: int = 1) -> DataFrame:
    """(node, round): nodes nothing uses in round 1; in later rounds those only dead ones use. Self-use doesn't count."""
    e = edges.select("src", "dst").where("src <> dst").distinct()
    n = nodes.select("node").distinct()
    gone = None
    for i in range(1, rounds + 1):
        live = e if gone is None else e.join(gone.select(F.col("node").alias("src")), "src", "left_anti")
        rest = n if gone is None else n.join(gone, "node", "left_anti")
        now = cut(rest.join(live.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").select("node", F.lit(i).alias("round")))
        if is_empty(now):
            return now if gone is None else gone
        gone = now if gone is None else cut(gone.unionAll(now))
    return gone


def follow(next_of: DataFrame, max_hops: int = 64) -> DataFrame:
    """(node, target) of chains in next_of(node, next): the last node of each chain, by pointer jumping; on a cycle null."""
    p = cut(next_of.select("node", "next").where("node is not null"))
    for _ in range(max_hops):
        j = p.select(F.col("node").alias("n2"), F.col("next").alias("nn"))
        q = cut(p.join(j, F.col("next") == F.col("n2"), "left").select("node", F.coalesce("nn", "next").alias("next"), (F.col("nn").isNotNull() & (F.col("nn") != F.col("next"))).alias("moved")))
        if is_empty(q.where("moved")):
            break
        p = q.select("node", "next")
    ends = p.join(p.select(F.col("node").alias("n2")).distinct(), F.col("next") == F.col("n2"), "left")
    return ends.select("node", F.when(F.col("n2").isNull(), F.col("next")).alias("target"))


def prune_degree(edges: DataFrame, least: int = 2) -> DataFrame:
    """Edges whose ends both have at least `least` edges."""
    e = edges.select("src", "dst").distinct()
    ends = e.select(F.col("src").alias("node")).unionAll(e.select("dst"))
    keep = ends.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("node")
    return e.join(keep.withColumnRenamed("node", "src"), "src", "left_semi").join(keep.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between nodes of the set."""
    n = nodes.select("node").distinct()
    return edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi").select(*edges.columns)
