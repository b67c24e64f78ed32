"""Graph operators over edge tables (src, dst)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import scores
from quarry.sources.checkpoints import cut


def nodes(edges: DataFrame) -> DataFrame:
    """Every end of an edge; a file without edges is no node."""
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("src") == node).select(F.col("dst").alias("node")).distinct()


def dependents(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("dst") == node).select(F.col("src").alias("node")).distinct()


def depends(edges: DataFrame, src: str, dst: str) -> bool:
    return bool(edges.where((F.col("src") == src) & (F.col("dst") == dst)).head(1))


def two_hop_dependents(edges: DataFrame, node: str) -> DataFrame:
    """Those that depend on the node, and on these."""
    first = edges.where(F.col("dst") == node).select(F.col("src").alias("node"))
    second = edges.join(first.distinct(), F.col("dst") == F.col("node")).select(F.col("src").alias("node"))
    return first.union(second).where(F.col("node") != node).distinct()


def hop_scores(edges: DataFrame, seeds: Sequence[str], bidirectional: bool = False) -> DataFrame:
    """(node, score) of every node. Beyond two hops all scores are equal, so two joins are enough."""
    edges = edges.select("src", "dst")
    both = edges.unionByName(reversed_edges(edges)).distinct() if bidirectional else edges
    zero = nodes(edges).where(F.col("node").isin(*seeds)) if seeds else nodes(edges).limit(0)
    one = both.join(zero, F.col("src") == F.col("node")).select(F.col("dst").alias("node")).distinct()
    two = both.join(one, F.col("src") == F.col("node")).select(F.col("dst").alias("node")).distinct()
    levels = zero.withColumn("hop", F.lit(0)).unionByName(one.withColumn("hop", F.lit(1))).unionByName(two.withColumn("hop", F.lit(2)))
    reached = levels.groupBy("node").agg(F.min("hop").alias("hop"))
    return nodes(edges).join(reached, "node", "left").select("node", scores.hop_score(F.col("hop")).alias("score"))


def in_degrees(edges: DataFrame) -> DataFrame:
    """(node, dependents) of every node, zeros included."""
    counted = edges.select("src", "dst").distinct().groupBy("dst").agg(F.count("*").alias("dependents"))
    return nodes(edges).join(counted, F.col("node") == F.col("dst"), "left").select("node", F.coalesce("dependents", F.lit(0)).alias("dependents"))


def hotspots(edges: DataFrame, limit: int = 10) -> DataFrame:
    return in_degrees(edges).orderBy(F.desc("dependents"), "node").limit(limit)


def shortest_path(edges: DataFrame, start: str, end: str, most: int | None = None) -> DataFrame:
    """(place, node) of the shortest directed path; of paths of one length the first in order. Empty if there is none.

    Steps to the end are counted level by level from the end backwards: nodes seen before fall
    out by an anti-join, and lineage is cut at every level. It stops at the start or when nothing
    is new, at the latest after as many levels as there are nodes. Then the path is walked from
    the start, each time to the first node that is a step nearer; no row holds more than a node.
    """
    spark = edges.sparkSession
    levels = [cut(nodes(edges).where(F.col("node") == end))]
    seen = levels[0]
    while not (found := bool(levels[-1].where(F.col("node") == start).head(1))):
        if not levels[-1].head(1) or (most is not None and len(levels) > most):
            break
        step = edges.join(levels[-1], F.col("dst") == F.col("node")).select(F.col("src").alias("node")).distinct()
        levels.append(cut(step.join(seen, "node", "left_anti")))
        seen = cut(seen.unionByName(levels[-1]))
    path = [start] if found else []
    for level in reversed(levels[:-1] if found else []):
        nearer = edges.where(F.col("src") == path[-1]).join(level, F.col("dst") == F.col("node"))
        path.append(nearer.agg(F.min("dst").alias("dst")).first()["dst"])
    return spark.createDataFrame(list(enumerate(path)), "place int, node string")


def reachable(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, hop): nodes within 1 to `depth` steps of the seeds (node), by fewest steps; a seed comes back if it lies on a cycle."""
    step = seeds.select("node").distinct()
    out = None
    for hop in range(1, max(1, depth) + 1):
        step = edges.join(step, F.col("src") == F.col("node")).select(F.col("dst").alias("node")).distinct()
        if out is not None:
            step = step.join(out, "node", "left_anti")
        level = step.withColumn("hop", F.lit(hop))
        out = level if out is None else out.unionByName(level)
    return out


def call_key(file: str, symbol: str):
    return F.struct(F.col(file).alias("file"), F.col(symbol).alias("symbol"))


def call_neighbours(calls: DataFrame, symbol: str, incoming: bool, depth: int = 2, file_hint: str | None = None) -> DataFrame:
    """(file, symbol, hop) of callers or callees over resolved calls (caller_file, caller_sym, callee_file, callee_name)."""
    known = calls.where(F.col("callee_file").isNotNull())
    a, b = call_key("caller_file", "caller_sym"), call_key("callee_file", "callee_name")
    edges = known.select((b if incoming else a).alias("src"), (a if incoming else b).alias("dst")).distinct()
    start = edges.select(F.col("src").alias("node")).where(F.col("node.symbol") == symbol)
    if file_hint:
        start = start.where((F.col("node.file") == file_hint) | F.col("node.file").endswith(file_hint))
    return reachable(edges, start, depth).select("node.file", "node.symbol", "hop").orderBy("file", "symbol")


def fan_in(calls: DataFrame) -> DataFrame:
    """(callee_name, fan_in): distinct callers of each name over resolved calls."""
    return calls.where(F.col("callee_file").isNotNull()).groupBy("callee_name").agg(F.countDistinct(call_key("caller_file", "caller_sym")).alias("fan_in"))


def trimmed(edges: DataFrame) -> DataFrame:
    """edges (src, dst) without those at nodes that have no way in or none out, until all have both."""
    left, n = cut(edges), -1
    while (now := left.count()) != n:
        n = now
        left = cut(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
    return left


def cycle_members(edges: DataFrame) -> DataFrame:
    """(node) of those that reach themselves: the strongly connected components of more than a node, and self-loops.

    Each round trims what lies on no cycle, colours every node with the smallest node that reaches it, and takes
    as one component what reaches its colour's node inside the colour. Rows are a colour a node, never pairs of nodes.
    """
    left = trimmed(edges.select("src", "dst").distinct())
    out = edges.select(F.col("src").alias("node")).limit(0)
    while left.head(1):
        colours, changed = cut(nodes(left).withColumn("colour", F.col("node"))), 1
        while changed:
            passed = left.join(colours, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("other"))
            after = cut(colours.join(passed, "node").select("node", F.least("colour", "other").alias("colour"), (F.col("other") < F.col("colour")).alias("moved")))
            changed, colours = after.where("moved").count(), after.drop("moved")
        inside = left.join(colours.withColumnRenamed("node", "src"), "src").join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("other")), "dst").where("colour = other")
        inside = cut(inside.select("src", "dst", "colour"))
        found = fresh = cut(colours.where("node = colour").select("node"))
        while fresh.head(1):
            fresh = cut(inside.join(fresh, F.col("dst") == F.col("node")).select(F.col("src").alias("node")).distinct().join(found, "node", "left_anti"))
            found = cut(found.unionByName(fresh))
        closed = inside.join(found.withColumnRenamed("node", "src"), "src", "left_semi").join(found.withColumnRenamed("node", "dst"), "dst", "left_semi")
        out = out.unionByName(closed.select(F.col("src").alias("node")).distinct())
        rest = left.join(found.withColumnRenamed("node", "src"), "src", "left_anti").join(found.withColumnRenamed("node", "dst"), "dst", "left_anti")
        left = trimmed(rest)
    return out.distinct()


def cycle_path(edges: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(place, node) of a shortest cycle through the first node that lies on one, which is at both ends; empty without a cycle."""
    start = (cycle_members(edges) if members is None else members).agg(F.min("node").alias("node")).first()["node"]
    if start is None:
        return edges.sparkSession.createDataFrame([], "place int, node string")
    end = f"{start}\0"
    way = shortest_path(edges.select("src", F.when(F.col("dst") == start, end).otherwise(F.col("dst")).alias("dst")), start, end)
    return way.select("place", F.when(F.col("node") == end, start).otherwise(F.col("node")).alias("node"))
