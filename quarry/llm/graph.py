"""Joins on keys that may be hot, and connected components.

A key with over 1/HOT of all rows is one of fewer than HOT such keys, whatever the
input. So the single rows that belong to hot keys are broadcast and the many rows of
such keys stay where they are; only the rows of other keys are dealt by key. Keys of up
to FLOOR rows are never hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut

#: Fewer keys than this are hot, which bounds what is broadcast.
HOT, FLOOR = 1000, 500
#: Rows of a task, where so many are known to be few for a shuffle's partitions: each task and each file costs more than they do.
TASK_ROWS = 20_000


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """df of up to about `rows` rows in fewer partitions, if it has more than these rows and the cores need; rows aren't dealt anew."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, rows // TASK_ROWS))


def packed(df: DataFrame, rows: int) -> DataFrame:
    """cut(df), gathered."""
    return cut(gathered(df, rows))


def matched(rows: DataFrame, one: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows joined with one, which must be cheap to read twice and has a row for each key and the number of its rows in `count`; rows has `total` rows."""
    hot = F.col(count) > max(float(FLOOR), total / HOT)
    other = [c for c in one.columns if c != key]
    if total <= FLOOR or one.where(hot).isEmpty():
        return rows.join(one, key).select(*rows.columns, *other)
    hubs = one.where(hot).select(key, F.struct(*other).alias("_hot"))
    rest = one.where(~hot).select(key, F.lit(0).alias("_salt"), F.struct(*other).alias("_cold"))
    # the rows of hot keys have salts that meet nothing, so that they are spread
    salt = F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(*(c for c in rows.columns if c != key)), F.lit(1 << 20)).cast("int"))
    out = rows.join(F.broadcast(hubs), key, "left").withColumn("_salt", salt).join(rest, [key, "_salt"], "left")
    got = F.coalesce("_hot", "_cold")
    return out.where(got.isNotNull()).select(*rows.columns, *(got[c].alias(c) for c in other))


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """One step: links each node's neighbours to the smallest node around it. edges: n rows, u > v."""
    degree = F.count("*").alias("degree")
    if large:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = packed(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), degree), 2 * n)
        return matched(both, least, "u", "degree", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = packed(edges.groupBy("u").agg(F.min("v").alias("m"), degree), n)
    out = matched(edges, least, "u", "degree", n).select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame, left: str, right: str, most: int | None = None) -> DataFrame:
    """(node, root) for every node of an edge that isn't its component's smallest node; root is that smallest node. most: edges at most, if known.

    Large and small stars alternate until every node has one edge to a node that has none to a smaller one.
    """
    a, b = F.col(left), F.col(right)
    now = edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = cut(now) if most is None else packed(now, most)
    while not settled(now, n := now.count()):
        # a large star keeps the number of edges or lowers it
        now = packed(_star(packed(_star(now, True, n), n), False, n), n)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def settled(edges: DataFrame, n: int) -> bool:
    zero, one = F.lit(0), F.lit(1)
    ends = edges.select(F.col("u").alias("x"), one.alias("up"), zero.alias("down")).unionAll(edges.select("v", zero, one))
    return gathered(ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 AND up > 0"), 2 * n).isEmpty()
