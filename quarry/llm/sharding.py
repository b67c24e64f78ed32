"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each level every child node draws
-ln(u) / weight, with u a hash of (level, node, key), and the smallest draw wins,
so a child is chosen in proportion to its weight. A changed weight alters draws of
that node alone: rows move only into or out of the subtrees whose weights change.
`grown` adds a subtree of its own at the top, so one more shard takes rows only
into itself.

Slots (gapless numbers inside each shard) come from cells (shard, bucket of a hash of
id and text): cell counts give offsets, and only cells are sorted, never whole shards.
There are more cells if there are more rows. Identical rows are counted before the
shuffle and expanded again at the end, so they have slots one after the other.

Nulls: a null id is a key of its own; a null text has size 16 and crc32 0. Rows with one
id are in one shard, in the order of crc32 and size. Texts of any length count whole.
Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarry.llm.common import cut, hex_long, id_text, table

LAW = "key"
SALT = "tree"
#: Cells of a shard at least, and the rows that one should hold at most.
CELLS, PER_CELL = 1024, 100_000
#: Up to so many offsets of cells are broadcast.
BROADCAST_CELLS = 2_000_000
#: Copies of one row that one generated array holds at most; more copies use more arrays.
BLOCK = 1 << 16


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(shards: int, per_rack: int = 2, per_region: int = 8) -> list[Leaf]:
    """Shards 0..n-1 dealt to racks of `per_rack` and regions of `per_region` shards."""
    return [Leaf(i // per_region, i // per_rack, i) for i in range(shards)]


def grown(leaves: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard in a region and rack of its own."""
    new = [max(x) + 1 for x in zip(*((leaf.region, leaf.rack, leaf.shard) for leaf in leaves), strict=True)]
    return [*leaves, Leaf(*new, weight)]


def levels(leaves: Sequence[Leaf]) -> list[dict[int, dict[int, float]]]:
    """For region, rack and shard: parent -> child -> weight of all leaves below."""
    out: list[dict[int, dict[int, float]]] = [{}, {}, {}]
    for leaf in leaves:
        for level, (parent, child) in zip(out, ((0, leaf.region), (leaf.region, leaf.rack), (leaf.rack, leaf.shard)), strict=True):
            nodes = level.setdefault(parent, {})
            nodes[child] = nodes.get(child, 0.0) + leaf.weight
    return out


def draw(key: Column, level: int, node: Column, weight: Column) -> Column:
    u = (hex_long(F.md5(F.concat(F.lit(f"{SALT}|{level}|"), node.cast("string"), F.lit("|"), key)), 1, 13) + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def drawn(key: Column, level: int) -> Callable[[Column], Column]:
    return lambda child: F.struct(draw(key, level, child["node"], child["weight"]).alias("drawn"), child["node"].alias("node"))


def descend(key: Column, leaves: Sequence[Leaf]) -> Column:
    """The shard of a key."""
    at = F.lit(0)
    for level, parents in enumerate(levels(leaves)):
        children = F.create_map(*(x for parent, nodes in parents.items() for x in (F.lit(parent), F.array(*(F.struct(F.lit(n).alias("node"), F.lit(float(w)).alias("weight")) for n, w in nodes.items())))))
        at = F.array_min(F.transform(F.element_at(children, at), drawn(key, level)))["node"]
    return at


def numbered(rows: DataFrame, group: str, groups: int, order: Sequence[str], key: Column) -> DataFrame:
    """Adds `slot`, gapless from 0 in each `group`; identical rows get consecutive slots.

    rows are counted first, so that copies of one row meet as one row and a number.
    """
    names = rows.columns
    counted = cut(rows.groupBy(*names).agg(F.count("*").alias("copies")))
    cells = max(CELLS, -(-counted.count() // (groups * PER_CELL)))
    counted = counted.withColumn("cell", hex_long(F.md5(F.concat(F.lit("slot|"), key)), 1, 8) % cells)
    sums = counted.groupBy(group, "cell").agg(F.sum("copies").alias("rows"))
    offsets = sums.withColumn("offset", F.sum("rows").over(Window.partitionBy(group).orderBy("cell")) - F.col("rows")).drop("rows")
    inside = Window.partitionBy(group, "cell").orderBy(*(F.col(x).asc_nulls_first() for x in order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # offsets has one row for each group and cell
    placed = counted.withColumn("before", F.sum("copies").over(inside) - F.col("copies")).join(F.broadcast(offsets) if groups * cells <= BROADCAST_CELLS else offsets, [group, "cell"])
    first = F.col("offset") + F.col("before")
    blocks = placed.withColumn("start", F.explode(F.sequence(first, first + F.col("copies") - 1, F.lit(BLOCK).cast("long"))))
    until = F.least(F.col("start") + (BLOCK - 1), first + F.col("copies") - 1)
    return blocks.withColumn("slot", F.explode(F.sequence(F.col("start"), until))).select(*names, "slot")


def assign(docs: DataFrame, leaves: Sequence[Leaf], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs."""
    payload = F.col(text).cast("binary")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(payload), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(payload, F.lit(b""))).alias("text_crc32"),
    )
    key = id_text("doc_id")
    rows = rows.withColumn("shard", descend(key, leaves)).withColumn("grown_shard", descend(key, grown(leaves)))
    out = numbered(rows, "shard", len(leaves), ["doc_id", "text_crc32", "size"], F.concat_ws("|", key, F.col("text_crc32").cast("string")))
    return out.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), F.col("shard").cast(T.IntegerType()), F.col("slot").cast(T.LongType()), F.col("grown_shard").cast(T.IntegerType()))


SHARDS = 40


def op2_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents", "doc_id", "text"), tree(SHARDS))


def _oracle() -> str:
    def chain(leaves: Sequence[Leaf], tag: str) -> str:
        parts, before = [], "SELECT DISTINCT k, 0 AS node FROM d"
        for level, parents in enumerate(levels(leaves)):
            values = ", ".join(f"({p}, {n}, {w!r})" for p, nodes in parents.items() for n, w in nodes.items())
            u = f"((('0x' || substr(md5('{SALT}|{level}|' || v.n || '|' || b.k), 1, 13))::BIGINT + 0.5::DOUBLE) / {1 << 52}::DOUBLE)"
            parts.append(f"{tag}{level} AS (SELECT k, arg_min(n, dr) AS node FROM (SELECT b.k, v.n, -ln({u}) / v.w AS dr FROM ({before}) b JOIN (VALUES {values}) v(p, n, w) ON v.p = b.node) GROUP BY k)")
            before = f"SELECT k, node FROM {tag}{level}"
        return ", ".join(parts)

    leaves = tree(SHARDS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, coalesce(octet_length(encode(text)), 0) + 16 AS size, coalesce(text, '') AS t FROM documents),
{chain(leaves, "s")}, {chain(grown(leaves), "g")},
crc AS (
  SELECT t, xor(list_reduce([4294967295::UBIGINT] || list_transform(range(0, octet_length(encode(t))), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::UBIGINT),
      lambda acc, b: xor(acc >> 8, tab[(xor(acc & 255, b) + 1)::BIGINT])), 4294967295::UBIGINT) AS text_crc32
  FROM (SELECT DISTINCT t, hex(encode(t)) AS h FROM d), (SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([i::UBIGINT] || [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i))))
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, '{LAW}' AS law, s2.node::INTEGER AS shard,
  (row_number() OVER (PARTITION BY s2.node ORDER BY ('0x' || substr(md5('slot|' || k || '|' || text_crc32), 1, 8))::BIGINT % {CELLS}, doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS slot, g2.node::INTEGER AS grown_shard
FROM d JOIN s2 USING (k) JOIN g2 USING (k) JOIN crc USING (t)
"""


QUERIES = {"op2_hash_tree_shards": op2_hash_tree_shards}
ORACLES = {"op2_hash_tree_shards": _oracle()}
