"""Graph operators over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import graph
from quarry.plans.tables import SUPPLY_SQL, order_calls, supply_edges, table


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("url", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1)).alias("dst")).select(F.col("url").alias("src"), "dst").distinct()


def hotspots_links(spark, sf_dir):
    return graph.hotspots(_links(spark, sf_dir), 10)


def dependents_links(spark, sf_dir):
    return graph.dependents(_links(spark, sf_dir), "/the").select(F.col("node").alias("url"))


def hotspots_supply(spark, sf_dir):
    return graph.hotspots(supply_edges(spark, sf_dir), 20)


def neighbours_of_part(spark, sf_dir):
    return graph.neighbours(supply_edges(spark, sf_dir), "p7")


def hop_scores_directed(spark, sf_dir):
    return graph.hop_scores(supply_edges(spark, sf_dir), ["p7"])


def hop_scores_bidirectional(spark, sf_dir):
    return graph.hop_scores(supply_edges(spark, sf_dir), ["s3"], True)


def shortest_path_part_region(spark, sf_dir):
    return graph.shortest_path(supply_edges(spark, sf_dir), "p7", "r1")


def two_hop_dependents(spark, sf_dir):
    return graph.two_hop_dependents(supply_edges(spark, sf_dir), "n3")


def call_fan_in(spark, sf_dir):
    return graph.fan_in(order_calls(spark, sf_dir))


def callers_of_part(spark, sf_dir):
    return graph.call_neighbours(order_calls(spark, sf_dir), "p42", True, 1)


def callees_of_order(spark, sf_dir):
    return graph.call_neighbours(order_calls(spark, sf_dir), "o32", False, 2)


def cycle_nodes(spark, sf_dir):
    """Nations and regions: each nation points to its region, each region back to its first nation."""
    nation = table(spark, sf_dir, "nation")
    there = nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dst"))
    back = nation.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("n")).select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("n").cast("string")).alias("dst"))
    return graph.cycle_members(there.unionByName(back))


QUERIES = {f.__name__: f for f in (hotspots_links, dependents_links, hotspots_supply, neighbours_of_part, hop_scores_directed, hop_scores_bidirectional, shortest_path_part_region, two_hop_dependents, call_fan_in, callers_of_part, callees_of_order, cycle_nodes)}

_E = f"e AS ({SUPPLY_SQL}), nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e)"
_LINKS = """l AS (SELECT DISTINCT url AS src, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS dst FROM pages)"""
_C = "c AS (SELECT 'o' || l_orderkey AS o, 'p' || l_partkey AS p FROM lineitem WHERE l_linenumber < 7)"


def _hops(edges: str, seed: str) -> str:
    return f"""h1 AS (SELECT DISTINCT dst AS node FROM {edges} WHERE src = '{seed}'), h2 AS (SELECT DISTINCT dst AS node FROM {edges} JOIN h1 ON src = node),
hop AS (SELECT node, min(hop) AS hop FROM (SELECT '{seed}' AS node, 0 AS hop UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2) GROUP BY node)
SELECT node, CASE hop WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.25 ELSE 0.1 END::DOUBLE AS score FROM nodes LEFT JOIN hop USING (node)"""


_HOT = "SELECT node, count(dst) AS dependents FROM {n} LEFT JOIN {e} ON dst = node GROUP BY node ORDER BY dependents DESC, node LIMIT {k}"
ORACLES = {
    "hotspots_links": f"WITH {_LINKS}, n AS (SELECT src AS node FROM l UNION SELECT dst FROM l) " + _HOT.format(n="n", e="l", k=10),
    "dependents_links": f"WITH {_LINKS} SELECT DISTINCT src AS url FROM l WHERE dst = '/the'",
    "hotspots_supply": f"WITH {_E} " + _HOT.format(n="nodes", e="e", k=20),
    "neighbours_of_part": f"WITH {_E} SELECT DISTINCT dst AS node FROM e WHERE src = 'p7'",
    "hop_scores_directed": f"WITH {_E}, {_hops('e', 'p7')}",
    "hop_scores_bidirectional": f"WITH {_E}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), {_hops('b', 's3')}",
    "shortest_path_part_region": f"""WITH RECURSIVE {_E}, w AS (SELECT 'p7' AS node, ['p7'] AS path UNION ALL SELECT dst, list_append(path, dst) FROM w JOIN e ON src = node WHERE len(path) < 6 AND NOT list_contains(path, dst)),
b AS (SELECT path FROM w WHERE node = 'r1' ORDER BY len(path), path LIMIT 1)
SELECT (i - 1)::INTEGER AS place, path[i] AS node FROM (SELECT path, unnest(range(1, len(path) + 1)) AS i FROM b)""",
    "two_hop_dependents": f"WITH {_E}, f AS (SELECT src AS node FROM e WHERE dst = 'n3') SELECT node FROM f UNION SELECT src FROM e JOIN f ON dst = node",
    "call_fan_in": f"WITH {_C} SELECT p AS callee_name, count(DISTINCT o) AS fan_in FROM c GROUP BY p",
    "callers_of_part": f"WITH {_C} SELECT DISTINCT 'orders' AS file, o AS symbol, 1 AS hop FROM c WHERE p = 'p42'",
    "callees_of_order": f"WITH {_C} SELECT DISTINCT 'parts' AS file, p AS symbol, 1 AS hop FROM c WHERE o = 'o32'",
    "cycle_nodes": "SELECT 'r' || n_regionkey AS node FROM nation UNION SELECT 'n' || min(n_nationkey) FROM nation GROUP BY n_regionkey",
}
