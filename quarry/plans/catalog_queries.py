"""Queries of the index catalog and of smaller operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import docs, graph, intel, packages, search
from quarry.plans.catalog import Catalog
from quarry.plans.fixtures import docs as doc_files
from quarry.plans.fixtures import files as code_files
from quarry.plans.fixtures import values
from quarry.plans.intel_queries import node_symbols, part_symbols
from quarry.plans.tables import files, order_calls, supply_edges, table
from quarry.sources import repos


def _harbour(spark: SparkSession) -> Catalog:
    return Catalog(code_files(spark, "harbour"), doc_files(spark))


def file_entries(spark, sf_dir):
    return _harbour(spark).file_entries().select("path", F.array_join(F.transform("symbols", lambda s: s["name"]), ",").alias("symbols"), F.array_join("depends_on", ",").alias("depends_on"), F.array_join("depended_by", ",").alias("depended_by"))


def doc_briefs(spark, sf_dir):
    c = _harbour(spark)
    stale = c.sections.select("id", F.col("heading").endswith("Lifting").alias("stale"))
    return docs.briefs(c.sections, c.links, stale, c.files, 20)


def encoded_symbols(spark, sf_dir):
    return packages.encoded_symbols(_harbour(spark).symbols).select("path", "line", "json")


def resolved_hints(spark, sf_dir):
    c = _harbour(spark)
    out = None
    for hint in ("tide.rs", "CRANE", "berth", "metres"):
        part = intel.resolve_hint(c.edges, c.symbols, hint).select(F.lit(hint).alias("hint"), "path")
        out = part if out is None else out.unionByName(part)
    return out


def task_symbols(spark, sf_dir):
    c = _harbour(spark)
    return intel.task_context(c.index(), c.edges, c.symbols, "crane hook ship", "src/crane/hook.rs")[1]


def convention_examples(spark, sf_dir):
    return packages.examples(_harbour(spark).symbols, "crane")


def definitions(spark, sf_dir):
    return intel.definitions(part_symbols(spark, sf_dir), "red widget").select("path", "line")


def references(spark, sf_dir):
    return intel.definitions(part_symbols(spark, sf_dir), "widget", "Brand#7", exact=False).select("path", "name", "line")


def folder_listing(spark, sf_dir):
    return repos.listing(files(spark, sf_dir), "src1")


def layer_violations(spark, sf_dir):
    """Parts, suppliers, nations and regions as layers by the first letter of their nodes."""
    layers = [("part", ["p*"]), ("supplier", ["s*"]), ("nation", ["n*"]), ("region", ["r*"])]
    found = intel.violations(supply_edges(spark, sf_dir), layers, [("supplier", "nation")], [("part", "supplier")])
    return found.groupBy("src_layer", "dst_layer", "reason").agg(F.count("*").alias("n"))


def layer_checked(spark, sf_dir):
    return intel.checked_edges(supply_edges(spark, sf_dir), [("part", ["p*"]), ("nation", ["n*"]), ("region", ["r*"])])


def feature_guide(spark, sf_dir):
    """What to read for a question, over the code and its manual."""
    c = _harbour(spark)
    return intel.feature_guide(c.index(), c.edges, c.symbols, "berth tide", c.sections.withColumn("text", F.col("snippet")), 4)


def encoded_packages(spark, sf_dir):
    """Brands as packages of parts, with short keys."""
    s = part_symbols(spark, sf_dir)
    own = s.groupBy("repo", "package").agg(F.countDistinct("line").alias("files"), F.lit(0.5).alias("score"))
    return packages.encoded_packages(own, packages.purposes(s, s.select("repo", "package").distinct().withColumn("tags", F.array().cast("array<string>")))).select("package", "json")


def encoded_impacts(spark, sf_dir):
    found = intel.change_impact(node_symbols(spark, sf_dir), supply_edges(spark, sf_dir), order_calls(spark, sf_dir), ["NATION_2", "NATION_7"], exact=False)
    return packages.encoded_impacts(found).select("symbol", "json")


def encoded_signals(spark, sf_dir):
    """The signals of loop ticks with short keys."""
    from quarry.plans.state_queries import loop_signals

    return packages.encoded_signals(loop_signals(spark, sf_dir)).select("session", "iteration", "json")


def encoded_details(spark, sf_dir):
    return packages.encoded_details(_harbour(spark).file_entries()).select("package", "json")


def encoded_matches(spark, sf_dir):
    """Search results with short keys."""
    docs_ = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit("symbol").alias("kind"), F.col("p_name").alias("name"), F.lit("").alias("detail"), F.col("p_brand").alias("hint"), F.lit(0.5).alias("score"))
    return packages.encoded_matches(docs_).select("doc_id", "json")


def encoded_focus(spark, sf_dir):
    near = intel.focus(supply_edges(spark, sf_dir), node_symbols(spark, sf_dir), "s3", 1)
    return packages.encoded_focus(near).select("node", "json")


def hop_bounds(spark, sf_dir):
    """How many nodes have each score, from several seeds."""
    return graph.hop_scores(supply_edges(spark, sf_dir), ["p1", "p2", "s5"], True).groupBy("score").agg(F.count("*").alias("n"))


def embedding_cosine(spark, sf_dir):
    """The vectors nearest to the first one by cosine: one row is broadcast, the rest streams past it."""
    v = table(spark, sf_dir, "embeddings")
    one = v.where("vec_id = 0").select(F.col("embedding").alias("q"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scored = v.where("vec_id <> 0").join(F.broadcast(one)).select(F.col("vec_id").alias("doc_id"), (dot(F.col("embedding"), F.col("q")) / F.sqrt(dot(F.col("embedding"), F.col("embedding")) * dot(F.col("q"), F.col("q")))).alias("score"))
    return search.top(scored, 10).select("doc_id", F.round("score", 5).alias("score"))


def line_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.lines(F.col("text"))).alias("n"))


def edge_counts(spark, sf_dir) -> DataFrame:
    """Nodes and edges, and what the edges come from."""
    e = supply_edges(spark, sf_dir)
    return e.agg(F.count("*").alias("edges"), F.lit("EXTRACTED").alias("provenance")).join(F.broadcast(graph.nodes(e).agg(F.count("*").alias("nodes"))))


_NAMES = "file_entries doc_briefs encoded_symbols resolved_hints task_symbols convention_examples definitions references folder_listing layer_violations layer_checked feature_guide encoded_packages encoded_impacts encoded_signals encoded_details encoded_matches encoded_focus hop_bounds embedding_cosine line_counts edge_counts".split()
QUERIES = {name: globals()[name] for name in _NAMES}

_E = """e AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e)"""
ORACLES = {
    "file_entries": values('path, symbols, depends_on, depended_by', [
        ('src/berth.rs', 'Berth,fits', 'src/tide.rs', 'src/crane/mod.rs,src/lib.rs'),
        ('src/crane/hook.rs', 'Hook,grab,Tons', '', 'src/crane/mod.rs'),
        ('src/crane/mod.rs', 'hook,Lifts,lift,unload', 'src/berth.rs,src/crane/hook.rs', 'src/lib.rs'),
        ('src/lib.rs', 'crane,berth,tide,PIERS', 'src/berth.rs,src/crane/mod.rs,src/tide.rs', ''),
        ('src/tide.rs', 'Level,tide_at,metres,knots', '', 'src/berth.rs,src/lib.rs'),
    ]),
    "doc_briefs": values('id, brief', [
        ('manual/harbour.md::## Lifting', '## manual/harbour.md::## Lifting\n\n<!-- quarry: src/crane/hook.rs -->\n### Weights\nabout weigh and metres\n\n### src/crane/hook.rs\n#[derive(Debug)]\npub'),
    ]),
    "encoded_symbols": values('path, line, json', [
        ('src/berth.rs', 4, '{"n":"Berth","k":"st","g":"pub(crate) struct Berth {","l":4}'),
        ('src/berth.rs', 9, '{"n":"fits","k":"fn","g":"pub fn fits(&self, draught: u32, hour: u32) -> bool {","l":9}'),
        ('src/crane/hook.rs', 2, '{"n":"Hook","k":"st","g":"pub struct Hook(u32);","l":2}'),
        ('src/crane/hook.rs', 3, '{"n":"grab","k":"fn","g":"pub fn grab(ship: &str) -> Hook { Hook(count(ship)) }","l":3}'),
        ('src/crane/hook.rs', 4, '{"n":"Tons","k":"ot","g":"type Tons = u32;","l":4}'),
        ('src/crane/mod.rs', 1, '{"n":"hook","k":"md","g":"mod hook;","l":1}'),
        ('src/crane/mod.rs', 5, '{"n":"Lifts","k":"tr","g":"pub trait Lifts {","l":5}'),
        ('src/crane/mod.rs', 6, '{"n":"lift","k":"fn","g":"fn lift(&mut self, tons: u32);","l":6}'),
        ('src/crane/mod.rs', 9, '{"n":"unload","k":"fn","g":"pub async unsafe fn unload(ship: &str) -> u32 {","l":9}'),
        ('src/lib.rs', 2, '{"n":"crane","k":"md","g":"pub mod crane;","l":2}'),
        ('src/lib.rs', 3, '{"n":"berth","k":"md","g":"mod berth;","l":3}'),
        ('src/lib.rs', 4, '{"n":"tide","k":"md","g":"pub(crate) mod tide;","l":4}'),
        ('src/lib.rs', 6, '{"n":"PIERS","k":"vr","g":"pub const PIERS: usize = 4;","l":6}'),
        ('src/tide.rs', 1, '{"n":"Level","k":"en","g":"pub enum Level { High, Low }","l":1}'),
        ('src/tide.rs', 3, '{"n":"tide_at","k":"fn","g":"pub fn tide_at(hour: u32) -> Level {","l":3}'),
        ('src/tide.rs', 7, '{"n":"metres","k":"fn","g":"pub fn metres(level: Level) -> u32 { match level { Level::High => 3, Level::Low => 0 } }","l":7}'),
        ('src/tide.rs', 8, '{"n":"knots","k":"ot","g":"macro_rules! knots { ($x:expr) => { $x * 2 } }","l":8}'),
    ]),
    "resolved_hints": values('hint, path', [
        ('CRANE', 'src/crane/hook.rs'),
        ('berth', 'src/berth.rs'),
        ('metres', 'src/tide.rs'),
        ('tide.rs', 'src/tide.rs'),
    ]),
    "task_symbols": values('name', [
        ('Hook',),
        ('Lifts',),
        ('Tons',),
        ('grab',),
        ('hook',),
        ('lift',),
        ('unload',),
    ]),
    "convention_examples": values('signature', [
        ('pub async unsafe fn unload(ship: &str) -> u32 {',),
        ('pub fn grab(ship: &str) -> Hook { Hook(count(ship)) }',),
    ]),
    "definitions": "SELECT p_brand AS path, p_partkey::INTEGER AS line FROM part WHERE p_name = 'red widget'",
    "references": "SELECT p_brand AS path, p_name AS name, p_partkey::INTEGER AS line FROM part WHERE contains(p_name, 'widget') AND ends_with(p_brand, 'Brand#7')",
    "folder_listing": "SELECT lang AS name, 'dir' AS kind, count(*) AS n FROM documents WHERE source = 'src1' GROUP BY lang",
    "layer_violations": f"WITH {_E} SELECT CASE left(src, 1) WHEN 's' THEN 'supplier' ELSE 'nation' END AS src_layer, CASE left(dst, 1) WHEN 'n' THEN 'nation' ELSE 'region' END AS dst_layer, CASE left(src, 1) WHEN 's' THEN 'denied' ELSE 'not allowed' END AS reason, count(*) AS n FROM e WHERE left(src, 1) <> 'p' GROUP BY ALL",
    "layer_checked": f"WITH {_E} SELECT count(*) AS checked, count(*) FILTER (WHERE src LIKE 'n%') AS between FROM e",
    "encoded_packages": """WITH s AS (SELECT DISTINCT p_brand, p_name FROM part), f AS (SELECT p_brand, list_slice(list_sort(list(p_name)), 1, 3) AS names FROM s GROUP BY 1)
SELECT p_brand AS package, '{"n":"' || p_brand || '","p":"' || p_brand || ': ' || array_to_string(any_value(names), ', ') || '","f":' || count(*) || ',"s":0.5}' AS json FROM part JOIN f USING (p_brand) GROUP BY p_brand""",
    "encoded_impacts": f"""WITH {_E}, y AS (SELECT 's' || s_suppkey AS path, s_name AS name FROM supplier UNION ALL SELECT 'n' || n_nationkey, n_name FROM nation), hot AS (SELECT node FROM nodes LEFT JOIN e ON dst = node GROUP BY node ORDER BY count(dst) DESC, node LIMIT 10),
a AS (SELECT y.name AS symbol, path FROM y WHERE name IN ('NATION_2', 'NATION_7')), d1 AS (SELECT symbol, src AS node FROM a JOIN e ON dst = path), d AS (SELECT * FROM d1 UNION SELECT symbol, src FROM d1 JOIN e ON dst = node),
dd AS (SELECT symbol, list_sort(list(d.node)) AS df, bool_or(hot.node IS NOT NULL) AS h FROM d LEFT JOIN hot ON hot.node = d.node GROUP BY symbol),
r AS (SELECT symbol, list_sort(list(y.path)) AS rf FROM a JOIN y ON contains(y.name, symbol) AND y.name <> symbol GROUP BY symbol)
SELECT symbol, '{{"sym":"' || symbol || '","def":{{"p":"' || path || '","l":1}},"rf":[' || coalesce(array_to_string(list_transform(rf, lambda x: '{{"p":"' || x || '","l":1}}'), ','), '') || '],"rc":' || coalesce(len(rf), 0) || coalesce(',"df":[' || array_to_string(list_transform(df, lambda x: '"' || x || '"'), ',') || ']', '')
  || ',"risk":"' || CASE WHEN coalesce(len(rf), 0) > 10 OR coalesce(h, FALSE) THEN 'high' WHEN coalesce(len(rf), 0) > 3 OR df IS NOT NULL THEN 'medium' ELSE 'low' END || '"}}' AS json FROM a LEFT JOIN dd USING (symbol) LEFT JOIN r USING (symbol)""",
    "encoded_signals": """SELECT conv_id AS session, i::INTEGER AS iteration, '{"sc":' || CASE WHEN i % 3 = 0 THEN 0 ELSE s END || ',"rr":true,"ri":' || (i % 3 = 0) || ',"sp":' || (s >= 5 AND i % 3 <> 0) || ',"ss":' || (i >= 4) || '}' AS json
FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, length(text) % 9 AS s FROM conversations)""",
    "encoded_matches": """SELECT p_partkey AS doc_id, '{"k":"s","n":"' || p_name || '","s":0.5,"h":"' || p_brand || '"}' AS json FROM part""",
    "encoded_focus": f"""WITH {_E}, y AS (SELECT 's' || s_suppkey AS path, s_name AS name FROM supplier UNION ALL SELECT 'n' || n_nationkey, n_name FROM nation), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
n AS (SELECT 's3' AS node, '1.0' AS score UNION SELECT dst, '0.5' FROM b WHERE src = 's3' AND dst <> 's3')
SELECT node, '{{"p":"' || node || '","sc":' || score || coalesce(',"sy":[{{"n":"' || name || '","k":"fn","l":1}}]', '') || '}}' AS json FROM n LEFT JOIN y ON path = node""",
    "hop_bounds": f"""WITH {_E}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), h0 AS (SELECT unnest(['p1', 'p2', 's5']) AS node), h1 AS (SELECT DISTINCT dst AS node FROM b JOIN h0 ON src = node), h2 AS (SELECT DISTINCT dst AS node FROM b JOIN h1 ON src = node),
m AS (SELECT node, min(h) AS h FROM (SELECT node, 0 AS h FROM h0 UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2) GROUP BY node)
SELECT CASE h WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.25 ELSE 0.1 END::DOUBLE AS score, count(*) AS n FROM nodes LEFT JOIN m USING (node) GROUP BY 1""",
    "embedding_cosine": """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id AS doc_id, list_dot_product(embedding::DOUBLE[], q) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(q, q)) AS score FROM embeddings, q WHERE vec_id <> 0)
SELECT doc_id, round(score, 5) AS score FROM s ORDER BY round(s.score, 9) DESC, doc_id LIMIT 10""",
    "line_counts": "SELECT doc_id, len(regexp_extract_all(regexp_replace(text, '\\n$', ''), '\\n')) + CASE WHEN text IN ('', chr(10)) THEN CASE WHEN text = '' THEN 0 ELSE 1 END ELSE 1 END::INTEGER AS n FROM documents",
    "edge_counts": f"WITH {_E} SELECT (SELECT count(*) FROM e) AS edges, 'EXTRACTED' AS provenance, (SELECT count(*) FROM nodes) AS nodes",
    "feature_guide": values('part, place, value', [
        ('anchor', 0, 'symbol tide_at'),
        ('anchor', 1, 'symbol tide'),
        ('anchor', 2, 'file src/tide.rs'),
        ('anchor', 3, 'hot_symbol Berth'),
        ('anchor', 4, 'hot_symbol berth'),
        ('docs', 0, 'manual/harbour.md::# Harbour'),
        ('docs', 1, 'manual/harbour.md::## Moving ships'),
        ('read', 0, 'src/tide.rs'),
        ('read', 1, 'src/lib.rs'),
    ]),
    "encoded_details": values('package, json', [
        ('crane', '{"n":"crane","f":[{"p":"src/crane/hook.rs","sy":[{"n":"Hook","k":"st","l":2},{"n":"grab","k":"fn","l":3},{"n":"Tons","k":"ot","l":4}],"b":["src/crane/mod.rs"]},{"p":"src/crane/mod.rs","sy":[{"n":"hook","k":"md","l":1},{"n":"Lifts","k":"tr","l":5},{"n":"lift","k":"fn","l":6},{"n":"unload","k":"fn","l":9}],"d":["src/berth.rs","src/crane/hook.rs"],"b":["src/lib.rs"]}]}'),
        ('src', '{"n":"src","f":[{"p":"src/berth.rs","sy":[{"n":"Berth","k":"st","l":4},{"n":"fits","k":"fn","l":9}],"d":["src/tide.rs"],"b":["src/crane/mod.rs","src/lib.rs"]},{"p":"src/lib.rs","sy":[{"n":"crane","k":"md","l":2},{"n":"berth","k":"md","l":3},{"n":"tide","k":"md","l":4},{"n":"PIERS","k":"vr","l":6}],"d":["src/berth.rs","src/crane/mod.rs","src/tide.rs"]},{"p":"src/tide.rs","sy":[{"n":"Level","k":"en","l":1},{"n":"tide_at","k":"fn","l":3},{"n":"metres","k":"fn","l":7},{"n":"knots","k":"ot","l":8}],"b":["src/berth.rs","src/lib.rs"]}]}'),
    ]),
}
