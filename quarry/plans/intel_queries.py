"""Composite, package and source operators over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import paths
from quarry.operators import extract, intel, packages
from quarry.plans.catalog import Catalog
from quarry.plans.fixtures import DIFF, docs, values
from quarry.plans.fixtures import files as code_files
from quarry.plans.tables import SUPPLY_SQL, commits, files, order_calls, supply_edges, table
from quarry.sources import repos, sinks


def part_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as symbols: the brand is the file, the key the line."""
    return table(spark, sf_dir, "part").select(F.lit("parts").alias("repo"), F.col("p_brand").alias("package"), F.col("p_brand").alias("path"), F.col("p_name").alias("name"), F.concat_ws(" ", F.col("p_brand"), F.col("p_type")).alias("signature"), F.col("p_type").alias("kind"), F.col("p_partkey").cast("int").alias("line"))


def node_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and nations as symbols of their own nodes."""
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("path"), F.col("s_name").alias("name"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("path"), F.col("n_name").alias("name"))
    return s.unionByName(n).select(F.lit("r").alias("repo"), F.lit("p").alias("package"), "path", "name", F.col("name").alias("signature"), F.lit("Function").alias("kind"), F.lit(1).alias("line"))


def focus_neighbors(spark, sf_dir):
    return intel.focus(supply_edges(spark, sf_dir), node_symbols(spark, sf_dir), "s3", 1).select("node", "score", F.coalesce(F.size("symbols"), F.lit(0)).alias("n"))


def impact_risk_tier(spark, sf_dir):
    names = ["NATION_3", "Supplier#000000003", "NATION_7"]
    return intel.change_impact(node_symbols(spark, sf_dir), supply_edges(spark, sf_dir), order_calls(spark, sf_dir), names).select("symbol", F.size("dependents").alias("n_dependents"), "fan_in", "risk")


def impact_references(spark, sf_dir):
    """Names as parts of others, with the functions that calls reach in two steps."""
    names = ["NATION_1", "NATION_2", "p42"]
    parts = order_calls(spark, sf_dir).select(F.lit("r").alias("repo"), F.lit("p").alias("package"), F.lit("parts").alias("path"), F.col("callee_name").alias("name"), F.lit("").alias("signature"), F.lit("Function").alias("kind"), F.lit(1).alias("line")).distinct()
    symbols = node_symbols(spark, sf_dir).unionByName(parts)
    found = intel.change_impact(symbols, supply_edges(spark, sf_dir), order_calls(spark, sf_dir), names, exact=False)
    return found.select("symbol", "ref_count", F.size("affected").alias("n_affected"), "fan_in", "risk")


def symbol_risk(spark, sf_dir):
    names = ["NATION_3", "Supplier#000000003", "NATION_7", "none"]
    found = intel.symbol_risk(node_symbols(spark, sf_dir), supply_edges(spark, sf_dir), order_calls(spark, sf_dir), _nation_commits(spark, sf_dir), names)
    return found.select("target", F.round("score", 6).alias("score"), "tier")


def focus_two_hops(spark, sf_dir):
    return intel.focus(supply_edges(spark, sf_dir), node_symbols(spark, sf_dir), "n3", 2).groupBy("score").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.size("symbols"), F.lit(0))).alias("symbols"))


def package_proximity(spark, sf_dir):
    """Brands as packages; a part is near if its key is small."""
    parts = table(spark, sf_dir, "part").select(F.lit("r").alias("repo"), F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("path"), "p_partkey")
    near = parts.where("p_partkey % 3 = 0").select(F.col("path").alias("node"), (F.lit(1.0) / (1 + F.col("p_partkey") % 4)).alias("score"))
    return packages.summaries(parts, near).select("package", "files", F.round("score", 6).alias("score"))


def arch_violations(spark, sf_dir):
    """Orders join customers' regions with suppliers' regions; some pairs of regions are denied."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r"))
    region = table(spark, sf_dir, "region")
    named = nation.join(F.broadcast(region), nation["r"] == region["r_regionkey"]).select("k", F.col("r_name").alias("layer"))
    c = table(spark, sf_dir, "customer").join(F.broadcast(named), F.col("c_nationkey") == F.col("k")).select("c_custkey", F.col("layer").alias("src_layer"))
    s = table(spark, sf_dir, "supplier").join(F.broadcast(named), F.col("s_nationkey") == F.col("k")).select("s_suppkey", F.col("layer").alias("dst_layer"))
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    edges = l.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    deny = spark.createDataFrame([("ASIA", "EUROPE"), ("AFRICA", "AMERICA")], "src_layer string, dst_layer string")
    return intel.rule_violations(edges, deny).groupBy("src_layer", "dst_layer").agg(F.count("*").alias("n"))


def _nation_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as functions, with tests for those of the first region."""
    n = table(spark, sf_dir, "nation").select(F.lit("src/n.py").alias("path"), F.concat(F.lower("n_name"), F.lit("_fn")).alias("name"), F.col("n_nationkey").alias("line"))
    t = table(spark, sf_dir, "nation").where(F.col("n_regionkey") == 0).select(F.lit("tests/t.py").alias("path"), F.concat(F.lit("test_"), F.lower("n_name"), F.lit("_f")).alias("name"), F.col("n_nationkey").alias("line"))
    return n.unionByName(t).withColumn("kind", F.lit("Function"))


def test_gap_anti(spark, sf_dir):
    return intel.test_gaps(_nation_functions(spark, sf_dir), None)


def coverage_counts(spark, sf_dir):
    return intel.test_coverage(_nation_functions(spark, sf_dir))


def test_gap_texts(spark, sf_dir):
    """Benchmark items that are in no document, as whole texts.

    The words of an item but its first and last are whole words of any text that holds it. So the second to eighth word are
    looked up among all runs of seven words, and only those texts are searched; items of fewer words meet all texts.
    """
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("target"), F.split("text", " ").alias("words"))
    long = b.where(F.size("words") >= 9)
    run = lambda w, i: F.xxhash64(F.array_join(F.slice(w, i, 7), " "))
    docs_ = table(spark, sf_dir, "documents").select("text")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - 6, F.lit(1)))
    runs = docs_.withColumn("words", F.split("text", " ")).withColumn("run", F.explode(F.array_distinct(F.transform(starts, lambda i: run(F.col("words"), i))))).drop("words")
    held = runs.join(long.select("item_id", "target", run(F.col("words"), 2).alias("run")), "run").where(F.contains("text", F.col("target"))).select("item_id")
    short = docs_.join(b.where(F.size("words") < 9), F.contains("text", F.col("target"))).select("item_id")
    return b.join(held.unionByName(short).distinct(), "item_id", "left_anti").select("item_id")


def similar_symbols(spark, sf_dir):
    return intel.similar(part_symbols(spark, sf_dir), "red widget", limit=20).select("name", "path", "line", F.round("score", 6).alias("score"))


def api_surface_counts(spark, sf_dir):
    s = part_symbols(spark, sf_dir).withColumns({"kind": F.when(F.col("kind") == "SMALL", "Function").otherwise(F.col("kind")), "name": F.initcap("name")})
    return packages.api_surface(s).select("package", F.size("exports").alias("n_exports"), "internal_count")


def package_summary(spark, sf_dir):
    return packages.summaries(files(spark, sf_dir).withColumn("repo", F.lit("r"))).select("package", "files", F.round("score", 6).alias("score"))


def purpose_string(spark, sf_dir):
    s = part_symbols(spark, sf_dir)
    return packages.purposes(s, s.select("repo", "package").distinct().withColumn("tags", F.array().cast("array<string>"))).select("package", "purpose")


def hot_symbols_usage(spark, sf_dir):
    used = table(spark, sf_dir, "events").select(F.lit("part").alias("tool"), (F.get_json_object("props", "$.k").cast("long")).alias("k"))
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("key"))
    usage = used.join(names, "k").groupBy("key").agg(F.count("*").alias("n"))
    return packages.hot_symbols(part_symbols(spark, sf_dir), usage)


NEEDLES = (("the", "the "), ("licence", "icensed"), ("token", "token"), ("mail", "@"), ("shout", "!!"), ("shout", "$$$"))


def convention_tags_top5(spark, sf_dir):
    f = files(spark, sf_dir).withColumn("repo", F.lit("r"))
    return packages.conventions(f, NEEDLES, 3).select("package", F.array_join("tags", ",").alias("tags"))


def churn_30d(spark, sf_dir):
    return repos.churn(commits(spark, sf_dir))


def bugfix_ratio_last30(spark, sf_dir):
    return repos.bugfix_ratio(commits(spark, sf_dir)).select("path", F.round("bugfix_ratio", 6).alias("bugfix_ratio"))


def _nation_commits(spark, sf_dir):
    return commits(spark, sf_dir).withColumn("path", F.concat(F.lit("n"), (F.col("path").cast("long") % 25).cast("string")))


def fragile_score(spark, sf_dir):
    return intel.fragile(supply_edges(spark, sf_dir), _nation_commits(spark, sf_dir)).select("node", "dependents", "churn", F.round("score", 6).alias("score"))


def logistic_risk(spark, sf_dir):
    return intel.file_risk(supply_edges(spark, sf_dir), node_symbols(spark, sf_dir), _nation_commits(spark, sf_dir), 10).select("target", F.round("score", 6).alias("score"), "tier")


def range_hunk_symbols(spark, sf_dir):
    hunks = spark.createDataFrame([("Brand#2", 10, 400), ("Brand#7", 100, 900), ("x/Brand#3", 0, 50), ("Brand#9", None, None)], "file string, start int, end int")
    return intel.hunk_symbols(hunks, part_symbols(spark, sf_dir)).select("path", "name", "line")


def diff_ranges(spark, sf_dir):
    return repos.diff_hunks(spark.createDataFrame([(1, DIFF)], "diff_id int, content string")).select("file", "start", "end")


def review_bundle(spark, sf_dir):
    c = Catalog(code_files(spark, "harbour"))
    hunks = repos.diff_hunks(spark.createDataFrame([(1, DIFF)], "diff_id int, content string"))
    log = spark.createDataFrame([("src/tide.rs", "2024-01-02 00:00:00", "1", "fix it")], "path string, ts string, sha string, subject string").withColumn("ts", F.col("ts").cast("timestamp"))
    return intel.review(hunks, c.symbols, c.edges, c.calls, log).select("symbol", F.col("definition.path").alias("path"), "fan_in", "risk", "fragile")


def asof_enclosing(spark, sf_dir):
    """The latest signup at or before each purchase of a user."""
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = e.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("signup_id"))
    return extract.as_of(left, right, ["user_id"], "ts", "signup_id").where("signup_id IS NOT NULL").select("event_id", "signup_id")


def dict_path_ids(spark, sf_dir):
    return packages.path_ids(files(spark, sf_dir))


def dict_delta(spark, sf_dir):
    now = files(spark, sf_dir).select("path")
    before = packages.path_ids(now.where(F.col("path").startswith("src1")))
    return packages.delta(now, before)


def dict_expand(spark, sf_dir):
    ids = packages.path_ids(files(spark, sf_dir))
    refs = spark.createDataFrame([("p1",), ("p2",), ("other/x.rs",)], "ref string")
    return packages.expanded(refs, ids)


def mermaid_edges(spark, sf_dir):
    return sinks.mermaid_edges(supply_edges(spark, sf_dir).where(~F.col("src").startswith("p")))


def index_counts(spark, sf_dir):
    c = Catalog(code_files(spark, "harbour"))
    return sinks.counts(c.files, c.symbols, c.edges)


def explain_names(spark, sf_dir):
    c = Catalog(code_files(spark, "harbour"))
    out = None
    for name in ("src", "tide.rs", "grab"):
        part = intel.explain(c.edges, c.symbols, name)
        out = part if out is None else out.unionByName(part)
    return out


def why_file(spark, sf_dir):
    c = Catalog(code_files(spark, "harbour"))
    log = spark.createDataFrame([("src/tide.rs", "2024-01-02 00:00:00", "1", "fix it"), ("src/tide.rs", "2024-01-03 00:00:00", "2", "more")], "path string, ts string, sha string, subject string").withColumn("ts", F.col("ts").cast("timestamp"))
    return intel.why_file(c.edges, log, "src/tide.rs").select("path", "package", F.array_join("depends_on", ",").alias("depends_on"), F.array_join("depended_by", ",").alias("depended_by"), F.array_join("commits", ",").alias("commits"))


def query_matches(spark, sf_dir):
    return Catalog(code_files(spark, "harbour"), docs(spark)).query("lift a hook", ["src/crane/hook.rs"], 4).select("kind", "name")


def navigate_files(spark, sf_dir):
    c = Catalog(code_files(spark, "harbour"))
    return intel.navigate(c.index(), c.edges, c.symbols, "tide level").select("path")


def dep_requirements(spark, sf_dir):
    """Dependencies of manifests against given latest versions (designed here)."""
    m = spark.createDataFrame([
        ("r", "Cargo.toml", '[package]\nname = "x"\nversion = "0.1.0"\n\n[dependencies]\nserde = "1.0.1"\ntokio = { version = "1.2.0", features = ["full"] }\n'),
        ("r", "web/package.json", '{\n  "name": "x",\n  "version": "1.0.0",\n  "dependencies": {\n    "react": "^17.0.2"\n  }\n}\n'),
        ("r", "go.mod", "module x\n\nrequire (\n\tgithub.com/a/b v1.4.0\n)\n"),
    ], "repo string, path string, content string")
    latest = spark.createDataFrame([("cargo", "serde", "1.0.1"), ("cargo", "tokio", "1.9.0"), ("npm", "react", "18.0.0")], "ecosystem string, name string, latest string")
    return repos.freshness(repos.requirements(m), latest).select("ecosystem", "name", "version", "status")


def stale_files(spark, sf_dir):
    """Users whose last event is newer than an index made on 20 January, new since then, or gone."""
    e = commits(spark, sf_dir)
    now = e.groupBy("path").agg(F.max("ts").alias("mtime"))
    indexed = e.where(F.col("ts") < "2024-01-20").groupBy("path").agg(F.max("ts").alias("mtime")).unionByName(spark.createDataFrame([("old",)], "path string").withColumn("mtime", F.lit("2024-01-01").cast("timestamp")))
    return repos.stale_files(now, indexed)


def package_of_paths(spark, sf_dir):
    rows = [(p,) for p in ("src/auth/login.rs", "src/db/pool.rs", "main.rs", "cmd/main.go", "src/lib.rs", "a/b/c.py")]
    return spark.createDataFrame(rows, "path string").select("path", paths.package(F.col("path")).alias("package"))


_NAMES = """focus_neighbors focus_two_hops package_proximity impact_references symbol_risk impact_risk_tier arch_violations test_gap_anti coverage_counts test_gap_texts similar_symbols api_surface_counts package_summary purpose_string hot_symbols_usage
convention_tags_top5 churn_30d bugfix_ratio_last30 fragile_score logistic_risk range_hunk_symbols diff_ranges review_bundle asof_enclosing dict_path_ids dict_delta dict_expand
mermaid_edges index_counts explain_names why_file query_matches navigate_files dep_requirements stale_files package_of_paths""".split()
QUERIES = {name: globals()[name] for name in _NAMES}

_E = f"e AS ({SUPPLY_SQL}), nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e)"
_SYM = "y AS (SELECT 's' || s_suppkey AS path, s_name AS name FROM supplier UNION ALL SELECT 'n' || n_nationkey, n_name FROM nation)"
_PATH = "source || '/' || lang || '/' || doc_id || '.md'"
_HOT = "hot AS (SELECT node, count(dst) AS dependents FROM nodes LEFT JOIN e ON dst = node GROUP BY node ORDER BY dependents DESC, node LIMIT {k})"
_CH = """ev AS (SELECT 'n' || (user_id % 25) AS path, ts, event_id, event_type FROM events), ch AS (SELECT path, count(*) AS churn FROM ev WHERE ts >= (SELECT max(ts) FROM ev) - INTERVAL 30 DAYS GROUP BY path),
bf AS (SELECT path, avg((event_type = 'error')::INT) AS bugfix FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) AS k FROM ev) WHERE k <= 30 GROUP BY path)"""
_GAPS = """WITH t AS (SELECT unnest(['test_' || lower(n_name) || '_f', lower(n_name) || '_f', '_' || lower(n_name) || '_f']) AS t FROM nation WHERE n_regionkey = 0)
SELECT 'src/n.py' AS path, n_nationkey AS line, lower(n_name) || '_fn' AS name FROM nation WHERE NOT EXISTS (SELECT 1 FROM t WHERE contains(lower(n_name) || '_fn', t) OR contains(t, lower(n_name) || '_fn'))"""
ORACLES = {
    "focus_neighbors": f"WITH {_E}, {_SYM}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), n AS (SELECT 's3' AS node, 1.0 AS score UNION SELECT dst, 0.5 FROM b WHERE src = 's3' AND dst <> 's3') SELECT node, score::DOUBLE AS score, count(y.path)::INTEGER AS n FROM n LEFT JOIN y ON y.path = node GROUP BY node, score",
    "focus_two_hops": f"""WITH {_E}, {_SYM}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), h1 AS (SELECT DISTINCT dst AS node FROM b WHERE src = 'n3'), h2 AS (SELECT DISTINCT dst AS node FROM b JOIN h1 ON src = node),
h AS (SELECT node, min(k) AS k FROM (SELECT 'n3' AS node, 0 AS k UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2) GROUP BY node)
SELECT CASE k WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.25 END::DOUBLE AS score, count(DISTINCT node) AS n, count(y.path) AS symbols FROM h LEFT JOIN y ON y.path = node GROUP BY 1""",
    "package_proximity": """SELECT p_brand AS package, count(*) AS files, round(avg(CASE WHEN p_partkey % 3 = 0 THEN 1.0::DOUBLE / (1 + p_partkey % 4) ELSE 0.1::DOUBLE END), 6) AS score FROM part GROUP BY p_brand HAVING score >= 0.05""",
    "impact_references": f"""WITH {_E}, {_SYM}, {_HOT.format(k=10)}, c AS (SELECT DISTINCT 'o' || l_orderkey AS o, 'p' || l_partkey AS p FROM lineitem WHERE l_linenumber < 7), ps AS (SELECT DISTINCT 'p' || l_partkey AS name FROM lineitem),
a AS (SELECT unnest(['NATION_1', 'NATION_2', 'p42']) AS symbol), sy AS (SELECT name, path FROM y UNION ALL SELECT name, 'parts' FROM ps), d AS (SELECT symbol, min(path) AS path FROM a JOIN sy ON name = symbol GROUP BY symbol),
r AS (SELECT symbol, count(*) AS n FROM a JOIN sy ON contains(name, symbol) AND name <> symbol GROUP BY symbol), f AS (SELECT p AS symbol, count(*) AS n FROM c GROUP BY p),
d1 AS (SELECT symbol, src AS node FROM d JOIN e ON dst = path), dd AS (SELECT * FROM d1 UNION SELECT symbol, src FROM d1 JOIN e ON dst = node), dn AS (SELECT symbol, count(*) AS n, bool_or(hot.node IS NOT NULL) AS h FROM dd LEFT JOIN hot ON hot.node = dd.node GROUP BY symbol)
SELECT d.symbol, coalesce(r.n, 0)::INTEGER AS ref_count, coalesce(f.n, 0)::INTEGER AS n_affected, coalesce(f.n, 0) AS fan_in,
  CASE WHEN coalesce(r.n, 0) > 10 OR coalesce(f.n, 0) > 10 OR coalesce(h, FALSE) THEN 'high' WHEN coalesce(r.n, 0) > 3 OR coalesce(f.n, 0) > 3 OR coalesce(dn.n, 0) > 0 THEN 'medium' ELSE 'low' END AS risk
FROM d LEFT JOIN r USING (symbol) LEFT JOIN f USING (symbol) LEFT JOIN dn USING (symbol)""",
    "impact_risk_tier": f"""WITH {_E}, {_SYM}, {_HOT.format(k=10)}, d1 AS (SELECT name, src AS node FROM y JOIN e ON dst = path WHERE name IN ('NATION_3', 'Supplier#000000003', 'NATION_7')),
d AS (SELECT * FROM d1 UNION SELECT name, src FROM d1 JOIN e ON dst = node), s AS (SELECT y.name, count(d.node) AS n, bool_or(hot.node IS NOT NULL) AS h FROM y LEFT JOIN d USING (name) LEFT JOIN hot ON hot.node = d.node WHERE y.name IN ('NATION_3', 'Supplier#000000003', 'NATION_7') GROUP BY y.name)
SELECT name AS symbol, n::INTEGER AS n_dependents, 0::BIGINT AS fan_in, CASE WHEN h THEN 'high' WHEN n > 0 THEN 'medium' ELSE 'low' END AS risk FROM s""",
    "arch_violations": """WITH g AS (SELECT n_nationkey AS k, r_name AS layer FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT a.layer AS src_layer, b.layer AS dst_layer, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN g a ON c_nationkey = a.k
JOIN supplier ON l_suppkey = s_suppkey JOIN g b ON s_nationkey = b.k WHERE (a.layer, b.layer) IN (('ASIA', 'EUROPE'), ('AFRICA', 'AMERICA')) GROUP BY ALL""",
    "test_gap_anti": _GAPS,
    "coverage_counts": f"WITH g AS (SELECT count(*) AS n FROM ({_GAPS})) SELECT count(*) - any_value(g.n) AS tested, any_value(g.n) AS untested, count(*) FILTER (n_regionkey = 0) AS tests FROM nation, g",
    "test_gap_texts": "SELECT item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))",
    "similar_symbols": """WITH s AS (SELECT p_name AS name, p_brand AS path, p_partkey::INTEGER AS line, p_brand || ' ' || p_type AS sig, p_type AS kind FROM part),
t AS (SELECT * FROM s WHERE name = 'red widget' ORDER BY path, line LIMIT 1),
c AS (SELECT s.name, s.path, s.line, CASE WHEN s.kind = t.kind THEN 0.4 ELSE 0 END + CASE WHEN len(s.sig) - len(replace(s.sig, '(', '')) = len(t.sig) - len(replace(t.sig, '(', '')) THEN 0.2 ELSE 0 END
  + CASE WHEN len(string_split(s.sig, ' ')) = len(string_split(t.sig, ' ')) THEN 0.2 ELSE 0 END
  + (SELECT count(*) FROM range(1, least(len(s.name), len(t.name)) + 1) r(i) WHERE substr(s.name, i, 1) = substr(t.name, i, 1)) / greatest(strlen(s.name), strlen(t.name))::DOUBLE * 0.2 AS score
  FROM s, t WHERE s.name <> 'red widget')
SELECT name, path, line, round(score, 6) AS score FROM c WHERE score >= 0.3 ORDER BY round(c.score, 9) DESC, name, path, line LIMIT 20""",
    "api_surface_counts": "SELECT p_brand AS package, count(*) FILTER (p_type = 'SMALL')::INTEGER AS n_exports, count(*) FILTER (p_type <> 'SMALL') AS internal_count FROM part GROUP BY 1",
    "package_summary": "SELECT source AS package, count(*) AS files, 0.1::DOUBLE AS score FROM documents GROUP BY 1",
    "purpose_string": "SELECT p_brand AS package, p_brand || ': ' || array_to_string(list_slice(list_sort(list(DISTINCT p_name)), 1, 3), ', ') AS purpose FROM part GROUP BY 1",
    "hot_symbols_usage": """WITH n AS (SELECT DISTINCT p_name AS name FROM part ORDER BY 1 LIMIT 20), u AS (SELECT p_name, count(*) AS n FROM events JOIN part ON p_partkey = (props->>'$.k')::BIGINT GROUP BY 1)
SELECT name, coalesce(u.n, 0) AS n FROM n LEFT JOIN u ON p_name = name ORDER BY n DESC, name LIMIT 10""",
    "convention_tags_top5": """WITH t AS (SELECT source AS package, unnest([CASE WHEN contains(text, 'the ') THEN 'the' END, CASE WHEN contains(text, 'icensed') THEN 'licence' END, CASE WHEN contains(text, 'token') THEN 'token' END, CASE WHEN contains(text, '@') THEN 'mail' END, CASE WHEN contains(text, '!!') THEN 'shout' END, CASE WHEN contains(text, '$$$') THEN 'shout' END]) AS tag FROM documents),
c AS (SELECT package, tag, row_number() OVER (PARTITION BY package ORDER BY count(*) DESC, tag) AS k FROM t WHERE tag IS NOT NULL GROUP BY package, tag)
SELECT p.package, coalesce(string_agg(tag, ',' ORDER BY k) FILTER (k <= 3), '') AS tags FROM (SELECT DISTINCT source AS package FROM documents) p LEFT JOIN c USING (package) GROUP BY 1""",
    "churn_30d": "SELECT user_id::VARCHAR AS path, count(*) AS churn FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAYS GROUP BY 1",
    "bugfix_ratio_last30": "SELECT user_id::VARCHAR AS path, round(avg((event_type = 'error')::INT), 6) AS bugfix_ratio FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 30 GROUP BY 1",
    "fragile_score": f"WITH {_E}, {_HOT.format(k=20)}, {_CH} SELECT node, dependents, coalesce(churn, 0) AS churn, round(dependents * (1 + 0.1::DOUBLE * coalesce(churn, 0)), 6) AS score FROM hot LEFT JOIN ch ON path = node ORDER BY dependents * (1 + 0.1::DOUBLE * coalesce(churn, 0)) DESC, node LIMIT 10",
    "logistic_risk": f"""WITH {_E}, {_HOT.format(k=10)}, {_CH}, {_SYM},
p AS (SELECT node AS target, 1 / (1 + exp(-(0.15::DOUBLE * dependents + 0.1 * coalesce(churn, 0) + 0.25 * coalesce(bugfix, 0) + 0.05 * coalesce((SELECT ln(1 + count(*)) FROM y WHERE y.path = node HAVING count(*) > 0), 0) + CASE WHEN EXISTS (SELECT 1 FROM y WHERE y.path = node) THEN 0.2 ELSE 0 END - 2))) AS score FROM hot LEFT JOIN ch ON ch.path = node LEFT JOIN bf ON bf.path = node)
SELECT target, round(score, 6) AS score, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS tier FROM p ORDER BY p.score DESC, target LIMIT 10""",
    "symbol_risk": f"""WITH {_E}, {_CH}, {_SYM}, deg AS (SELECT node, count(dst) AS dependents FROM nodes LEFT JOIN e ON dst = node GROUP BY node),
p AS (SELECT name AS target, 1 / (1 + exp(-(0.15::DOUBLE * coalesce(dependents, 0) + 0.1 * coalesce(churn, 0) + 0.25 * coalesce(bugfix, 0) + 0.05 + 0.2 - 2))) AS score FROM y LEFT JOIN deg ON deg.node = y.path LEFT JOIN ch ON ch.path = y.path LEFT JOIN bf ON bf.path = y.path
  WHERE name IN ('NATION_3', 'Supplier#000000003', 'NATION_7'))
SELECT target, round(score, 6) AS score, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS tier FROM p""",
    "range_hunk_symbols": """WITH h(f, a, b) AS (VALUES ('Brand#2', 10, 400), ('Brand#7', 100, 900), ('x/Brand#3', 0, 50), ('Brand#9', NULL, NULL))
SELECT DISTINCT p_brand AS path, p_name AS name, p_partkey::INTEGER AS line FROM part JOIN h ON p_brand = regexp_extract(f, '[^/]*$') AND (a IS NULL OR p_partkey BETWEEN a AND b)""",
    "diff_ranges": values('file, start, "end"', [
        ('src/crane/hook.rs', None, None),
        ('src/tide.rs', 3, 5),
        ('src/tide.rs', 6, 6),
    ]),
    "review_bundle": values('symbol, path, fan_in, risk, fragile', [
        ('Hook', 'src/crane/hook.rs', 0, 'high', True),
        ('Tons', 'src/crane/hook.rs', 0, 'high', True),
        ('grab', 'src/crane/hook.rs', 1, 'high', True),
        ('tide_at', 'src/tide.rs', 1, 'high', True),
    ]),
    "asof_enclosing": "SELECT p.event_id, s.event_id AS signup_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON p.user_id = s.user_id AND p.ts >= s.ts",
    "dict_path_ids": f"WITH p AS (SELECT DISTINCT {_PATH} AS path FROM documents) SELECT 'p' || row_number() OVER (ORDER BY path) AS id, path FROM p",
    "dict_delta": f"WITH p AS (SELECT DISTINCT {_PATH} AS path FROM documents) SELECT 'p' || (row_number() OVER (ORDER BY path) + (SELECT count(*) FROM p WHERE starts_with(path, 'src1'))) AS id, path FROM p WHERE NOT starts_with(path, 'src1')",
    "dict_expand": f"WITH p AS (SELECT DISTINCT {_PATH} AS path FROM documents), i AS (SELECT 'p' || row_number() OVER (ORDER BY path) AS id, path FROM p) SELECT r AS ref, coalesce(path, r) AS path FROM (VALUES ('p1'), ('p2'), ('other/x.rs')) v(r) LEFT JOIN i ON id = r",
    "mermaid_edges": f"WITH {_E}, f AS (SELECT * FROM e WHERE src NOT LIKE 'p%'), k AS (SELECT node FROM (SELECT src AS node FROM f UNION SELECT dst FROM f) ORDER BY node LIMIT 80) SELECT DISTINCT src, dst FROM f WHERE src IN (FROM k) AND dst IN (FROM k)",
    "index_counts": values('metric, value', [
        ('edges', 6),
        ('files', 5),
        ('nodes', 5),
        ('packages', 2),
        ('symbols', 17),
    ]),
    "explain_names": values('kind, name, detail', [
        ('file', 'src/tide.rs', '2 dependents'),
        ('package', 'src', '3 files; Berth, Level, PIERS, berth, crane, fits, knots, metres'),
        ('symbol', 'grab', 'src/crane/hook.rs:3 pub fn grab(ship: &str) -> Hook { Hook(count(ship)) }'),
    ]),
    "why_file": values('path, package, depends_on, depended_by, commits', [
        ('src/tide.rs', 'src', '', 'src/berth.rs,src/lib.rs', 'more,fix it'),
    ]),
    "query_matches": values('kind, name', [
        ('hot_symbol', 'Lifts'),
        ('package', 'crane'),
        ('symbol', 'Lifts'),
        ('symbol', 'lift'),
    ]),
    "navigate_files": values('path', [
        ('src/berth.rs',),
        ('src/lib.rs',),
        ('src/tide.rs',),
    ]),
    "dep_requirements": values("ecosystem, name, version, status", [("cargo", "serde", "1.0.1", "current"), ("cargo", "tokio", "1.2.0", "minor"), ("npm", "react", "17.0.2", "major"), ("go", "github.com/a/b", "1.4.0", "unknown")]),
    "stale_files": """WITH n AS (SELECT user_id::VARCHAR AS path, max(ts) AS a FROM events GROUP BY 1), i AS (SELECT user_id::VARCHAR AS path, max(ts) AS b FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1 UNION ALL SELECT 'old', TIMESTAMP '2024-01-01')
SELECT path, CASE WHEN b IS NULL THEN 'new' WHEN a IS NULL THEN 'gone' ELSE 'changed' END AS reason FROM n FULL JOIN i USING (path) WHERE b IS NULL OR a IS NULL OR a > b""",
    "package_of_paths": values("path, package", [("src/auth/login.rs", "auth"), ("src/db/pool.rs", "db"), ("main.rs", "root"), ("cmd/main.go", "cmd"), ("src/lib.rs", "src"), ("a/b/c.py", "a")]),
}
