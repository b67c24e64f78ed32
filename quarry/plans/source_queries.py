"""Scans of folders, repositories and configuration, and indexes that are written and read again, and their SQL.

The driver's tables hold no folders, so the queries write them first: whole tables as text files by folder, and the small
code corpora, to the shared folder; a repository of two commits and a configuration file to a folder of the driver, which
runs git and reads its own configuration.
"""

from __future__ import annotations

import hashlib
import subprocess
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import paths
from quarry.operators import extract, packages
from quarry.plans import generated_queries, state_queries
from quarry.plans.catalog import Catalog
from quarry.plans.fixtures import DOCS, FILES, values
from quarry.plans.fixtures import docs as doc_files
from quarry.plans.fixtures import files as code_files
from quarry.plans.generated_queries import python_files
from quarry.plans.intel_queries import part_symbols
from quarry.plans.tables import SUPPLY_SQL, files, supply_edges, table
from quarry.sources import config, repos, sinks
from quarry.sources.checkpoints import cut, put, remove, shared_dir
from quarry.streaming import changes, versions


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


IGNORE_FILE = "# one language, but not of one source\nlang=fr/\n!source=src0/lang=fr/\n"


def scanned_folders(spark, sf_dir):
    """All documents as text files in folders of source and lang, scanned without an ignored folder, a glob and what the ignore file names."""
    folder = _folder(spark, "scan")
    table(spark, sf_dir, "documents").select("text", "source", "lang").write.partitionBy("source", "lang").text(folder)
    table(spark, sf_dir, "region").select("r_name").write.text(f"{folder}/vendor")
    found = repos.scan(spark, folder, extra_dirs=("lang=de",), globs=("source=src2/**",), ignore_file=IGNORE_FILE, suffixes=("txt",))
    breaks = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))
    out = cut(found.groupBy(paths.parent(F.col("path")).alias("folder")).agg(F.sum("n_bytes").alias("n_bytes"), F.sum(breaks.cast("long")).alias("n_lines")))
    remove(spark, folder)
    return out


LANGUAGES = ("Rust", "GO")


def scanned_code(spark, sf_dir):
    """The files of two languages, by any spelling; ignored folders and files that aren't UTF-8 fall out."""
    folder = _folder(spark, "code")
    for repo, path, content in FILES:
        put(spark, f"{folder}/{repo}/{path}", content.encode())
    put(spark, f"{folder}/harbour/node_modules/x/lib.rs", b"fn x() {}\n")
    put(spark, f"{folder}/harbour/src/broken.rs", b"fn y() {}\xff\xfe\n")
    out = cut(repos.scan(spark, folder, languages=LANGUAGES).select("path", paths.language(F.col("path")).alias("language"), "n_bytes", F.md5("content").alias("md5")))
    remove(spark, folder)
    return out


def scanned_docs(spark, sf_dir):
    """Markdown files with their size, and whether their hash is that of the content."""
    folder = _folder(spark, "docs")
    for path, content in DOCS:
        put(spark, f"{folder}/{path}", content.encode())
    put(spark, f"{folder}/vendor/notes.md", b"# Notes\n")
    known = doc_files(spark).select("path", F.hex(F.xxhash64("content")).alias("known"))
    out = cut(repos.doc_files(spark, folder).join(known, "path", "left").select("path", "n_bytes", F.col("hash").eqNullSafe(F.col("known")).alias("same")))
    remove(spark, folder)
    return out


def index_tables(spark, sf_dir):
    """How many rows the tables of an index of all generated files have when they are read again; one that is missing is empty."""
    folder = _folder(spark, "index")
    Catalog(python_files(spark, sf_dir)).write(folder)
    remove(spark, f"{folder}/links")
    made = Catalog.read(spark, folder)
    out = None
    for name in ("files", "symbols", "edges", "calls", "links"):
        part = getattr(made, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    out = cut(out)
    remove(spark, folder)
    return out


def drilled_package(spark, sf_dir):
    """A package of one of two repositories that hold the same paths."""
    one = code_files(spark, "harbour")
    both = Catalog(one.unionByName(one.withColumn("repo", F.lit("quay"))))
    return both.drill("quay/crane").select("repo", "path", F.array_join(F.transform("symbols", lambda s: s["name"]), ",").alias("symbols"))


def kept_usage(spark, sf_dir):
    """Usage counters as JSON, read again."""
    folder = _folder(spark, "usage")
    sinks.write_json(state_queries.usage_counters(spark, sf_dir), folder, "usage")
    out = cut(spark.read.schema("tool string, key string, n long").json(f"{folder}/usage.json"))
    remove(spark, folder)
    return out


def report_tables(spark, sf_dir):
    """The rows of the tables in the report."""
    f = files(spark, sf_dir).withColumn("repo", F.lit("r"))
    s = part_symbols(spark, sf_dir)
    purposes = packages.purposes(s, s.select("repo", "package").distinct().withColumn("tags", F.array().cast("array<string>")))
    text = sinks.report("all", f, s, supply_edges(spark, sf_dir), packages.summaries(f), purposes, packages.hot_symbols(s))
    heads = ("| Metric |", "| Rank |", "| Package |")
    return spark.createDataFrame([(line,) for line in text.splitlines() if line.startswith("| ") and not line.startswith(heads)], "line string")


def refreshed_symbols(spark, sf_dir):
    """Symbols of generated files after changes: files of German documents go, those of French ones get one function."""
    f = python_files(spark, sf_dir)
    lang = table(spark, sf_dir, "documents").where("lang IN ('de', 'fr')").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), "lang")
    changed = lang.select(F.lit("r").alias("repo"), "path", F.when(F.col("lang") == "de", "delete").otherwise("upsert").alias("op"), F.lit("2024-01-01").cast("timestamp").alias("ts"), F.lit("def f_new():\n    pass\n").alias("content"))
    return changes.refreshed(extract.symbols(f), changed, extract.symbols).select("path", "line", "name", "kind")


def stream_index(spark, sf_dir):
    """Files and their symbols kept from a stream: each event of a user rewrites the user's file, an error deletes it."""
    edits = table(spark, sf_dir, "events").select(
        F.lit("r").alias("repo"), F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".py")).alias("path"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"),
        F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("def e_"), F.col("event_id").cast("string"), F.lit("():\n    pass\n")).alias("content"),
    )
    kept = versions.Versions(spark, _folder(spark, "kept"), {"symbols": extract.symbols})
    return versions.kept(changes.in_batches(edits, "ts", 4), kept, "index", "symbols").select("path", "name", "line")


def git_facts(spark, sf_dir):
    """(part, path, value) of a repository of two commits, an edit and a new file."""
    with tempfile.TemporaryDirectory() as top:
        root = f"{top}/one"
        for name in ("one", "two", ".hidden", "plain"):
            Path(top, name).mkdir()
        git = lambda at, *args: subprocess.run(["git", "-C", at, "-c", "user.name=x", "-c", "user.email=x@example.org", *args], check=True, capture_output=True)
        for name in ("one", "two", ".hidden"):
            git(f"{top}/{name}", "init", "-q")
        file = Path(root, "a.txt")
        for text, subject in (("one\n", "begin"), ("one\ntwo\n", "fix the count")):
            file.write_text(text)
            git(root, "add", ".")
            git(root, "commit", "-qm", subject)
        file.write_text("one\ntwo\nthree\n")
        Path(root, "b.txt").write_text("")
        rows = [("repo", Path(r).name, "") for r in repos.discover_repos(top)] + [("outer", Path(r).name, "") for r in repos.discover_repos(f"{top}/plain")]
        rows += [("blame", "a.txt", repos.git_blame(root, "a.txt", n).split(" ", 1)[1]) for n in (1, 2)]
        diffs = [("edit", repos.git_diff(root)), ("range", repos.git_diff(root, "HEAD~1..HEAD")), ("commit", repos.git_show(root, "HEAD~1"))]
        status, log = cut(repos.git_status(spark, root)), cut(repos.git_commits(spark, root))
    out = spark.createDataFrame(rows, "part string, path string, value string").unionByName(status.select(F.lit("status").alias("part"), "path", F.col("state").alias("value")))
    out = out.unionByName(log.select(F.lit("log").alias("part"), "path", F.col("subject").alias("value")))
    out = out.unionByName(repos.bugfix_ratio(log).select(F.lit("fixes").alias("part"), "path", F.col("bugfix_ratio").cast("string").alias("value")))
    hunks = repos.diff_hunks(spark.createDataFrame(diffs, "diff_id string, content string"))
    return out.unionByName(hunks.select(F.col("diff_id").alias("part"), F.col("file").alias("path"), F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string")).alias("value")))


def config_values(spark, sf_dir):
    """(key, value) of a configuration that sets some of its values, and of intervals."""
    with tempfile.TemporaryDirectory() as top:
        at = Path(top, "c.toml")
        at.write_text('[index]\nlanguages = ["go"]\n[risk]\nbias = -1.5\n[security]\nmode = "strict"\n[unknown]\nx = 1\n')
        made, none = config.load(str(at)), config.load(f"{top}/none.toml")
    rows = [("index.languages", ",".join(made.index.languages)), ("risk.bias", str(made.risk.bias)), ("risk.w_churn", str(made.risk.w_churn)), ("security.mode", made.security.mode), ("loop.reindex", made.loop.reindex), ("none.risk.bias", str(none.risk.bias))]
    rows += [(f"seconds {x}", str(config.seconds(x))) for x in ("90", "30s", "5m", "2h")]
    return spark.createDataFrame(rows, "key string, value string")


QUERIES = {f.__name__: f for f in (scanned_folders, scanned_code, scanned_docs, index_tables, drilled_package, kept_usage, report_tables, refreshed_symbols, stream_index, git_facts, config_values)}

_GENERATED = generated_queries.ORACLES
_CODE = {"rs": "rust", "go": "go"}
ORACLES = {
    "scanned_folders": """SELECT 'source=' || source || '/lang=' || lang AS folder, (sum(coalesce(strlen(text), 0)) + count(*))::BIGINT AS n_bytes, (sum(coalesce(length(text) - length(replace(text, chr(10), '')), 0)) + count(*))::BIGINT AS n_lines
FROM documents WHERE lang <> 'de' AND source <> 'src2' AND (lang <> 'fr' OR source = 'src0') GROUP BY ALL""",
    "scanned_code": values("path, language, n_bytes, md5", [(f"{r}/{p}", _CODE[p.rsplit(".", 1)[1]], len(c.encode()), hashlib.md5(c.encode()).hexdigest()) for r, p, c in FILES if p.rsplit(".", 1)[1] in _CODE]),
    "scanned_docs": values("path, n_bytes, same", [(p, len(c.encode()), True) for p, c in DOCS if p.endswith((".md", ".mdx"))]),
    "index_tables": f"SELECT 'files' AS name, count(*) AS n FROM documents UNION ALL SELECT 'symbols', count(*) FROM ({_GENERATED['symbols_generated']}) UNION ALL SELECT 'edges', count(*) FROM ({_GENERATED['resolve_generated']}) UNION ALL SELECT 'calls', count(*) FROM ({_GENERATED['calls_generated']}) UNION ALL SELECT 'links', 0",
    "drilled_package": values("repo, path, symbols", [("quay", "src/crane/hook.rs", "Hook,grab,Tons"), ("quay", "src/crane/mod.rs", "hook,Lifts,lift,unload")]),
    "kept_usage": state_queries.ORACLES["usage_counters"],
    "report_tables": f"""WITH e AS ({SUPPLY_SQL}), nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e), c AS (SELECT 'packages' AS m, count(DISTINCT p_brand) AS n FROM part UNION ALL SELECT 'files', count(*) FROM documents UNION ALL SELECT 'symbols', count(*) FROM part
  UNION ALL SELECT 'nodes', count(*) FROM nodes UNION ALL SELECT 'edges', count(*) FROM e), h AS (SELECT node, count(dst) AS n FROM nodes LEFT JOIN e ON dst = node GROUP BY node ORDER BY n DESC, node LIMIT 10)
SELECT '| ' || m || ' | ' || n || ' |' AS line FROM c UNION ALL SELECT '| ' || row_number() OVER (ORDER BY n DESC, node) || ' | `' || node || '` | ' || n || ' |' FROM h UNION ALL SELECT '| ' || source || ' | ' || count(*) || ' | 0.10 |  |' FROM documents GROUP BY source""",
    "refreshed_symbols": f"WITH {generated_queries._LINES} SELECT path, line, CASE n % 5 WHEN 0 THEN 'f_' ELSE 'C_' END || w AS name, CASE n % 5 WHEN 0 THEN 'Function' ELSE 'Struct' END AS kind FROM x JOIN documents USING (doc_id) WHERE n % 5 < 2 AND lang NOT IN ('de', 'fr') UNION ALL SELECT 'doc' || doc_id || '.py', 1, 'f_new', 'Function' FROM documents WHERE lang = 'fr'",
    "stream_index": "SELECT 'u' || user_id || '.py' AS path, 'e_' || arg_max(event_id, ts) AS name, 1 AS line FROM events GROUP BY user_id HAVING arg_max(event_type, ts) <> 'error'",
    "git_facts": values("part, path, value", [
        ("repo", "one", ""), ("repo", "two", ""), ("blame", "a.txt", "begin"), ("blame", "a.txt", "fix the count"), ("status", "a.txt", "modified"), ("status", "b.txt", "untracked"),
        ("log", "a.txt", "begin"), ("log", "a.txt", "fix the count"), ("fixes", "a.txt", "0.5"), ("edit", "a.txt", "3-3"), ("range", "a.txt", "2-2"), ("commit", "a.txt", "1-1"),
    ]),
    "config_values": values("key, value", [
        ("index.languages", "go"), ("risk.bias", "-1.5"), ("risk.w_churn", "0.1"), ("security.mode", "strict"), ("loop.reindex", "if_stale"), ("none.risk.bias", "-2.0"),
        ("seconds 90", "90"), ("seconds 30s", "30"), ("seconds 5m", "300"), ("seconds 2h", "7200"),
    ]),
}
