"""Extraction, resolution and security over code that is made from every word of every document; the SQL states the rules.

Line i of a document's file comes from its i-th word w of n letters: by n modulo 5 a function f_w, a class C_w, an import
of the document n further on, a call of f_ and the first five letters of w, or neither. C files hold allocations of w and n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import extract, resolve, security
from quarry.plans.tables import table
from quarry.sources.checkpoints import written

WORD = "[a-z]{3,12}"


def _files(spark: SparkSession, sf_dir: str, ending: str, line: list[Column]) -> DataFrame:
    by_length = lambda w: F.coalesce(*(F.when(F.length(w) % 5 == i, x(w)) for i, x in enumerate(line)))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(WORD), 0).alias("words"))
    return docs.select(F.lit("r").alias("repo"), F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(ending)).alias("path"), F.array_join(F.transform("words", by_length), "\n").alias("content"))


def python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    return _files(spark, sf_dir, ".py", [
        lambda w: cat("def f_", w, "():"), lambda w: cat("class C_", w, ":"), lambda w: cat("import doc", (F.col("doc_id") + F.length(w)).cast("string")),
        lambda w: cat("    x = f_", F.substring(w, 1, 5), "(1)"), lambda w: F.lit("    y = 1"),
    ])


def c_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda w: F.length(w).cast("string")
    cat = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    return _files(spark, sf_dir, ".c", [
        lambda w: cat("a = malloc(", w, " * ", n(w), ");"), lambda w: cat("b = malloc(", w, " - ", n(w), ");"), lambda w: cat("c = malloc(total / ", w, ");"),
        lambda w: cat("memcpy(d, e, ", w, " * ", n(w), ");"), lambda w: cat("return ", w, ";"),
    ])


def symbols_generated(spark, sf_dir):
    return extract.symbols(python_files(spark, sf_dir)).select("path", "line", "name", "kind")


def imports_generated(spark, sf_dir):
    return extract.imports(python_files(spark, sf_dir)).select("path", "line", "text", "character")


def resolve_generated(spark, sf_dir):
    f = python_files(spark, sf_dir)
    return resolve.resolve_imports(extract.imports(f), f).select("src", "dst")


def calls_generated(spark, sf_dir):
    f = python_files(spark, sf_dir)
    # as written: calls and their resolution read symbols several times, and only these columns
    s = written(extract.symbols(f).select("repo", "path", "line", "name", "kind"))
    return resolve.resolve_calls(extract.calls(f, s), s).select("caller_file", "caller_sym", "callee_name", "line", "callee_file", "resolved")


def findings_generated(spark, sf_dir):
    return security.findings(c_files(spark, sf_dir), prove=True).select("path", "line", "cwe", "status")


def gate_generated(spark, sf_dir):
    f = c_files(spark, sf_dir)
    return security.gate(f, security.findings(f, prove=True))


QUERIES = {f.__name__: f for f in (symbols_generated, imports_generated, resolve_generated, calls_generated, findings_generated, gate_generated)}

_LINES = f"l AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1))::INTEGER AS line FROM (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS ws FROM documents)), x AS (SELECT *, 'doc' || doc_id || '.py' AS path, 'doc' || doc_id || '.c' AS c, length(w) AS n FROM l)"
_FOUND = "SELECT c AS path, line, CASE n % 5 WHEN 0 THEN 'CWE-190' WHEN 1 THEN 'CWE-191' WHEN 2 THEN 'CWE-369' ELSE 'CWE-680' END AS cwe, 'proven_vulnerable' AS status FROM x WHERE n % 5 < 4"
ORACLES = {
    "symbols_generated": f"WITH {_LINES} SELECT path, line, CASE n % 5 WHEN 0 THEN 'f_' ELSE 'C_' END || w AS name, CASE n % 5 WHEN 0 THEN 'Function' ELSE 'Struct' END AS kind FROM x WHERE n % 5 < 2",
    "imports_generated": f"WITH {_LINES} SELECT path, line, 'doc' || (doc_id + n) AS text, 7 AS \"character\" FROM x WHERE n % 5 = 2",
    "resolve_generated": f"WITH {_LINES} SELECT DISTINCT path AS src, 'doc' || (x.doc_id + n) || '.py' AS dst FROM x JOIN documents d ON d.doc_id = x.doc_id + n WHERE n % 5 = 2",
    "calls_generated": f"""WITH {_LINES}, o AS (SELECT path, line, n, 'f_' || left(w, 5) AS callee, last_value(CASE WHEN n % 5 = 0 THEN 'f_' || w END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line) AS caller FROM x),
s AS (SELECT 'f_' || w AS name, path FROM x WHERE n % 5 = 0), once AS (SELECT name, min(path) AS path FROM s GROUP BY name HAVING count(*) = 1), own AS (SELECT DISTINCT name, path FROM s)
SELECT o.path AS caller_file, caller AS caller_sym, callee AS callee_name, line, coalesce(own.path, once.path) AS callee_file, coalesce(own.path, once.path) IS NOT NULL AS resolved
FROM o LEFT JOIN own ON own.name = callee AND own.path = o.path LEFT JOIN once ON once.name = callee WHERE n % 5 = 3 AND caller IS NOT NULL AND callee <> caller""",
    "findings_generated": f"WITH {_LINES} {_FOUND}",
    "gate_generated": f"""WITH {_LINES}, f AS ({_FOUND}), g AS (SELECT path, count(*) AS n FROM f GROUP BY path)
SELECT 'doc' || doc_id || '.c' AS path, CASE WHEN n > 0 THEN 'block' ELSE 'allow' END AS action, coalesce(n, 0) AS n_sites, coalesce(n, 0) AS n_findings, coalesce(n, 0) AS n_proved FROM documents LEFT JOIN g ON path = 'doc' || doc_id || '.c'""",
}
