"""Symbols, imports and import edges of four languages, and all security checks, over code that is made from every word of every document.

Line i of a document's file comes from its i-th word w of n letters, by n modulo the number of forms; the SQL says what each form means.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import extract, resolve, security
from quarry.plans.generated_queries import WORD
from quarry.plans.tables import table
from quarry.sources.checkpoints import written

#: A form has parts: text, W the word, A and B the documents n and 2n further on. What it means: ("symbol", kind, name), ("import", text, character) or nothing.
W, A, B = "\x00W", "\x00A", "\x00B"
LANGUAGES: dict[str, tuple[str, str, tuple]] = {
    "rust": ("src/doc", ".rs", (
        (("pub async fn f_", W, "() {"), [("symbol", "Function", ("f_", W))]),
        (("  pub(crate) struct S_", W, " {"), [("symbol", "Struct", ("S_", W))]),
        (("use crate::doc", A, "::x;"), [("import", ("crate::doc", A, "::x"), 4)]),
        (("mod doc", B, ";"), [("symbol", "Module", ("doc", B)), ("import", ("doc", B), 4)]),
        (("unsafe trait T_", W, " {"), [("symbol", "Trait", ("T_", W))]),
        (("    let x = 1;",), []),
    )),
    "go": ("p", "/doc.go", (
        (("func f_", W, "() {"), [("symbol", "Function", ("f_", W))]),
        (("type S_", W, " struct {"), [("symbol", "Struct", ("S_", W))]),
        (('import "mod/p', A, '"'), [("import", ("mod/p", A), 8)]),
        (("func (s *S) m_", W, "() int {"), [("symbol", "Function", ("m_", W))]),
        (("type I_", W, " interface {"), [("symbol", "Trait", ("I_", W))]),
        (("\tx := 1",), []),
    )),
    "typescript": ("doc", ".ts", (
        (("export async function f_", W, "() {"), [("symbol", "Function", ("f_", W))]),
        (("export default class C_", W, " {"), [("symbol", "Struct", ("C_", W))]),
        (("import { a } from './doc", A, "';"), [("import", ("./doc", A), 19)]),
        (("import './doc", B, "';"), [("import", ("./doc", B), 8)]),
        (("export interface I_", W, " {"), [("symbol", "Trait", ("I_", W))]),
        (("  const v_", W, " = 1;"), [("symbol", "Variable", ("v_", W))]),
    )),
    "csharp": ("doc", ".cs", (
        (("    public static int f_", W, "(int a) {"), [("symbol", "Function", ("f_", W))]),
        (("public sealed class C_", W, " {"), [("symbol", "Struct", ("C_", W))]),
        (("using doc", A, ";"), [("import", ("doc", A), 6)]),
        (("using static App.doc", B, ";"), [("import", ("App.doc", B), 13)]),
        (("internal interface I_", W, " {"), [("symbol", "Trait", ("I_", W))]),
        (("    x = 1;",), []),
    )),
}
#: Lines of the security checks, their findings (cwe, status).
SITES: tuple[tuple[tuple[str, ...], tuple[str, str]], ...] = (
    (("p = malloc(", W, " * 1);"), ("CWE-190", "proven_safe")),
    (("p = malloc(", W, " * v_", W, ");"), ("CWE-131", "proven_vulnerable")),
    (("p = malloc(", W, " << 3);"), ("CWE-190", "proven_vulnerable")),
    (("p = malloc(", W, " * sizeof(struct ", W, "));"), ("CWE-190", "unknown")),
    (("p = malloc(", W, " * ", W, " * 2);"), ("CWE-190", "pattern_only")),
    (("printf(", W, ");"), ("CWE-134", "pattern_only")),
    (("system(", W, ");"), ("CWE-78", "pattern_only")),
    (("x = yaml.load(", W, ")"), ("CWE-502", "pattern_only")),
    (("f = ", W, " + '../x';"), ("CWE-22", "pattern_only")),
    (('password = "', W, '_secret"'), ("CWE-798", "pattern_only")),
)


def _files(spark: SparkSession, sf_dir: str, head: str, end: str, forms: list[tuple[str, ...]]) -> DataFrame:
    def line(w: Column) -> Column:
        n = F.length(w)
        part = lambda p: w if p == W else (F.col("doc_id") + n * (1 if p == A else 2)).cast("string") if p in (A, B) else F.lit(p)
        return F.coalesce(*(F.when(n % len(forms) == i, F.concat(*map(part, form))) for i, form in enumerate(forms)))

    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(WORD), 0).alias("words"))
    return docs.select(F.lit("r").alias("repo"), F.concat(F.lit(head), F.col("doc_id").cast("string"), F.lit(end)).alias("path"), F.array_join(F.transform("words", line), "\n").alias("content"))


def _facts(language: str):
    head, end, forms = LANGUAGES[language]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        # as written: symbols, imports and their resolution each read the code, the last two the imports
        code = written(_files(spark, sf_dir, head, end, [f for f, _ in forms]))
        every = code.unionByName(spark.createDataFrame([("r", "go.mod", "module mod\n")], "repo string, path string, content string")) if language == "go" else code
        made = written(extract.imports(code))
        out = extract.symbols(code).select(F.lit("symbol").alias("part"), "path", "line", "name", F.col("kind").alias("detail"))
        out = out.unionByName(made.select(F.lit("import").alias("part"), "path", "line", F.col("text").alias("name"), F.col("character").cast("string").alias("detail")))
        return out.unionByName(resolve.resolve_imports(made, every).select(F.lit("edge").alias("part"), F.col("src").alias("path"), F.lit(None).cast("int").alias("line"), F.col("dst").alias("name"), F.lit(None).cast("string").alias("detail")))

    query.__doc__ = f"Symbols, imports and import edges of {language} code: (part, path, line, name, detail)."
    query.__name__ = f"{language}_generated"
    return query


def sites_generated(spark, sf_dir):
    """Every check, proofs included: safe, vulnerable, with two variables, shifted, inconclusive, and patterns."""
    code = _files(spark, sf_dir, "doc", ".c", [f for f, _ in SITES])
    return security.findings(code, security.ALL_CWES, prove=True).select("path", "line", "cwe", "status")


QUERIES = {f.__name__: f for f in (*(_facts(x) for x in LANGUAGES), sites_generated)}

_WORDS = f"x AS (SELECT doc_id, w, length(w) AS n, line FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1))::INTEGER AS line FROM (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS ws FROM documents)))"


def _text(parts: tuple[str, ...]) -> str:
    return " || ".join({W: "w", A: "(doc_id + n)", B: "(doc_id + 2 * n)"}.get(p, "'" + p.replace("'", "''") + "'") for p in parts)


def _sql(language: str) -> str:
    head, end, forms = LANGUAGES[language]
    path = f"'{head}' || doc_id || '{end}'"
    rows, ahead = [], []
    for i, (_, means) in enumerate(forms):
        for what, a, b in means:
            name, detail = (_text(b), f"'{a}'") if what == "symbol" else (_text(a), f"'{b}'")
            rows.append(f"SELECT '{what}' AS part, {path} AS path, line, {name} AS name, {detail} AS detail FROM x WHERE n % {len(forms)} = {i}")
            if what == "import":
                ahead.append(f"SELECT doc_id, doc_id + {1 if A in a else 2} * n AS other FROM x WHERE n % {len(forms)} = {i}")
    edges = f"SELECT DISTINCT 'edge', '{head}' || a.doc_id || '{end}', NULL::INTEGER, '{head}' || d.doc_id || '{end}', NULL FROM ({' UNION ALL '.join(ahead)}) a JOIN documents d ON d.doc_id = a.other"
    return f"WITH {_WORDS} {' UNION ALL '.join(rows)} UNION ALL {edges}"


_CASES = lambda i: " ".join(f"WHEN {k} THEN '{found[i]}'" for k, (_, found) in enumerate(SITES))
ORACLES = {f"{x}_generated": _sql(x) for x in LANGUAGES} | {
    "sites_generated": f"WITH {_WORDS} SELECT 'doc' || doc_id || '.c' AS path, line, CASE n % {len(SITES)} {_CASES(0)} END AS cwe, CASE n % {len(SITES)} {_CASES(1)} END AS status FROM x"
}
