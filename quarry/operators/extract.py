"""Symbols, imports and calls of source files (repo, path, content), as column expressions over lines; imports of TypeScript over whole texts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarry.functions import modules, paths, text
from quarry.sources.package import send_package

# For each language the patterns in the order in which they are tried, and the kind of symbol.
_CS_HEAD = r"^\s*(?:\[.*\]\s*)*"
_CS_MOD = r"(?:public|private|protected|internal|static|virtual|override|abstract|sealed|readonly|async|unsafe|partial|new|extern)\s+"
_VIS = r"^\s*(?:pub(?:\([^)]*\))?\s+)?"
RULES: dict[str, tuple[tuple[str, str], ...]] = {
    "rust": (
        (_VIS + r'(?:async\s+)?(?:unsafe\s+)?(?:extern\s+"[^"]*"\s+)?fn\s+(\w+)', "Function"),
        (_VIS + r"(?:unsafe\s+)?trait\s+(\w+)", "Trait"),
        (_VIS + r"struct\s+(\w+)", "Struct"),
        (_VIS + r"enum\s+(\w+)", "Enum"),
        (_VIS + r"mod\s+(\w+)", "Module"),
        (_VIS + r"type\s+(\w+)", "Other"),
        (_VIS + r"const\s+(\w+)", "Variable"),
        (r"^\s*macro_rules!\s*(\w+)", "Other"),
    ),
    "go": (
        (r"^\s*type\s+(\w+)\s+struct", "Struct"),
        (r"^\s*type\s+(\w+)\s+interface", "Trait"),
        (r"^\s*func\s+\([^)]*\)\s+(\w+)", "Function"),
        (r"^\s*func\s+(\w+)", "Function"),
        (r"^\s*type\s+(\w+)", "Other"),
    ),
    "python": (
        (r"^(?:async\s+)?def\s+(\w+)", "Function"),
        (r"^class\s+(\w+)", "Struct"),
    ),
    "typescript": (
        (r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(?:\*\s+)?(\w+)", "Function"),
        (r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)", "Struct"),
        (r"^\s*(?:export\s+)?(?:default\s+)?interface\s+(\w+)", "Trait"),
        (r"^\s*(?:export\s+)?type\s+(\w+)", "Other"),
        (r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)", "Variable"),
    ),
    "csharp": (
        (f"{_CS_HEAD}(?:{_CS_MOD})*" + r"class\s+(\w+)", "Struct"),
        (f"{_CS_HEAD}(?:{_CS_MOD})*" + r"interface\s+(\w+)", "Trait"),
        (f"{_CS_HEAD}(?:{_CS_MOD})*" + r"struct\s+(\w+)", "Struct"),
        (f"{_CS_HEAD}(?:{_CS_MOD})*" + r"enum\s+(\w+)", "Enum"),
        (f"{_CS_HEAD}(?:{_CS_MOD})*" + r"record\s+(\w+)", "Struct"),
        (f"{_CS_HEAD}{_CS_MOD}" + r"(?:\w+(?:<[^>]*>)?\s+)*(\w+)\s*\(", "Function"),
    ),
}
# What a line must hold for each of the patterns, so that most lines meet none.
NEEDS: dict[str, tuple[tuple[str, ...], ...]] = {
    "rust": (("fn",), ("trait",), ("struct",), ("enum",), ("mod",), ("type",), ("const",), ("macro_rules!",)),
    "go": (("struct",), ("interface",), ("func",), ("func",), ("type",)),
    "python": (("def",), ("class",)),
    "typescript": (("function",), ("class",), ("interface",), ("type",), ("const", "let", "var")),
    "csharp": (("class",), ("interface",), ("struct",), ("enum",), ("record",), ("(",)),
}
# Names before a parenthesis that are no calls.
NO_CALLS = (
    "if", "for", "while", "match", "return", "let", "mut", "async", "await", "self", "Self", "super", "crate",
    "use", "mod", "pub", "fn", "impl", "struct", "enum", "trait", "type", "const", "static", "where", "unsafe",
    "loop", "break", "continue", "else", "print", "println", "format", "vec", "Some", "None", "Ok", "Err",
    "true", "false", "new", "from", "into", "as", "isinstance", "len", "range", "require", "import", "export",
    "class", "def", "lambda",
)

#: Classes such as \w cover all of Unicode.
_U = "(?U)"


def with_language(files: DataFrame) -> DataFrame:
    """Files of a known language."""
    return files.withColumn("lang", paths.language(F.col("path"))).where(F.col("lang").isNotNull())


def lines(files: DataFrame, content: str = "content") -> DataFrame:
    """(repo, path, lang, line, text), lines from 1; other columns of files but the content are kept."""
    kept = [c for c in files.columns if c != content]
    return files.select(*kept, F.posexplode(text.lines(F.col(content))).alias("_at", "text")).withColumn("line", F.col("_at") + 1).drop("_at")


def _holds(column: str, *parts: str) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(F.col(column), F.lit(p)) for p in parts))


def _marked(lang: str) -> Column:
    """The names that the rules of a language give, one a line; all but one are empty, as the first rule that fits is taken."""
    rules = "|".join(r.removeprefix("^") for r, _ in RULES[lang])
    return F.regexp_replace("text", f"{_U}^(?:{rules})(?s:.*)", "\n".join(f"${i + 1}" for i in range(len(RULES[lang]))))


def symbols(files: DataFrame) -> DataFrame:
    """(repo, path, package, name, signature, kind, line, character): the first rule that fits a line makes its symbol."""
    rows = lines(with_language(files))

    # lines that no rule can fit go before anything else is evaluated
    needed = {lang: tuple(dict.fromkeys(n for needs in NEEDS[lang] for n in needs)) for lang in RULES}
    # a pattern tries all its words at each character, so that many are sought one by one
    any_of = lambda words: F.col("text").rlike("|".join(map(re.escape, words))) if len(words) < 3 else _holds("text", *words)
    may = reduce(lambda a, b: a | b, ((F.col("lang") == lang) & any_of(words) for lang, words in needed.items()))
    # each language's rules are one pattern: the first that fits puts the name at its place among empty ones. White space around a line makes no difference to them
    marked = reduce(lambda c, lang: c.when(F.col("lang") == lang, _marked(lang)), RULES, F)
    # exploded rather than filtered, so that the patterns are evaluated once; a line that no rule fits stays as it is
    rows = rows.where(may).withColumn("hit", F.explode(F.array_remove(F.array(marked), F.col("text"))))
    place = F.length("hit") - F.length(F.ltrim("hit", F.lit("\n")))
    kind = reduce(lambda c, lang: c.when(F.col("lang") == lang, F.get(F.array(*(F.lit(k) for _, k in RULES[lang])), place)), RULES, F)
    signature = F.when(F.col("lang") == "python", F.col("text")).otherwise(text.strip(F.col("text"))).alias("signature")
    return rows.select("repo", "path", paths.package(F.col("path")).alias("package"), F.replace("hit", F.lit("\n"), F.lit("")).alias("name"), signature, kind.alias("kind"), "line", F.lit(0).alias("character"))


def _found(column: str, head: str, name: str, tail: str = "") -> Column:
    """struct(text, character) of a pattern whose name starts behind its head, or null."""
    pattern = f"{_U}{head}({name}){tail}"
    before = f"{_U}({head})(?:{name}){tail}"
    return F.when(F.col(column).rlike(pattern), F.struct(F.regexp_extract(column, pattern, 1).alias("text"), F.length(F.regexp_extract(column, before, 1)).alias("character")))


def _ts_imports(files: DataFrame) -> DataFrame:
    """Imports over the whole text, as they may span lines. A file's are told apart inside its row, so that none is shuffled."""
    send_package(files.sparkSession)
    of = files.where(F.contains("content", F.lit("import")) | F.contains("content", F.lit("from"))).select("repo", "path", "lang", F.col("content").cast("binary").alias("code"))
    schema = T.StructType([*of.schema.fields[:3], *(T.StructField(n, t) for n, t in (("text", T.StringType()), ("line", T.IntegerType()), ("character", T.IntegerType())))])
    return of.mapInArrow(modules.relative_imports, schema)


def imports(files: DataFrame) -> DataFrame:
    """(repo, path, lang, text, line, character) of raw imports."""
    known = with_language(files)
    rows = lines(known.where(F.col("lang") != "typescript")).withColumn("_bare", text.strip(F.col("text")))
    named = lambda part, found: F.when(_holds("text", part), found)
    vis = r"^\s*(?:pub(?:\([^)]*\))?\s+)?"
    rust = F.array(named("mod", _found("text", vis + r"mod\s+", r"\w+", r"\s*;")), named("use", _found("text", vis + r"use\s+", r"(?:crate|super)::[\w:]+")))
    left = rows.where(F.col("lang").isin("rust", "python", "csharp")).withColumn("_left", text.strip_left(F.col("text")))
    python = named("import", F.coalesce(_found("_left", r"^from\s+", r"\.+\w*|\w[\w.]*", r"\s+import"), _found("_left", r"^import\s+", r"[\w.]+")))
    csharp = named("using", _found("_bare", r"^\s*using\s+(?:static\s+)?", r"[\w.]+", r"\s*;"))
    # one pass over the lines of three languages
    hits = F.when(F.col("lang") == "rust", rust).when(F.col("lang") == "python", F.array(python)).otherwise(F.array(csharp))
    plain = left.select("repo", "path", "lang", "line", F.explode(F.array_compact(hits)).alias("m")).where((F.col("lang") != "csharp") | (F.col("m.text") != "System") & ~F.startswith("m.text", F.lit("System.")))
    # inside a group: the last of the lines that open or close one opens; no other lines but these and those that may be imports go through the window
    edge = F.when(F.col("_bare") == "import (", 1).when(F.col("_bare") == ")", 0)
    by_line = Window.partitionBy("repo", "path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    go_rows = rows.where((F.col("lang") == "go") & (F.contains("text", F.lit('"')) | F.col("_bare").isin("import (", ")"))).withColumn("_edge", edge)
    go_rows = go_rows.select("repo", "path", "lang", "line", "_edge", _found("text", r'^\s+"', r'[^"]+', '"').alias("_inner"), _found("text", r'^\s*import\s+"', r'[^"]+', '"').alias("_single"))
    go_rows = go_rows.where("_edge IS NOT NULL OR _inner IS NOT NULL OR _single IS NOT NULL")
    go_rows = go_rows.withColumn("_in", F.coalesce(F.last("_edge", ignorenulls=True).over(by_line), F.lit(0)))
    go_hit = F.when((F.col("_in") == 1) & F.col("_edge").isNull(), F.col("_inner")).when(F.col("_in") == 0, F.col("_single"))
    go = go_rows.select("repo", "path", "lang", "line", go_hit.alias("m")).where("m IS NOT NULL")
    both = plain.unionByName(go).select("repo", "path", "lang", F.col("m.text").alias("text"), "line", F.col("m.character").alias("character"))
    return both.unionByName(_ts_imports(known.where(F.col("lang") == "typescript")))


def calls(files: DataFrame, found: DataFrame) -> DataFrame:
    """(repo, caller_file, caller_sym, callee_name, line): names before parentheses, charged to the last function that starts at or before the line.

    The function of a line comes from one window over calls and functions together, not from a range join.
    """
    rows = lines(with_language(files)).where(F.contains("text", F.lit("(")))
    # one pattern says of a line without white space at its ends that it is a comment or a definition: a name such as `fn` is followed by more
    open_lines = rows.where(~F.col("text").rlike(r"(?Us)^\s*(?://|#|\*|def )|(?:fn|function) .*\S"))
    sites = open_lines.select("repo", "path", "line", F.posexplode(F.regexp_extract_all("text", F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("), 1)).alias("place", "callee_name"))
    short_type = F.col("callee_name").rlike("^[A-Z]") & (F.length("callee_name") <= 3)
    sites = sites.where(~F.col("callee_name").isin(*NO_CALLS) & ~short_type)
    functions = found.where(F.col("kind") == "Function").select("repo", "path", "line", F.lit(-1).alias("place"), F.lit(None).cast("string").alias("callee_name"), F.col("name").alias("fn"))
    both = sites.withColumn("fn", F.lit(None).cast("string")).unionByName(functions)
    upto = Window.partitionBy("repo", "path").orderBy("line", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = both.withColumn("caller_sym", F.last("fn", ignorenulls=True).over(upto)).where(F.col("callee_name").isNotNull() & F.col("caller_sym").isNotNull())
    kept = owned.where(F.col("callee_name") != F.col("caller_sym"))
    return kept.select("repo", F.col("path").alias("caller_file"), "caller_sym", "callee_name", "line")


def as_of(left: DataFrame, right: DataFrame, by: list[str], on: str, value: str) -> DataFrame:
    """left with the `value` of the last row of right with the same `by` at or before `on`, by one window; null without one."""
    a = left.withColumns({"_side": F.lit(1), value: F.lit(None).cast(right.schema[value].dataType)})
    b = right.select(*by, on, value).withColumn("_side", F.lit(0))
    w = Window.partitionBy(*by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return a.unionByName(b, allowMissingColumns=True).withColumn(value, F.last(value, ignorenulls=True).over(w)).where("_side = 1").drop("_side")
