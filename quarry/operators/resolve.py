"""Import and call resolution as equi-joins: candidate paths are generated and joined with the files that exist."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import paths
from quarry.sources.checkpoints import cut

#: Kinds of symbols that a call can mean.
CALLED = ("Function", "Module", "Other")


def _rust(text: Column, path: Column) -> Column:
    """For a::b::c the longest prefix first, as a file and as a module folder; a bare name beside the file."""
    parts = F.split(F.regexp_replace(F.regexp_replace(text, r"^(?:crate::)+", ""), r"^(?:super::)+", ""), "::")
    by_length = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - i), "/"))
    absolute = F.flatten(F.transform(by_length, lambda p: F.array(F.concat(F.lit("src/"), p, F.lit(".rs")), F.concat(F.lit("src/"), p, F.lit("/mod.rs")))))
    folder = paths.parent(path)
    beside = F.array(paths.join(folder, F.concat(text, F.lit(".rs"))), paths.join(folder, F.concat(text, F.lit("/mod.rs"))))
    return F.when(F.contains(text, F.lit("::")), absolute).otherwise(beside)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value found once."""
    return F.get(F.transform(F.array(value), lambda v: then(v)), F.lit(0))


def _typescript(text: Column, path: Column) -> Column:
    base = paths.normalised(paths.join(paths.parent(path), text))
    # the ending differs, what stands before it is found once
    named = lambda b, bare: F.array(F.concat(bare, F.lit("ts")), F.concat(bare, F.lit("tsx")), paths.join(b, F.lit("index.ts")), paths.join(b, F.lit("index.tsx")), F.concat(bare, F.lit("js")))
    found = _let(base, lambda b: _let(paths.with_extension(b, ""), lambda bare: named(b, bare)))
    return F.when(text.startswith("."), found).otherwise(F.array().cast("array<string>"))


def _python(text: Column, path: Column) -> Column:
    dots = F.length(F.regexp_extract(text, r"^(\.*)", 1))
    module = F.replace(F.regexp_replace(text, r"^\.+", ""), F.lit("."), F.lit("/"))
    folders = F.filter(F.split(paths.parent(path), "/"), lambda p: p != "")
    base = F.array_join(F.slice(folders, F.lit(1), F.greatest(F.lit(0), F.size(folders) - F.greatest(F.lit(0), dots - 1))), "/")
    relative = F.when(module == "", F.array(paths.join(base, F.lit("__init__.py")))).otherwise(F.array(paths.join(base, F.concat(module, F.lit(".py"))), paths.join(base, F.concat(module, F.lit("/__init__.py")))))
    absolute = F.array(*(F.concat(F.lit(a), module, F.lit(b)) for a in ("", "src/") for b in (".py", "/__init__.py")))
    return F.when(dots > 0, relative).otherwise(absolute)


def _csharp(text: Column, path: Column) -> Column:
    form = F.replace(text, F.lit("."), F.lit("/"))
    folder = paths.parent(path)
    return F.array(F.concat(form, F.lit(".cs")), F.concat(form, F.lit("/index.cs")), paths.join(folder, F.concat(form, F.lit(".cs"))), paths.join(folder, F.concat(paths.basename(form), F.lit(".cs"))))


def go_modules(files: DataFrame) -> DataFrame:
    """(repo, module) of the first module line of go.mod."""
    mods = files.where(F.col("path") == "go.mod")
    return mods.select("repo", F.regexp_extract("content", r"(?m)^\s*module (.*?)\s*$", 1).alias("module")).where(F.col("module") != "")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, src, dst): the distinct files that a file's imports mean. Rust and TypeScript take the first candidate that exists, the others all.

    The distinct imports are found once and kept, as each step below takes its part of them."""
    imports = cut(imports.select("repo", "path", "lang", "text").distinct())
    known = files.select("repo", F.col("path").alias("dst"))
    text, path = F.col("text"), F.col("path")
    candidates = F.when(F.col("lang") == "rust", _rust(text, path)).when(F.col("lang") == "typescript", _typescript(text, path)).when(F.col("lang") == "python", _python(text, path)).when(F.col("lang") == "csharp", _csharp(text, path))
    offered = imports.where(F.col("lang") != "go").select("repo", "path", "lang", "text", F.posexplode(candidates).alias("ord", "dst"))
    met = offered.join(known, ["repo", "dst"])
    first = met.where(F.col("lang").isin("rust", "typescript")).groupBy("repo", "path", "lang", "text").agg(F.min_by("dst", "ord").alias("dst"))
    every = met.where(~F.col("lang").isin("rust", "typescript")).select("repo", "path", "lang", "text", "dst")
    # C# names that no candidate meets: by the last part of the name, or by the whole name anywhere in the path
    lost = imports.where(F.col("lang") == "csharp").join(every.where(F.col("lang") == "csharp").select("repo", "path", "text").distinct(), ["repo", "path", "text"], "left_anti")
    lost = lost.select("repo", "path", "lang", "text", F.concat(paths.basename(F.replace(text, F.lit("."), F.lit("/"))), F.lit(".cs")).alias("name"))
    named = known.where(F.col("dst").endswith(".cs") & F.contains("dst", F.lit("/"))).withColumn("name", paths.basename(F.col("dst")))
    loose = lost.join(named, ["repo", "name"]).select("repo", "path", "lang", "text", "dst")
    # a module a repo, so that no repo's imports are one task's
    go = imports.where(F.col("lang") == "go").join(F.broadcast(go_modules(files)), "repo").where(F.startswith("text", "module"))
    go = go.withColumn("folder", F.regexp_replace(F.substring(F.col("text"), F.length("module") + 1, F.length("text")), r"^/+", "")).where(F.col("folder") != "")
    there = known.where(F.col("dst").endswith(".go")).withColumn("folder", paths.parent(F.col("dst")))
    go = go.join(there, ["repo", "folder"]).select("repo", "path", "lang", "text", "dst")
    out = first.select("repo", "path", "lang", "text", "dst").unionByName(every).unionByName(loose).unionByName(go)
    return out.select("repo", F.col("path").alias("src"), "dst").distinct()


def resolve_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """calls with callee_file and resolved: the same file, else the only symbol of that name in the repo."""
    called = symbols.where(F.col("kind").isin(*CALLED)).select("repo", F.col("name").alias("callee_name"), F.col("path").alias("callee_file"))
    own = called.select("repo", "callee_name", F.col("callee_file").alias("caller_file")).distinct().withColumn("_own", F.lit(True))
    only = called.groupBy("repo", "callee_name").agg(F.count("*").alias("n"), F.min("callee_file").alias("_only")).where("n = 1").drop("n")
    out = calls.join(own, ["repo", "callee_name", "caller_file"], "left").join(only, ["repo", "callee_name"], "left")
    target = F.when(F.col("_own"), F.col("caller_file")).otherwise(F.col("_only"))
    return out.select("repo", "caller_file", "caller_sym", "callee_name", target.alias("callee_file"), "line", target.isNotNull().alias("resolved"))


def reverse_map(edges: DataFrame) -> DataFrame:
    """(repo, path, depends_on, depended_by) of every end of an edge, lists in order."""
    out = edges.groupBy("repo", F.col("src").alias("path")).agg(F.array_sort(F.collect_set("dst")).alias("depends_on"))
    back = edges.groupBy("repo", F.col("dst").alias("path")).agg(F.array_sort(F.collect_set("src")).alias("depended_by"))
    none = F.array().cast("array<string>")
    return out.join(back, ["repo", "path"], "full_outer").select("repo", "path", F.coalesce("depends_on", none).alias("depends_on"), F.coalesce("depended_by", none).alias("depended_by"))
