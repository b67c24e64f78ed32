"""Packages: grouping, conventions, purposes, hot symbols, public surface, dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import paths

# Tags and the text that a file with the tag holds.
CONVENTIONS = (
    ("error:anyhow", "anyhow"),
    ("error:thiserror", "thiserror"),
    ("error:Result", "Result<"),
    ("log:tracing", "tracing::"),
    ("log:log", "log::"),
    ("async", "async fn"),
    ("test", "#[test]"),
    ("test", "def test_"),
    ("export", "export "),
    ("pub", "pub fn"),
)
# Short codes of the kinds of symbols.
KIND_CODES = {"Function": "fn", "Struct": "st", "Enum": "en", "Trait": "tr", "Module": "md", "Variable": "vr", "Other": "ot"}
TAGS, HOT_POOL, HOT, PRUNE = 5, 20, 10, 0.05


def grouped(files: DataFrame) -> DataFrame:
    """(repo, package, files): the paths of each package in order."""
    return files.withColumn("package", paths.package(F.col("path"))).groupBy("repo", "package").agg(F.array_sort(F.collect_list("path")).alias("files"))


def conventions(files: DataFrame, patterns: tuple[tuple[str, str], ...] = CONVENTIONS, most: int = TAGS) -> DataFrame:
    """(repo, package, tags, async_fn, has_tests): the tags of most files, ties by name."""
    f = files.withColumn("package", paths.package(F.col("path")))
    has = lambda needle: F.contains("content", F.lit(needle))
    hits = F.array_compact(F.array(*(F.when(has(needle), F.lit(tag)) for tag, needle in patterns)))
    counted = f.select("repo", "package", F.explode(hits).alias("tag")).groupBy("repo", "package", "tag").agg(F.count("*").alias("n"))
    best = Window.partitionBy("repo", "package").orderBy(F.desc("n"), "tag")
    top = counted.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).groupBy("repo", "package").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag"))), lambda x: x["tag"]).alias("tags"))
    flags = f.groupBy("repo", "package").agg(F.bool_or(has("async fn")).alias("async_fn"), F.bool_or(has("#[test]") | has("def test_")).alias("has_tests"))
    return flags.join(top, ["repo", "package"], "left").select("repo", "package", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "async_fn", "has_tests")


def purposes(symbols: DataFrame, tags: DataFrame) -> DataFrame:
    """(repo, package, purpose): the name, the first three symbols and the tags."""
    # ranks leave every task three names a package, so that no package's names are one list
    by_name = Window.partitionBy("repo", "package").orderBy(F.asc_nulls_last("name"))
    ranked = symbols.select("repo", "package", "name").distinct().withColumn("rank", F.row_number().over(by_name)).where("rank <= 3")
    first = ranked.groupBy("repo", "package").agg(F.array_sort(F.collect_list("name")).alias("names"))
    both = tags.select("repo", "package", "tags").join(first, ["repo", "package"], "full_outer")
    names = F.when(F.size(F.coalesce("names", F.array())) > 0, F.concat(F.lit(": "), F.array_join("names", ", "))).otherwise("")
    marks = F.when(F.size(F.coalesce("tags", F.array())) > 0, F.concat(F.lit(" ("), F.array_join("tags", ", "), F.lit(")"))).otherwise("")
    return both.select("repo", "package", F.concat("package", names, marks).alias("purpose"))


def summaries(files: DataFrame, proximity: DataFrame | None = None, least: float = PRUNE) -> DataFrame:
    """(repo, package, files, score): the mean proximity of a package's files, 0.1 for those without."""
    f = files.select("repo", "path", paths.package(F.col("path")).alias("package"))
    scored = f.join(proximity.select(F.col("node").alias("path"), "score"), "path", "left") if proximity is not None else f.withColumn("score", F.lit(0.1))
    return scored.groupBy("repo", "package").agg(F.count("*").alias("files"), F.avg(F.coalesce("score", F.lit(0.1))).alias("score")).where(F.col("score") >= least).orderBy(F.desc("score"), "package")


def hot_symbols(symbols: DataFrame, usage: DataFrame | None = None, pool: int = HOT_POOL, limit: int = HOT) -> DataFrame:
    """(name, n): the first names of all, ranked by use. usage: (key, n)."""
    first = symbols.select("name").distinct().orderBy("name").limit(pool)
    used = first.join(usage.groupBy("key").agg(F.sum("n").alias("n")), F.col("name") == F.col("key"), "left") if usage is not None else first.withColumn("n", F.lit(0).cast("long"))
    return used.select("name", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("n"), "name").limit(limit)


def is_public() -> Column:
    sig, path, kind = F.col("signature"), F.col("path"), F.col("kind")
    marked = F.contains(sig, F.lit("pub ")) | F.contains(sig, F.lit("export "))
    entry = path.endswith("lib.rs") | path.endswith("mod.rs") | path.endswith("index.ts")
    capital = F.col("name").rlike(r"^\p{Lu}")
    return marked | F.when(entry, kind.isin("Function", "Struct", "Enum")).otherwise(capital & kind.isin("Function", "Struct"))


def api_surface(symbols: DataFrame, package: str | None = None) -> DataFrame:
    """(repo, package, exports, internal_count): the public symbols by name."""
    s = symbols if package is None else symbols.where(F.col("package") == package)
    s = s.withColumn("public", is_public())
    entry = F.when(F.col("public"), F.struct("name", "path", "line", "kind"))
    return s.groupBy("repo", "package").agg(F.array_sort(F.array_compact(F.collect_list(entry))).alias("exports"), F.count_if(~F.col("public")).alias("internal_count"))


def examples(symbols: DataFrame, package: str, most: int = 2) -> DataFrame:
    """The signatures to show for a package, public ones first."""
    s = symbols.where((F.col("package") == package) & (F.col("kind") == "Function"))
    return s.select("signature", F.contains("signature", F.lit("pub ")).alias("public"), "path", "line").orderBy(F.desc("public"), "path", "line").limit(most).select("signature")


def path_ids(paths_: DataFrame) -> DataFrame:
    """(id, path): distinct paths in order, p1 onwards.

    Numbers come from range partitions: each is sorted by itself, and the counts of those before it are added.
    """
    from quarry.operators.numbering import numbered

    return numbered(paths_.select("path").distinct(), ["path"]).select(F.concat(F.lit("p"), F.col("n").cast("string")).alias("id"), "path")


def symbol_ids(symbols: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, p, n, g, l): symbols by path, line and name, s1 onwards, with the id of their path."""
    from quarry.operators.numbering import numbered

    rows = numbered(symbols.select("path", "line", "name", "signature").distinct(), ["path", "line", "name", "signature"])
    return rows.join(ids.select(F.col("id").alias("p"), "path"), "path").select(F.concat(F.lit("s"), F.col("n").cast("string")).alias("id"), "p", F.col("name").alias("n"), F.col("signature").alias("g"), F.col("line").alias("l"))


def delta(now: DataFrame, before: DataFrame) -> DataFrame:
    """Entries (id, path) that the earlier dictionary lacks, numbered after its last."""
    from quarry.operators.numbering import numbered

    last = before.agg(F.coalesce(F.max(F.substring("id", 2, 20).cast("long")), F.lit(0)).alias("last")).first()["last"]
    new = numbered(now.select("path").distinct().join(before, "path", "left_anti"), ["path"])
    return new.select(F.concat(F.lit("p"), (F.col("n") + last).cast("string")).alias("id"), "path")


def expanded(refs: DataFrame, ids: DataFrame) -> DataFrame:
    """refs (ref) with path: a known id's path, else the reference itself."""
    return refs.join(ids.withColumnRenamed("path", "_path"), F.col("ref") == F.col("id"), "left").select("ref", F.coalesce("_path", "ref").alias("path"))


def encoded_symbols(symbols: DataFrame) -> DataFrame:
    """(path, line, name, json): symbols with short keys; empty fields are left out."""
    code = F.coalesce(*(F.when(F.col("kind") == k, F.lit(c)) for k, c in KIND_CODES.items()))
    return symbols.select("path", "line", "name", F.to_json(F.struct(F.col("name").alias("n"), code.alias("k"), F.nullif(F.col("signature"), F.lit("")).alias("g"), F.col("line").alias("l"))).alias("json"))


def _list(column: str) -> Column:
    """A list, or null if it is empty."""
    return F.when(F.size(column) > 0, F.col(column))


def _coded(*fields: Column) -> Column:
    """JSON of the fields that aren't null; the codes of empty texts and lists are left out."""
    return F.to_json(F.struct(*fields))


def _text(column: str) -> Column:
    return F.nullif(F.col(column), F.lit(""))


def _symbols(column: str) -> Column:
    code = lambda k: F.coalesce(*(F.when(k == name, F.lit(c)) for name, c in KIND_CODES.items()))
    return F.when(F.size(column) > 0, F.transform(column, lambda x: F.struct(x["name"].alias("n"), code(x["kind"]).alias("k"), x["line"].alias("l"))))


def encoded_packages(summaries_: DataFrame, purposes_: DataFrame) -> DataFrame:
    """(repo, package, json) of package summaries: name, purpose, files, score."""
    rows = summaries_.join(purposes_, ["repo", "package"], "left")
    return rows.select("repo", "package", _coded(F.col("package").alias("n"), _text("purpose").alias("p"), F.col("files").alias("f"), F.col("score").alias("s")).alias("json"))


def encoded_details(entries: DataFrame) -> DataFrame:
    """(repo, package, json) of file entries: a package's files with symbols, what they depend on and what on them."""
    one = F.struct(F.col("path").alias("p"), _symbols("symbols").alias("sy"), _list("depends_on").alias("d"), _list("depended_by").alias("b"))
    rows = entries.withColumn("package", paths.package(F.col("path"))).select("repo", "package", "path", one.alias("one"))
    grouped_ = rows.groupBy("repo", "package").agg(F.transform(F.array_sort(F.collect_list(F.struct("path", F.to_json("one").alias("json")))), lambda x: x["json"]).alias("f"))
    return grouped_.select("repo", "package", F.concat(F.lit('{"n":'), F.to_json(F.array("package")).substr(F.lit(2), F.length(F.to_json(F.array("package"))) - 2), F.lit(',"f":['), F.array_join("f", ","), F.lit("]}")).alias("json"))


def encoded_matches(found: DataFrame) -> DataFrame:
    """found with json: the first letter of the kind, name, detail, score, hint."""
    return found.withColumn("json", _coded(F.substring("kind", 1, 1).alias("k"), F.col("name").alias("n"), _text("detail").alias("d"), F.col("score").alias("s"), _text("hint").alias("h")))


def encoded_focus(near: DataFrame) -> DataFrame:
    """(node, json) of the neighbours (node, score, symbols) of a file."""
    return near.select("node", _coded(F.col("node").alias("p"), F.col("score").alias("sc"), _symbols("symbols").alias("sy")).alias("json"))


def encoded_impacts(impacts: DataFrame) -> DataFrame:
    """(symbol, json): definition, references and their number, dependents, affected functions, fan-in, risk."""
    place = lambda x: F.struct(x["path"].alias("p"), x["line"].alias("l"))
    fields = (F.col("symbol").alias("sym"), F.when(F.col("definition").isNotNull(), place(F.col("definition"))).alias("def"), F.transform("references", place).alias("rf"), F.col("ref_count").alias("rc"))
    more = (_list("dependents").alias("df"), _list("affected").alias("af"), F.nullif("fan_in", F.lit(0)).alias("fi"), F.col("risk").alias("risk"))
    return impacts.select("symbol", _coded(*fields, *more).alias("json"))


def encoded_task(query: str, found: DataFrame, names: DataFrame) -> DataFrame:
    """(json): a question, its matches in order of score, and the symbols of the best package (name)."""
    best = encoded_matches(found).select("score", "doc_id", "json").groupBy().agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_id", "json"))).alias("m"))
    drill = names.groupBy().agg(F.array_sort(F.collect_list("name")).alias("sy"))
    parts = best.join(F.broadcast(drill))
    head = F.to_json(F.struct(F.lit(query).alias("q")))
    drilled = F.when(F.size("sy") > 0, F.concat(F.lit(',"drill":'), F.to_json(F.struct(F.col("sy"))))).otherwise("")
    return parts.select(F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"m":['), F.array_join(F.transform("m", lambda x: x["json"]), ","), F.lit("]"), drilled, F.lit("}")).alias("json"))


def encoded_signals(signals: DataFrame) -> DataFrame:
    """(session, iteration, json) of loop signals: stale count, recommended, reindexed, pause, stop."""
    return signals.select("session", "iteration", _coded(F.col("stale_count").alias("sc"), F.col("recommended").alias("rr"), F.col("reindexed").alias("ri"), F.col("pause").alias("sp"), F.col("stop").alias("ss")).alias("json"))
