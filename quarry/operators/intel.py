"""Composite queries over the index tables: focus, impact, review, layers, test gaps, risk, similarity, navigation.

Tables: symbols (repo, package, path, name, signature, kind, line), edges (src, dst), calls
(caller_file, caller_sym, callee_file, callee_name), commits (path, ts, sha, subject).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import paths, scores, text
from quarry.operators import graph, search
from quarry.sources import repos

HIGH_REFERENCES, CHANGED_SYMBOLS, FRAGILE_POOL, HOTSPOTS = 10, 20, 20, 10
LEAST_SIMILAR = 0.3


def focus(edges: DataFrame, symbols: DataFrame, path: str, radius: int = 2, strict_radius: bool = False) -> DataFrame:
    """(node, score, symbols) of the files near one, in either direction. Beyond two hops all scores are equal, so a radius of 3 takes every file unless it is strict."""
    least = {0: 1.0, 1: 0.5, 2: 0.25}.get(radius, 0.25 if strict_radius else 0.1)
    near = graph.hop_scores(edges, [path], True).where(F.col("score") >= least)
    own = symbols.groupBy(F.col("path").alias("node")).agg(F.array_sort(F.collect_list(F.struct("line", "name", "kind"))).alias("symbols"))
    return near.join(own, "node", "left").orderBy(F.desc("score"), "node")


def definitions(symbols: DataFrame, symbol: str, file: str | None = None, exact: bool = True) -> DataFrame:
    """The symbols of that name, or with it in their name; in order of path, line and name."""
    hit = symbols.where((F.col("name") == symbol) if exact else F.contains("name", F.lit(symbol)))
    hit = hit.where(paths.fits(F.col("path"), file)) if file else hit
    return hit.orderBy("path", "line", "name")


def impact_tier(references: Column, fan_in: Column, dependents: Column, hot: Column, high: int = HIGH_REFERENCES) -> Column:
    return F.when((references > high) | (fan_in > high) | hot, "high").when((references > 3) | (fan_in > 3) | (dependents > 0), "medium").otherwise("low")


def change_impact(symbols: DataFrame, edges: DataFrame, calls: DataFrame, names: Sequence[str], high: int = HIGH_REFERENCES, exact: bool = True, file: str | None = None) -> DataFrame:
    """(symbol, definition, references, ref_count, dependents, affected, fan_in, risk) of named symbols, all in one plan.

    The definition is the first symbol of the name by path and line. With exact names every symbol of the name is a definition,
    so there are no references; else those are the symbols that have the name as a part of theirs. Dependents are within two steps
    of the definition's file, affected functions within two calls of the name.
    """
    asked = F.broadcast(symbols.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(names)], "symbol string"))
    own = symbols.where(paths.fits(F.col("path"), file)) if file else symbols
    first = Window.partitionBy("symbol").orderBy("path", "line")
    defined = own.join(asked, F.col("name") == F.col("symbol")).withColumn("_n", F.row_number().over(first)).where("_n = 1").select("symbol", F.struct("path", "line", "kind").alias("definition"), F.col("path").alias("_file"))
    one = defined.select("symbol", "_file").join(edges, F.col("dst") == F.col("_file")).select("symbol", F.col("src").alias("node"))
    two = one.join(edges, F.col("dst") == F.col("node")).select("symbol", F.col("src").alias("node"))
    hot = graph.hotspots(edges, HOTSPOTS).select(F.col("node").alias("_hot"))
    near = one.unionByName(two).distinct().join(F.broadcast(hot), F.col("node") == F.col("_hot"), "left").groupBy("symbol").agg(F.array_sort(F.collect_set("node")).alias("dependents"), F.bool_or(F.col("_hot").isNotNull()).alias("_any"))
    known = calls.where(F.col("callee_file").isNotNull()).select("caller_file", "caller_sym", "callee_file", "callee_name").distinct()
    by_name = known.join(asked, F.col("callee_name") == F.col("symbol")).select("symbol", "caller_file", "caller_sym").distinct()
    further = by_name.select("symbol", F.col("caller_file").alias("callee_file"), F.col("caller_sym").alias("callee_name")).join(known, ["callee_file", "callee_name"]).select("symbol", "caller_file", "caller_sym")
    reached = by_name.unionByName(further).distinct().groupBy("symbol").agg(F.array_sort(F.collect_set(F.concat_ws(":", "caller_file", "caller_sym"))).alias("affected"))
    out = defined.join(near, "symbol", "left").join(reached, "symbol", "left").join(graph.fan_in(calls), F.col("symbol") == F.col("callee_name"), "left")
    none = F.array().cast("array<struct<path: string, line: int>>")
    if exact:
        out = out.withColumn("references", none)
    else:
        part = own.join(asked, F.contains("name", F.col("symbol")) & (F.col("name") != F.col("symbol")))
        found = part.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("path", "line"))).alias("references"))
        out = out.join(found, "symbol", "left").withColumn("references", F.coalesce("references", none))
    count, fan, n = F.size("references"), F.coalesce("fan_in", F.lit(0)).cast("long"), F.coalesce(F.size("dependents"), F.lit(0))
    empty = F.array().cast("array<string>")
    return out.select(
        "symbol", "definition", "references", count.alias("ref_count"), F.coalesce("dependents", empty).alias("dependents"), F.coalesce("affected", empty).alias("affected"),
        fan.alias("fan_in"), impact_tier(count, fan, F.greatest(n, F.lit(0)), F.coalesce("_any", F.lit(False)), high).alias("risk"),
    )


def impact_summary(impacts: DataFrame) -> DataFrame:
    """One row for a review: how many symbols, of which risk, how many fragile."""
    return impacts.agg(F.count("*").alias("symbols"), *(F.count_if(F.col("risk") == r).alias(r) for r in ("high", "medium", "low")), F.count_if("fragile").alias("fragile"))


def hunk_symbols(hunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols on changed lines (path either way a suffix of the file); all of a file without ranges. Joined by base name, then by range."""
    h = hunks.select("file", "start", "end", paths.basename(F.col("file")).alias("_base"))
    s = symbols.withColumn("_base", paths.basename(F.col("path")))
    on = s.join(h, "_base").where(paths.fits_either_way(F.col("path"), F.col("file")) & (F.col("start").isNull() | F.col("line").between(F.col("start"), F.col("end"))))
    return on.select("path", "name", "kind", "line").distinct()


def changed_symbols(hunks: DataFrame, symbols: DataFrame, most: int = CHANGED_SYMBOLS) -> DataFrame:
    """One changed symbol of each name, the first `most` by path and line."""
    w = Window.partitionBy("name").orderBy("path", "line")
    return hunk_symbols(hunks, symbols).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").orderBy("path", "line", "name").limit(most)


def review(hunks: DataFrame, symbols: DataFrame, edges: DataFrame, calls: DataFrame, commits: DataFrame) -> DataFrame:
    """(symbol, definition, ..., risk, fragile): the impact of every changed symbol, and whether its file is among the fragile ones."""
    names = [r["name"] for r in changed_symbols(hunks, symbols).select("name").collect()]
    found = change_impact(symbols, edges, calls, names)
    weak = fragile(edges, commits, FRAGILE_POOL).select(F.col("node").alias("_weak"))
    return found.join(F.broadcast(weak), F.col("definition.path") == F.col("_weak"), "left").withColumn("fragile", F.col("_weak").isNotNull()).drop("_weak")


def layer_matches(path: Column, pattern: str) -> Column:
    """`p/**` below or at p anywhere, one `*` between two ends, else part of the path."""
    if pattern.endswith("/**"):
        top = pattern[:-3]
        return path.startswith(top) | F.contains(path, F.lit(f"/{top}/"))
    if pattern.count("*") == 1:
        a, b = pattern.split("*")
        return path.startswith(a) & path.endswith(b)
    return F.contains(path, F.lit(pattern))


def layer_of(path: Column, layers: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The first layer with a pattern that fits, or null."""
    fits = [F.when(layer_matches(path, p), F.lit(name)) for name, patterns in layers for p in patterns]
    return F.coalesce(*fits, F.lit(None).cast("string"))


def violations(edges: DataFrame, layers: Sequence[tuple[str, Sequence[str]]], deny: Sequence[tuple[str, str]] = (), allow: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Edges between layers that a deny rule names, or that no allow rule does where there are any."""
    spark = edges.sparkSession
    marked = edges.withColumn("src_layer", layer_of(F.col("src"), layers)).withColumn("dst_layer", layer_of(F.col("dst"), layers)).where("src_layer IS NOT NULL AND dst_layer IS NOT NULL AND src_layer <> dst_layer")
    return rule_violations(marked, spark.createDataFrame(list(deny), "src_layer string, dst_layer string"), spark.createDataFrame(list(allow), "src_layer string, dst_layer string") if allow else None)


def checked_edges(edges: DataFrame, layers: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """(checked, between): how many edges there are, and how many lie between two layers."""
    a, b = layer_of(F.col("src"), layers), layer_of(F.col("dst"), layers)
    return edges.agg(F.count("*").alias("checked"), F.count_if(a.isNotNull() & b.isNotNull() & (a != b)).alias("between"))


def rule_violations(marked: DataFrame, deny: DataFrame, allow: DataFrame | None = None) -> DataFrame:
    """Edges with layers (src_layer, dst_layer) against rule tables; rules are a list in the configuration."""
    on = ["src_layer", "dst_layer"]
    bad = marked.join(F.broadcast(deny), on, "left_semi").withColumn("reason", F.lit("denied"))
    if allow is not None:
        bad = bad.unionByName(marked.join(F.broadcast(deny), on, "left_anti").join(F.broadcast(allow), on, "left_anti").withColumn("reason", F.lit("not allowed")))
    return bad


def is_test(path: Column, name: Column) -> Column:
    low = F.lower(name)
    by_path = path.rlike("test|spec|__tests__")
    by_name = low.startswith("test_") | (low.startswith("test") & F.substring(name, 5, 1).rlike(r"^\p{Lu}")) | low.endswith("_test") | low.startswith("it_") | low.isin("it", "describe")
    return by_path | by_name


def target_names(name: Column) -> Column:
    """What a test may test: its name, and what is left without the usual affixes if that has two bytes."""
    low = F.lower(name)
    rests = [F.when(low.startswith(p), F.substring(low, len(p) + 1, 10_000)) for p in ("test_", "test", "it_", "should_")]
    rests.append(F.when(low.endswith("_test"), F.substring(low, F.lit(1), F.length(low) - 5)))
    return F.array_compact(F.array(name, *(F.when(F.octet_length(r) >= 2, r) for r in rests)))


GRAM = 4


def covered(names: DataFrame, targets: DataFrame) -> DataFrame:
    """(_low) of the names (_low) that hold a target (target) or are held by one.

    Whichever is the shorter, all its grams of GRAM characters are in the other. So the first gram of either side is looked up
    among all grams of the other, and only those pairs are compared. Strings shorter than a gram stand for themselves, and
    are looked up among all parts of their length.
    """
    gram = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, n))
    every = lambda c: F.array_distinct(F.flatten(F.array(*(gram(c, n) for n in range(1, GRAM + 1)))))
    pairs = None
    for short, long in ((targets.select("target"), names.select("_low")), (names.select("_low"), targets.select("target"))):
        (a,), (b,) = short.columns, long.columns
        found = long.distinct().withColumn("_gram", F.explode(every(F.col(b)))).join(short.distinct().withColumn("_gram", F.substring(a, 1, GRAM)), "_gram").where(F.contains(F.col(b), F.col(a))).select("_low")
        pairs = found if pairs is None else pairs.unionByName(found)
    return pairs.distinct()


def test_gaps(symbols: DataFrame, limit: int | None = 50) -> DataFrame:
    """(path, line, name) of functions that no test covers: no target equals the name, holds it or is held by it."""
    f = symbols.where(F.col("kind") == "Function").withColumn("_test", is_test(F.col("path"), F.col("name")))
    targets = f.where("_test").select(F.explode(target_names(F.col("name"))).alias("target")).distinct()
    prod = f.where(~F.col("_test")).withColumn("_low", F.lower("name"))
    left = prod.join(targets.select(F.col("target").alias("name")), "name", "left_anti")
    gaps = left.join(covered(left, targets), "_low", "left_anti").select("path", "line", "name").orderBy("path", "line", "name")
    return gaps if limit is None else gaps.limit(limit)


def test_coverage(symbols: DataFrame) -> DataFrame:
    """One row: tested, untested, tests."""
    f = symbols.where(F.col("kind") == "Function").withColumn("_test", is_test(F.col("path"), F.col("name")))
    n = f.agg(F.count_if("_test").alias("tests"), F.count_if(~F.col("_test")).alias("_prod"))
    gaps = test_gaps(symbols, None).agg(F.count("*").alias("untested"))
    return n.join(F.broadcast(gaps)).select((F.col("_prod") - F.col("untested")).alias("tested"), "untested", "tests")


def fragile(edges: DataFrame, commits: DataFrame, limit: int = 10) -> DataFrame:
    """(node, dependents, churn, score) of hotspots that change often."""
    pool = graph.hotspots(edges, max(limit, FRAGILE_POOL))
    c = repos.churn(commits)
    scored = pool.join(c, F.col("node") == F.col("path"), "left").select("node", "dependents", F.coalesce("churn", F.lit(0)).alias("churn"))
    return scored.withColumn("score", scores.fragility(F.col("dependents"), F.col("churn"))).orderBy(F.desc("score"), "node").limit(limit)


def file_risk(edges: DataFrame, symbols: DataFrame, commits: DataFrame, limit: int = 10) -> DataFrame:
    """(target, score, tier) of the hotspots. Complexity is the logarithm of the number of symbols; a file has a gap if it has functions and no tests of its own cover one."""
    pool = graph.hotspots(edges, max(limit, HOTSPOTS))
    size = symbols.groupBy("path").agg(F.log1p(F.count("*").cast("double")).alias("complexity"))
    f = symbols.where(F.col("kind") == "Function").withColumn("_test", is_test(F.col("path"), F.col("name")))
    prod = f.where(~F.col("_test")).select("path", F.lower("name").alias("_low"), "name")
    own = f.where("_test").select("path", F.explode(target_names(F.col("name"))).alias("target"))
    open_ = prod.join(own, (prod["path"] == own["path"]) & (F.contains("_low", F.col("target")) | F.contains("target", F.col("_low")) | (F.col("target") == F.col("name"))), "left_anti").select("path").distinct().withColumn("gap", F.lit(1.0))
    rows = pool.select(F.col("node").alias("path"), "dependents")
    for other in (repos.churn(commits), repos.bugfix_ratio(commits), size, open_):
        rows = rows.join(other, "path", "left")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    p = scores.risk_probability(zero("dependents"), F.lit(0.0), zero("churn"), zero("bugfix_ratio"), zero("complexity"), zero("gap"))
    return rows.select(F.col("path").alias("target"), p.alias("score")).withColumn("tier", scores.risk_tier(F.col("score"))).orderBy(F.desc("score"), "target").limit(limit)


def symbol_risk(symbols: DataFrame, edges: DataFrame, calls: DataFrame, commits: DataFrame, names: Sequence[str]) -> DataFrame:
    """(target, score, tier) of named symbols: fan-in of the name, dependents, churn and bug fixes of its first file, and whether a test covers it."""
    asked = F.broadcast(symbols.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(names)], "symbol string"))
    first = Window.partitionBy("symbol").orderBy("path", "line")
    rows = symbols.join(asked, F.col("name") == F.col("symbol")).withColumn("_n", F.row_number().over(first)).where("_n = 1").select("symbol", "path")
    gaps = test_gaps(symbols, None).select(F.col("name").alias("symbol")).distinct().withColumn("gap", F.lit(1.0))
    for other, on in ((graph.fan_in(calls).withColumnRenamed("callee_name", "symbol"), "symbol"), (gaps, "symbol"), (graph.in_degrees(edges).withColumnRenamed("node", "path"), "path"), (repos.churn(commits), "path"), (repos.bugfix_ratio(commits), "path")):
        rows = rows.join(other, on, "left")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    p = scores.risk_probability(zero("dependents"), zero("fan_in"), zero("churn"), zero("bugfix_ratio"), F.lit(1.0), zero("gap"))
    return rows.select(F.col("symbol").alias("target"), p.alias("score")).withColumn("tier", scores.risk_tier(F.col("score")))


def similarity(a_kind: Column, a_sig: Column, a_name: Column, kind: Column, sig: Column, name: Column) -> Column:
    """0.4 for the kind, 0.2 each for the numbers of parentheses and of words, 0.2 for equal characters in place."""
    parens = lambda s: F.length(s) - F.length(F.replace(s, F.lit("("), F.lit("")))
    words = lambda s: F.size(F.filter(F.split(s, r"(?U)\s+"), lambda w: w != ""))
    return F.when(a_kind == kind, 0.4).otherwise(0.0) + F.when(parens(a_sig) == parens(sig), 0.2).otherwise(0.0) + F.when(words(a_sig) == words(sig), 0.2).otherwise(0.0) + text.positional_similarity(a_name, name) * 0.2


def similar(symbols: DataFrame, symbol: str, file: str | None = None, limit: int = 5) -> DataFrame:
    """(name, path, line, signature, score) of the symbols most like one. The one symbol is a row, so the join is a broadcast."""
    target = definitions(symbols, symbol, file).limit(1).select(F.col("kind").alias("_k"), F.col("signature").alias("_s"), F.col("name").alias("_n"))
    scored = symbols.where(F.col("name") != symbol).join(F.broadcast(target)).withColumn("score", similarity(F.col("_k"), F.col("_s"), F.col("_n"), F.col("kind"), F.col("signature"), F.col("name")))
    return scored.where(F.col("score") >= LEAST_SIMILAR).select("name", "path", "line", "signature", "score").orderBy(F.desc(F.round("score", 9)), "name", "path", "line").limit(limit)


def resolve_hint(edges: DataFrame, symbols: DataFrame, hint: str) -> DataFrame:
    """(path) that a hint means: a node of the graph, a package, a part of a path, a symbol; the first that fits."""
    low = hint.lower()
    branches = (
        graph.nodes(edges).where((F.col("node") == hint) | F.col("node").endswith(hint)).select(F.lit(0).alias("rank"), F.col("node").alias("path")),
        symbols.where(F.lower("package") == low).select(F.lit(1).alias("rank"), "path"),
        symbols.where(F.contains("path", F.lit(hint))).select(F.lit(2).alias("rank"), "path"),
        symbols.where(F.lower("name") == low).select(F.lit(3).alias("rank"), "path"),
    )
    out = branches[0]
    for b in branches[1:]:
        out = out.unionByName(b)
    return out.orderBy("rank", "path").limit(1).select("path")


def explain(edges: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """(kind, name, detail): what a name means as a package, file or symbol; the first kind that fits."""
    low = name.lower()
    p = symbols.where(F.lower("package") == low).groupBy(F.col("package").alias("name")).agg(F.concat_ws("; ", F.concat(F.countDistinct("path").cast("string"), F.lit(" files")), F.array_join(F.slice(F.array_sort(F.collect_set("name")), 1, 8), ", ")).alias("detail")).withColumns({"rank": F.lit(0), "kind": F.lit("package")})
    f = graph.in_degrees(edges).where(paths.fits(F.col("node"), name)).select(F.col("node").alias("name"), F.concat(F.col("dependents").cast("string"), F.lit(" dependents")).alias("detail"), F.lit(1).alias("rank"), F.lit("file").alias("kind"))
    s = symbols.where(F.lower("name") == low).select("name", F.format_string("%s:%d %s", "path", "line", "signature").alias("detail"), F.lit(2).alias("rank"), F.lit("symbol").alias("kind"))
    both = p.unionByName(f).unionByName(s)
    return both.orderBy("rank", "name", "detail").limit(1).select("kind", "name", "detail")


def why_file(edges: DataFrame, commits: DataFrame, path: str, n: int = 3, blame: str | None = None) -> DataFrame:
    """One row: package, what the file depends on, what depends on it, its last commits, and the blame of its first line if that is given."""
    one = edges.sparkSession.createDataFrame([(path, blame)], "path string, blame string").withColumn("package", paths.package(F.col("path")))
    one = one if blame is not None else one.drop("blame")
    out = edges.where(F.col("src") == path).agg(F.array_sort(F.collect_set("dst")).alias("depends_on"))
    back = edges.where(F.col("dst") == path).agg(F.array_sort(F.collect_set("src")).alias("depended_by"))
    log = repos.log_of(commits, path, n).agg(F.sort_array(F.collect_list(F.struct("ts", "subject")), asc=False).alias("_log")).select(F.transform("_log", lambda x: x["subject"]).alias("commits"))
    return one.join(F.broadcast(out)).join(F.broadcast(back)).join(F.broadcast(log))


def task_context(index: search.Index, edges: DataFrame, symbols: DataFrame, query: str, file: str | None = None, limit: int = 10) -> tuple[DataFrame, DataFrame]:
    """The best matches for a task, near a file if one is given, and the first symbols of the best package."""
    found = search.with_proximity(index, query, graph.hop_scores(edges, [file] if file else []), limit)
    best = found.where(F.col("kind") == "package").orderBy(F.desc("score"), "doc_id").limit(1).select(F.col("name").alias("package"))
    return found, symbols.join(F.broadcast(best), "package").select("name").distinct().orderBy("name").limit(8)


def navigate(index: search.Index, edges: DataFrame, symbols: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """(path, rank): files to read for a query in order of their first match; a package stands for its first three files."""
    found = search.with_proximity(index, query, graph.hop_scores(edges, []), limit)
    ranked = found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))
    w = Window.partitionBy("package").orderBy("path")
    first = symbols.select("package", "path").distinct().withColumn("_n", F.row_number().over(w)).where("_n <= 3").drop("_n")
    by_package = ranked.where(F.col("kind") == "package").select(F.col("name").alias("package"), "rank").join(first, "package").select("path", "rank")
    direct = ranked.where(F.col("path").isNotNull() & (F.col("kind") != "package")).select("path", "rank")
    return direct.unionByName(by_package).groupBy("path").agg(F.min("rank").alias("rank")).orderBy("rank", "path").limit(limit)


def feature_guide(index: search.Index, edges: DataFrame, symbols: DataFrame, query: str, sections: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """(part, place, value): the anchors of a question (best matches), the files to read in order, documentation that names it,
    and the shortest path between the first two files."""
    rank = lambda c: F.row_number().over(Window.orderBy(*c)) - 1
    found = search.with_proximity(index, query, graph.hop_scores(edges, []), max(limit, 5))
    row = lambda part, place, value: (F.lit(part).alias("part"), place.cast("int").alias("place"), value.alias("value"))
    out = found.select(*row("anchor", rank((F.desc(F.round("score", 9)), "doc_id")), F.concat_ws(" ", "kind", "name")))
    files = navigate(index, edges, symbols, query, limit)
    order = [r["path"] for r in files.collect()]
    out = out.unionByName(files.select(*row("read", rank(("rank", "path")), F.col("path"))))
    if sections is not None:
        docs_ = search.keywords(sections, query, 5, "id")
        out = out.unionByName(docs_.select(*row("docs", rank((F.desc(F.round("score", 9)), "doc_id")), F.col("doc_id"))))
    if len(order) > 1:
        out = out.unionByName(graph.shortest_path(edges, order[0], order[1]).select(*row("path", F.col("place"), F.col("node"))))
    return out
