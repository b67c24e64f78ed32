"""Documentation: sections, links, references, slices, staleness, briefs. Files are (repo, path, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import paths, text
from quarry.operators.extract import lines

# Fixed value: paths in prose.
PATH_LIKE = r"\b((?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+\.(?:rs|go|py|ts|tsx|js|jsx|cs))\b"
#: The word that marks an explicit link in an HTML comment.
MARKER = "quarry"
SNIPPET, EXCERPT, LEAST_NAME = 200, 1200, 3
HEADING = r"(?U)^\s*(#{1,6})(?!#)\s*(\S.*)$"


def headings(docs: DataFrame) -> DataFrame:
    """(repo, path, line, level, heading) of one to six `#` and a text; fences are not looked at."""
    rows = lines(docs)
    marks = F.regexp_extract("text", HEADING, 1)
    title = F.concat(marks, F.lit(" "), F.regexp_extract("text", HEADING, 2))
    return rows.where(F.col("text").rlike(HEADING)).select("repo", "path", "line", F.length(marks).alias("level"), title.alias("heading"))


def extents(docs: DataFrame) -> DataFrame:
    """(repo, path, heading, level, start_line, end_line): a section reaches to the next heading of its level or a higher one, or to the end.

    The next such heading is the first of the six running minima that windows keep by level, so no range join is needed.
    """
    found = headings(docs)
    ahead = Window.partitionBy("repo", "path").orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    ends = [F.min(F.when(F.col("level") <= k, F.col("line"))).over(ahead).alias(f"_e{k}") for k in range(1, 7)]
    placed = found.select("*", *ends)
    last = docs.select("repo", "path", F.size(text.lines(F.col("content"))).alias("_n"))
    end = F.coalesce(*(F.when(F.col("level") == k, F.col(f"_e{k}") - 1) for k in range(1, 7)), F.col("_n"))
    with_headings = placed.join(last, ["repo", "path"]).select("repo", "path", "heading", "level", F.col("line").alias("start_line"), end.alias("end_line"))
    bare = last.join(found.select("repo", "path").distinct(), ["repo", "path"], "left_anti")
    return with_headings.unionByName(bare.select("repo", "path", F.lit("").alias("heading"), F.lit(0).alias("level"), F.lit(1).alias("start_line"), F.greatest(F.lit(1), F.col("_n")).alias("end_line")))


def sections(docs: DataFrame) -> DataFrame:
    """extents with id, the section's whole text and a snippet of its body."""
    body = docs.select("repo", "path", text.lines(F.col("content")).alias("_lines"))
    s = extents(docs).join(body, ["repo", "path"])
    span = lambda first: F.array_join(F.slice(F.col("_lines"), first, F.greatest(F.lit(0), F.col("end_line") - first + 1)), "\n")
    whole = span(F.col("start_line"))
    inner = F.when(F.col("level") == 0, whole).otherwise(span(F.col("start_line") + 1))
    ident = F.when(F.col("level") == 0, F.col("path")).otherwise(F.concat_ws("::", "path", "heading"))
    return s.select("repo", ident.alias("id"), "path", "heading", "level", "start_line", "end_line", whole.alias("text"), F.substring(text.strip(inner), 1, SNIPPET).alias("snippet"))


def links(found: DataFrame, files: DataFrame, symbols: DataFrame, marker: str = MARKER) -> DataFrame:
    """(repo, id, target, kind, broken): links in comments, paths in prose, names of symbols as whole words.

    Names meet the sections' words in an equi-join instead of a search for each name.
    """
    comment = rf"(?iU)<!--\s*{marker}:\s*([^>]+?)\s*-->"
    explicit = found.select("repo", "id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(comment), 1))).alias("target")).where(F.col("target") != "")
    prose = found.select("repo", "id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(PATH_LIKE), 1))).alias("target"))
    named = explicit.select("repo", "id", F.regexp_replace("target", r"::.*$", "").alias("target")).distinct()
    prose = prose.join(named, ["repo", "id", "target"], "left_anti")
    known = files.select("repo", F.col("path").alias("_known")).distinct().withColumn("_there", F.lit(True))
    both = explicit.withColumn("kind", F.lit("explicit")).unionByName(prose.withColumn("kind", F.lit("heuristic")))
    both = both.withColumn("_known", F.regexp_replace(reference(F.col("target"))["path"], r"^(?:\./)+", ""))
    checked = both.join(known, ["repo", "_known"], "left").select("repo", "id", "target", "kind", (F.col("_there").isNull() & (F.col("_known") != "")).alias("broken"))
    words = found.select("repo", "id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?U)(\w+)"), 1))).alias("name"))
    names = symbols.select("repo", "name").where(F.octet_length("name") >= LEAST_NAME).distinct()
    mentions = words.join(names, ["repo", "name"]).select("repo", "id", F.concat(F.lit("::"), "name").alias("target"), F.lit("heuristic").alias("kind"), F.lit(False).alias("broken"))
    return checked.unionByName(mentions)


def reference(ref: Column) -> Column:
    """struct(path, kind, anchor, start, end): the last `::` parts a heading or symbol, `#N-M` lines, else the whole file."""
    after = text.strip(F.regexp_extract(ref, r"(?s)^.*::(.*)$", 1))
    a, b = (F.regexp_extract(ref, r"(?s)^.+#(\d{1,9})-(\d{1,9})$", k) for k in (1, 2))
    start, end = F.nullif(a, F.lit("")).cast("int"), F.nullif(b, F.lit("")).cast("int")
    none = F.lit(None)

    def made(path: Column, kind: str, anchor: Column, s: Column, e: Column) -> Column:
        return F.struct(path.alias("path"), F.lit(kind).alias("kind"), anchor.cast("string").alias("anchor"), s.cast("int").alias("start"), e.cast("int").alias("end"))

    path = F.regexp_extract(ref, r"(?s)^(.*)::.*$", 1)
    split = F.contains(ref, F.lit("::"))
    return (
        F.when(split & after.startswith("#"), made(path, "heading", after, none, none))
        .when(split, made(path, "symbol", after, none, none))
        .when((start >= 1) & (end >= start), made(F.regexp_extract(ref, r"(?s)^(.+)#\d+-\d+$", 1), "lines", none, start, end))
        .otherwise(made(ref, "whole", none, none, none))
    )


def brace_end(files: DataFrame, starts: DataFrame) -> DataFrame:
    """(repo, path, name, line, end): the first line at which the braces opened since `line` are closed again; null without one."""
    body = lines(files).select("repo", "path", F.col("line").alias("at"), "text")
    reach = starts.join(body, ["repo", "path"]).where(F.col("at") >= F.col("line"))
    only = F.regexp_replace("text", r"[^{}]", "")
    # depth after the line, and the least depth reached behind a closing brace in it
    walk = F.aggregate(F.split(only, ""), F.struct(F.lit(0).alias("d"), F.lit(10**6).alias("least")), lambda acc, c: F.struct((acc["d"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("d"), F.when(c == "}", F.least(acc["least"], acc["d"] - 1)).otherwise(acc["least"]).alias("least")))
    w = Window.partitionBy("repo", "path", "name", "line").orderBy("at")
    walked = reach.withColumn("_w", walk).withColumn("_before", F.coalesce(F.sum("_w.d").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    closed = walked.where(F.col("_before") + F.col("_w.least") <= 0).groupBy("repo", "path", "name", "line").agg(F.min("at").alias("end"))
    return starts.join(closed, ["repo", "path", "name", "line"], "left")


def slices(refs: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(ref, path, start_line, end_line, content, error) of references (repo, ref); errors are FileNotFound, SymbolNotFound, HeadingNotFound, LineRangeOutOfBounds."""
    r = refs.select("repo", "ref", reference(F.col("ref")).alias("r")).select("repo", "ref", "r.*")
    body = files.select("repo", "path", text.lines(F.col("content")).alias("_lines"))
    at = r.join(body, ["repo", "path"], "left")
    n = F.size("_lines")
    ordered = Window.partitionBy("repo", "path").orderBy("line")
    ends = brace_end(files, symbols.select("repo", "path", "name", "line")).withColumn("_next", F.lead("line").over(ordered))
    first = ends.groupBy("repo", "path", F.col("name").alias("anchor")).agg(F.min(F.struct("line", "end", "_next")).alias("s"))
    bound = F.least(F.coalesce(F.col("s.end"), F.lit(10**9)), F.coalesce(F.col("s._next") - 1, F.lit(10**9)))
    first = first.select("repo", "path", "anchor", F.lit("symbol").alias("kind"), F.col("s.line").alias("_s"), bound.alias("_e"))
    heads = extents(files.where(F.lower("path").rlike(r"\.mdx?$"))).where("level > 0").groupBy("repo", "path", F.lower("heading").alias("_low")).agg(F.min(F.struct("start_line", "end_line")).alias("h"))
    heads = heads.select("repo", "path", "_low", F.lit("heading").alias("kind"), F.col("h.start_line").alias("_hs"), F.col("h.end_line").alias("_he"))
    at = at.withColumn("_low", F.lower("anchor")).join(first, ["repo", "path", "anchor", "kind"], "left").join(heads, ["repo", "path", "_low", "kind"], "left")
    start = F.when(F.col("kind") == "whole", F.lit(1)).when(F.col("kind") == "lines", F.col("start")).otherwise(F.coalesce("_s", "_hs"))
    end = F.least(n, F.when(F.col("kind") == "whole", n).when(F.col("kind") == "lines", F.col("end")).otherwise(F.coalesce("_e", "_he")))
    error = F.when(F.col("_lines").isNull(), "FileNotFound").when((F.col("kind") == "symbol") & F.col("_s").isNull(), "SymbolNotFound").when((F.col("kind") == "heading") & F.col("_hs").isNull(), "HeadingNotFound").when((F.col("kind") == "lines") & (F.col("end") > n), "LineRangeOutOfBounds")
    out = at.withColumns({"start_line": start, "end_line": end, "error": error})
    content = F.when(F.col("error").isNull(), F.array_join(F.slice("_lines", F.col("start_line"), F.greatest(F.lit(0), F.col("end_line") - F.col("start_line") + 1)), "\n"))
    ok = F.col("error").isNull()
    return out.select("repo", "ref", "path", F.when(ok, F.col("start_line")).alias("start_line"), F.when(ok, F.col("end_line")).alias("end_line"), content.alias("content"), "error")


def stale_sections(linked: DataFrame, changes: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """(id, stale): a section is stale if a linked file changed after the section's own file did.

    linked: (id, file, target, broken); changes: (path, ts) of code and documentation alike. Two latest times are
    compared, so the order in which events arrive doesn't matter. Links that are broken don't count.
    """
    latest = changes.groupBy("path").agg(F.max("ts").alias("ts"))
    target = linked.where(~F.col("broken")).select("id", "file", reference(F.col("target")).alias("r")).select("id", "file", F.col("r.path").alias("_path"), F.col("r.anchor").alias("_anchor"))
    by_path = target.where(F.col("_path") != "").join(latest.select(F.col("path").alias("_changed"), "ts", paths.basename(F.col("path")).alias("_name")), paths.basename(F.col("_path")) == F.col("_name")).where(paths.fits_either_way(F.col("_path"), F.col("_changed")) | ~F.contains("_path", F.lit("/"))).select("id", "ts")
    if symbols is not None:
        where = symbols.select(F.col("name").alias("_anchor"), F.col("path").alias("_changed")).distinct()
        by_path = by_path.unionByName(target.where(F.col("_path") == "").join(where, "_anchor").join(latest.withColumnRenamed("path", "_changed"), "_changed").select("id", "ts"))
    code = by_path.groupBy("id").agg(F.max("ts").alias("_code"))
    own = linked.select("id", "file").distinct().join(latest.select(F.col("path").alias("file"), F.col("ts").alias("_own")), "file", "left")
    return own.join(code, "id", "left").select("id", F.coalesce(F.col("_code") > F.coalesce("_own", F.lit("0001-01-01").cast("timestamp")), F.lit(False)).alias("stale"))


def status(found: DataFrame, linked: DataFrame, stale: DataFrame) -> DataFrame:
    """One row: files, sections, ids of stale sections, broken links."""
    a = found.agg(F.countDistinct("path").alias("files"), F.count("*").alias("sections"))
    b = stale.agg(F.array_sort(F.collect_list(F.when(F.col("stale"), F.col("id")))).alias("stale_ids"))
    c = linked.agg(F.count_if("broken").alias("broken_links"))
    return a.join(F.broadcast(b)).join(F.broadcast(c))


def briefs(found: DataFrame, linked: DataFrame, stale: DataFrame, files: DataFrame, most: int = EXCERPT) -> DataFrame:
    """(id, brief) for the stale sections: the snippet, and the beginning of each linked file."""
    chosen = stale.where("stale").select("id").join(found, "id")
    code = linked.where(~F.col("broken")).withColumn("path", reference(F.col("target"))["path"]).join(files.select("repo", "path", F.substring("content", 1, most).alias("excerpt")), ["repo", "path"])
    shown = code.groupBy("id").agg(F.array_sort(F.collect_list(F.concat(F.lit("### "), F.col("target"), F.lit("\n"), F.col("excerpt")))).alias("code"))
    return chosen.join(shown, "id", "left").select("id", F.concat_ws("\n\n", F.concat(F.lit("## "), F.col("id")), F.col("snippet"), F.array_join(F.coalesce("code", F.array().cast("array<string>")), "\n\n")).alias("brief"))
