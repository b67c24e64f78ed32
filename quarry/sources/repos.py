"""Sources: repositories, files, git facts, diffs, manifests."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import paths
from quarry.operators.extract import lines
from quarry.sources.checkpoints import qualified

# Folders that are never scanned.
IGNORED_DIRS = (
    "node_modules", "vendor", "dist", "build", "out", ".next", ".nuxt",
    "target", "__pycache__", ".venv", "venv", "env", ".tox",
    ".git", ".codeindex", ".idea", ".vscode",
    "Library", "Temp", "Obj", "obj", "Logs", "Build", "Builds",
    "MemoryCaptures", "UserSettings", "bin", ".vs",
)
# Fixed value: subjects of bug fixes.
BUGFIX = r"(?i)\b(fix|bug|cve|hotfix|regress)\b"
FILE_SCHEMA = "repo string, path string, content string, mtime timestamp, n_bytes long"


def discover_repos(root: str) -> list[str]:
    """The root if it holds .git, else its visible children that do, else the nearest ancestor that does."""
    at = Path(root)
    if (at / ".git").exists():
        return [str(at)]
    children = sorted(e.path for e in os.scandir(at) if e.is_dir() and not e.name.startswith(".") and (Path(e.path) / ".git").exists())
    return children or next(([str(p)] for p in at.resolve().parents if (p / ".git").exists()), [])


def glob_regex(pattern: str) -> str:
    """A regular expression for a glob: ** crosses folders, * and ? don't."""
    out = ""
    i = 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), i + 1
    return out


def ignore_rules(text: str) -> list[tuple[bool, str]]:
    """(keep, regular expression over relative paths) for the lines of an ignore file, in order; the last that fits decides."""
    rules = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        keep, line = line.startswith("!"), line.removeprefix("!")
        folder, line = line.endswith("/"), line.rstrip("/")
        anchored, line = "/" in line, line.lstrip("/")
        rules.append((keep, ("^" if anchored else "^(?:.*/)?") + glob_regex(line) + ("/.*$" if folder else "(?:/.*)?$")))
    return rules


def ignored(path: Column, rules: Sequence[tuple[bool, str]]) -> Column:
    out = F.lit(False)
    for keep, pattern in rules:
        out = F.when(path.rlike(pattern), F.lit(not keep)).otherwise(out)
    return out


def scan(spark: SparkSession, root: str, repo: str = "", extra_dirs: Sequence[str] = (), globs: Sequence[str] = (), languages: Sequence[str] = (), ignore_file: str = "", suffixes: Sequence[str] = tuple(paths.LANGUAGES)) -> DataFrame:
    """Files below root as FILE_SCHEMA: ignored folders, globs and rules fall out by path, before contents are decoded; texts that aren't UTF-8 are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(root)
    base = F.regexp_replace("path", r"^\w+:/*", "/")
    top = re.sub(r"^\w+:/*", "/", qualified(spark, root)).rstrip("/") + "/"
    rel = F.when(base.startswith(top), F.substring(base, len(top) + 1, 10_000)).otherwise(base)
    rows = found.withColumn("path", rel)
    rows = rows.where(~F.arrays_overlap(F.split(paths.parent(F.col("path")), "/"), F.array(*(F.lit(d) for d in (*IGNORED_DIRS, *extra_dirs)))))
    for g in globs:
        rows = rows.where(~F.col("path").rlike("^" + glob_regex(g) + "$"))
    if ignore_file:
        rows = rows.where(~ignored(F.col("path"), ignore_rules(ignore_file)))
    if languages:
        rows = rows.where(F.lower(paths.language(F.col("path"))).isin(*(x.lower() for x in languages)))
    rows = rows.where(F.is_valid_utf8(F.col("content").cast("string")))
    return rows.select(F.lit(repo).alias("repo"), "path", F.col("content").cast("string").alias("content"), F.col("modificationTime").alias("mtime"), F.col("length").alias("n_bytes"))


def doc_files(spark: SparkSession, root: str, repo: str = "") -> DataFrame:
    """Markdown files with a hash of their content."""
    return scan(spark, root, repo, suffixes=("md", "mdx")).withColumn("hash", F.hex(F.xxhash64("content")))


def stale_files(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """(path, reason) of files newer than the index, new, or gone. indexed: (path, mtime)."""
    both = files.select("path", F.col("mtime").alias("_now")).join(indexed.select("path", F.col("mtime").alias("_then")), "path", "full_outer")
    reason = F.when(F.col("_then").isNull(), "new").when(F.col("_now").isNull(), "gone").when(F.col("_now") > F.col("_then"), "changed")
    return both.select("path", reason.alias("reason")).where(F.col("reason").isNotNull())


def index_status(files: DataFrame, indexed: DataFrame, indexed_at: str | None = None) -> DataFrame:
    """One row: indexed_at (never without an index), newest (the latest time of a file), dirty, stale (the number of files the index lags
    behind) and a warning if there are any. files, indexed: (path, mtime)."""
    newest = files.agg(F.max("mtime").alias("newest"))
    stale = stale_files(files, indexed).agg(F.count("*").alias("stale"))
    warning = F.when(F.col("stale") > 0, F.concat(F.col("stale").cast("string"), F.lit(" files differ from the index")))
    return newest.join(F.broadcast(stale)).select(F.lit(indexed_at or "never").alias("indexed_at"), "newest", (F.col("stale") > 0).alias("dirty"), "stale", warning.alias("warning"))


def _git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=False, timeout=60).stdout


def git_status(spark: SparkSession, root: str) -> DataFrame:
    """(path, state) of modified and untracked files."""
    rows = [(line[3:].split(" -> ")[-1].strip('"'), "untracked" if line.startswith("??") else "modified") for line in _git(root, "status", "--porcelain").splitlines() if line]
    return spark.createDataFrame(rows, "path string, state string")


def git_commits(spark: SparkSession, root: str, repo: str = "") -> DataFrame:
    """(repo, path, sha, subject, ts) from one log."""
    rows, head = [], None
    for line in _git(root, "log", "--name-only", "--format=%x01%h%x02%ct%x02%s").splitlines():
        if line.startswith("\x01"):
            sha, at, subject = line[1:].split("\x02", 2)
            head = (sha, subject, int(at))
        elif line and head:
            rows.append((repo, line, *head))
    return spark.createDataFrame(rows, "repo string, path string, sha string, subject string, _at long").withColumn("ts", F.timestamp_seconds("_at")).drop("_at")


def git_diff(root: str, base: str = "HEAD") -> str:
    """A diff without context against a base, of a range `a...b`, or of HEAD if that is empty."""
    text = _git(root, "diff", "--unified=0", base if ".." in base or base == "HEAD" else f"{base}...HEAD")
    return text or _git(root, "diff", "--unified=0", "HEAD")


def git_show(root: str, sha: str) -> str:
    """The diff of a commit against its first parent, without context."""
    return _git(root, "show", "--first-parent", "--unified=0", "--format=", sha)


def git_blame(root: str, path: str, line: int = 1) -> str:
    """`<short sha> <subject>` of the commit that last changed a line."""
    head = _git(root, "blame", "--porcelain", "-L", f"{line},{line}", "--", path).split("\n")
    subject = next((x[8:] for x in head if x.startswith("summary ")), "")
    return f"{head[0][:7]} {subject}" if head[0] else ""


def churn(commits: DataFrame, days: int = 30, now: Column | None = None) -> DataFrame:
    """(path, churn): commits of the last days, up to the latest commit of all unless a time is given."""
    if now is None:
        latest = commits.agg(F.max("ts").alias("_now"))
        return commits.join(F.broadcast(latest)).where(F.col("ts") >= F.col("_now") - F.expr(f"INTERVAL {days} DAYS")).groupBy("path").agg(F.count("*").alias("churn"))
    return commits.where(F.col("ts") >= now - F.expr(f"INTERVAL {days} DAYS")).groupBy("path").agg(F.count("*").alias("churn"))


def bugfix_ratio(commits: DataFrame, last: int = 30) -> DataFrame:
    """(path, bugfix_ratio): the share of bug fixes among a file's last commits."""
    w = Window.partitionBy("path").orderBy(F.desc("ts"), F.desc("sha"))
    recent = commits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= last)
    return recent.groupBy("path").agg(F.avg(F.col("subject").rlike(BUGFIX).cast("double")).alias("bugfix_ratio"))


def log_of(commits: DataFrame, path: str, n: int = 3) -> DataFrame:
    return commits.where(F.col("path") == path).orderBy(F.desc("ts"), F.desc("sha")).limit(n)


def diff_hunks(diffs: DataFrame) -> DataFrame:
    """(diff_id, file, start, end) of unified diffs (diff_id, content): ranges of the new side; a file without any gives one row of nulls."""
    rows = lines(diffs)
    name = F.regexp_extract("text", r"^\+\+\+ (?:b/)?(.*?)\s*$", 1)
    rows = rows.withColumn("_file", F.when(F.col("text").startswith("+++ "), name))
    w = Window.partitionBy("diff_id").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("file", F.last("_file", ignorenulls=True).over(w)).where((F.col("file") != "/dev/null") & F.col("file").isNotNull())
    hunk = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    start = F.regexp_extract("text", hunk, 1).cast("int")
    count = F.coalesce(F.nullif(F.regexp_extract("text", hunk, 2), F.lit("")).cast("int"), F.lit(1))
    hunks = rows.where(F.col("text").rlike(hunk)).select("diff_id", "file", start.alias("start"), (start + count - 1).alias("end")).where(F.col("end") >= F.col("start"))
    files = rows.select("diff_id", "file").distinct()
    return files.join(hunks, ["diff_id", "file"], "left")


def requirements(manifests: DataFrame) -> DataFrame:
    """(repo, path, ecosystem, name, version) of dependencies in Cargo.toml, package.json and go.mod (designed here)."""
    rows = lines(manifests.withColumn("_base", paths.basename(F.col("path"))))
    # the table that a line of a manifest belongs to
    w = Window.partitionBy("repo", "path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.when(F.col("text").rlike(r"^\s*\["), F.col("text")).when(F.col("text").rlike(r'^\s*"[A-Za-z]+"\s*:\s*\{'), F.col("text")).when(F.col("text").rlike(r"^\s*\}"), F.lit("")).when(F.col("text").rlike(r"^require \("), F.lit("require"))
    rows = rows.withColumn("_table", F.last(head, ignorenulls=True).over(w))
    cargo = r'^\s*([A-Za-z0-9_-]+)\s*=\s*(?:"|\{.*version\s*=\s*")[\^~=]?([0-9][^"]*)"'
    npm, go = r'^\s*"([^"]+)"\s*:\s*"[\^~=v]?([0-9][^"]*)"', r"^\s*(?:require\s+)?([a-z][^\s]*\.[^\s]+)\s+v([0-9][^\s]*)"
    kinds = (("cargo", "Cargo.toml", cargo, F.col("_table").rlike("dependencies")), ("npm", "package.json", npm, F.col("_table").rlike("(?i)dependencies")), ("go", "go.mod", go, F.lit(True)))
    out = None
    for ecosystem, base, pattern, where in kinds:
        part = rows.where((F.col("_base") == base) & where & F.col("text").rlike(pattern)).select("repo", "path", F.lit(ecosystem).alias("ecosystem"), F.regexp_extract("text", pattern, 1).alias("name"), F.regexp_extract("text", pattern, 2).alias("version"))
        out = part if out is None else out.unionByName(part)
    return out


def freshness(required: DataFrame, latest: DataFrame) -> DataFrame:
    """required with the latest version (ecosystem, name, latest) and a status: current, minor, major or unknown."""
    major = lambda c: F.regexp_extract(c, r"^(\d+)", 1)
    status = F.when(F.col("latest").isNull(), "unknown").when(F.col("version") == F.col("latest"), "current").when(major("version") == major("latest"), "minor").otherwise("major")
    return required.join(latest, ["ecosystem", "name"], "left").withColumn("status", status)


def inside(root: str, path: str) -> str | None:
    """The absolute path if it stays inside the root."""
    top, at = Path(root).resolve(), (Path(root) / path).resolve()
    return str(at) if at == top or top in at.parents else None


def listing(files: DataFrame, folder: str = "") -> DataFrame:
    """(name, kind, n) of a folder's entries."""
    below = files.where(F.col("path").startswith(f"{folder.rstrip('/')}/")) if folder else files
    rest = F.split(F.substring(F.col("path"), len(folder.rstrip("/")) + 2 if folder else 1, 10_000), "/")
    return below.select(F.element_at(rest, 1).alias("name"), F.when(F.size(rest) > 1, "dir").otherwise("file").alias("kind")).groupBy("name", "kind").agg(F.count("*").alias("n"))
