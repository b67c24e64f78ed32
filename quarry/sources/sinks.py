"""Sinks: index tables, report, graph drawing."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import paths
from quarry.operators import graph
from quarry.sources.checkpoints import exists, move, remove

NODES = 80


def write_table(df: DataFrame, folder: str, name: str, by: str | None = None) -> None:
    """Replaces a table; with `by` partitioned, so that partitions that are gone go."""
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(f"{folder}/{name}")


def write_json(df: DataFrame, folder: str, name: str) -> None:
    df.write.mode("overwrite").json(f"{folder}/{name}.json")


def mermaid_edges(edges: DataFrame, package: str | None = None, most: int = NODES) -> DataFrame:
    """(src, dst) between the first nodes in order."""
    all_nodes = graph.nodes(edges)
    kept = (all_nodes.where(paths.package(F.col("node")) == package) if package else all_nodes).orderBy("node").limit(most)
    kept = F.broadcast(kept)
    return edges.join(kept.withColumnRenamed("node", "src"), "src", "left_semi").join(kept.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst").distinct()


def mermaid(edges: DataFrame, package: str | None = None, most: int = NODES) -> str:
    """The drawing of at most `most` nodes."""
    all_nodes = graph.nodes(edges)
    shown = [r["node"] for r in (all_nodes.where(paths.package(F.col("node")) == package) if package else all_nodes).orderBy("node").limit(most).collect()]
    name = {n: f"n{i}" for i, n in enumerate(shown)}
    rows = mermaid_edges(edges, package, most).orderBy("src", "dst").collect()
    out = ["graph TD", *(f'  {i}["{n}"]' for n, i in name.items()), *(f"  {name[r['src']]} --> {name[r['dst']]}" for r in rows)]
    total = all_nodes.count()
    if total > most and not package:
        out.append(f"%% {most} of {total} nodes are shown.")
    return "\n".join(out) + "\n"


def counts(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(metric, value)"""
    rows = (("packages", symbols.select("package").distinct()), ("files", files), ("symbols", symbols), ("nodes", graph.nodes(edges)), ("edges", edges))
    out = None
    for name, df in rows:
        part = df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
        out = part if out is None else out.unionByName(part)
    return out


def report(name: str, files: DataFrame, symbols: DataFrame, edges: DataFrame, summaries: DataFrame, purposes: DataFrame, hot: DataFrame) -> str:
    """A Markdown report from five small results."""
    top = graph.hotspots(edges, 10).collect()
    numbers = counts(files, symbols, edges).collect()
    packs = summaries.join(purposes.select("package", "purpose"), "package", "left").orderBy(F.desc("score"), "package").collect()
    out = [f"# Report: {name}", "", "## Summary", "", "| Metric | Value |", "|---|---|", *(f"| {r['metric']} | {r['value']} |" for r in numbers), ""]
    out += ["## Hotspots", "", "| Rank | File | Dependents |", "|---|---|---|", *(f"| {i} | `{r['node']}` | {r['dependents']} |" for i, r in enumerate(top, 1)), ""]
    out += ["## Packages", "", "| Package | Files | Score | Purpose |", "|---|---|---|---|", *(f"| {r['package']} | {r['files']} | {r['score']:.2f} | {r['purpose'] or ''} |" for r in packs), ""]
    out += ["## Hot symbols", "", *(f"- `{r['name']}`" for r in hot.collect()), "", "## Questions", "", *(f"- What breaks if `{r['node']}` changes? ({r['dependents']} dependents)" for r in top[:5] if r["dependents"]), ""]
    return "\n".join(out)


#: The log of loop sessions has this many folders, whatever the number of sessions.
BUCKETS = 64


def _bucket(session: str) -> int:
    return zlib.crc32(session.encode()) % BUCKETS


def write_iterations(ticks: DataFrame, folder: str) -> None:
    """Appends iterations (session, iteration, ...) to the log of loop sessions, which is kept by buckets of sessions, in files in their order."""
    bucket = F.pmod(F.crc32(F.col("session").cast("string").cast("binary")), F.lit(BUCKETS)).cast("int")
    ticks.withColumn("session_bucket", bucket).sortWithinPartitions("session_bucket", "session").write.mode("append").partitionBy("session_bucket").parquet(folder)


def read_session(spark: SparkSession, folder: str, session: str) -> DataFrame:
    """The iterations of one session; only its bucket of the log is read, and there the parts of files that may hold it."""
    rows = spark.read.parquet(folder).where(F.col("session_bucket") == _bucket(session)).drop("session_bucket")
    return rows.where(F.col("session") == F.lit(session).cast(rows.schema["session"].dataType))


def delete_session(spark: SparkSession, folder: str, session: str) -> None:
    """Writes the session's bucket anew without it, then puts that in the place of the old one."""
    name, beside = f"session_bucket={_bucket(session)}", f"{folder}/_without-{uuid.uuid4().hex}"
    if not exists(spark, f"{folder}/{name}"):
        return
    rows = spark.read.parquet(f"{folder}/{name}")
    rows.where(~F.col("session").eqNullSafe(F.lit(session).cast(rows.schema["session"].dataType))).write.parquet(f"{beside}/new")
    move(spark, f"{folder}/{name}", f"{beside}/old")
    move(spark, f"{beside}/new", f"{folder}/{name}")
    remove(spark, beside)
