"""File changes: debouncing, upserts, incremental maintenance of the index tables.

Changes are (path, op, ts, content): op is upsert or delete.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from quarry.sources.checkpoints import shared_dir

CHANGES = "repo string, path string, op string, ts timestamp, content string"


def latest(changes: DataFrame) -> DataFrame:
    """The last change of each path; of equal times the last by op and content."""
    row = F.struct(*(c for c in changes.columns if c not in ("repo", "path")))
    return changes.groupBy("repo", "path").agg(F.max_by(row, F.struct("ts", "op", "content")).alias("_r")).select("repo", "path", "_r.*")


def debounced(changes: DataFrame, quiet: str = "100 milliseconds") -> DataFrame:
    """The last change of every burst of a path: one that none follows within the quiet time; equal times go by op and content."""
    w = Window.partitionBy("path").orderBy("ts", "op", "content")
    after = F.lead("ts").over(w)
    return changes.withColumn("_next", after).where(F.col("_next").isNull() | (F.col("_next") - F.col("ts") > F.expr(f"INTERVAL {quiet}"))).drop("_next")


def debounced_stream(changes: DataFrame, quiet: str, late: str = "1 hour") -> DataFrame:
    """debounced over a stream: the last change of every burst, out when the watermark has passed its quiet time. A gap of just that time ends a burst
    or not as session windows have it; state is the open bursts alone."""
    last = F.max_by(F.struct("repo", "op", "ts", "content"), F.struct("ts", "op", "content")).alias("_r")
    return changes.withWatermark("ts", late).groupBy("path", F.session_window("ts", quiet)).agg(last).select("path", "_r.*")


def open_bursts(changes: DataFrame, quiet: str, late: str = "1 hour") -> DataFrame:
    """The last changes whose bursts a stream that has read all changes still holds open."""
    passed = changes.agg((F.max("ts") - F.expr(f"INTERVAL {late}")).alias("_passed"))
    return debounced(changes, quiet).join(F.broadcast(passed)).where(F.col("ts") + F.expr(f"INTERVAL {quiet}") > F.col("_passed")).drop("_passed")


def applied(files: DataFrame, changes: DataFrame) -> DataFrame:
    """files (repo, path, content) after the changes."""
    last = latest(changes)
    kept = files.join(last.select("repo", "path"), ["repo", "path"], "left_anti")
    new = last.where(F.col("op") != "delete").select("repo", "path", "content")
    return kept.select("repo", "path", "content").unionByName(new)


def refreshed(table: DataFrame, changes: DataFrame, extract: Callable[[DataFrame], DataFrame], key: str = "path") -> DataFrame:
    """A table derived file by file, with only the changed files' rows made anew."""
    last = latest(changes)
    kept = table.join(last.select("repo", F.col("path").alias(key)), ["repo", key], "left_anti")
    return kept.unionByName(extract(last.where(F.col("op") != "delete").select("repo", "path", "content")))


def session_counts(changes: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """(path, start, end, n) of bursts in a stream, with a watermark that bounds the state."""
    return changes.withWatermark("ts", late).groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("path", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def window_counts(events: DataFrame, key: str, width: str, late: str = "1 hour") -> DataFrame:
    """(key, start, n) in tumbling windows of a stream or table."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(key, F.window("ts", width).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's file as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", 1).parquet(sf_dir)


#: Rows that a file of a batch holds about, so that many tasks write and read a large batch.
FILE_ROWS = 100_000


def in_batches(rows: DataFrame, at: str | Column, parts: int) -> DataFrame:
    """rows as a stream of `parts` batches by a time or number: they are written to a new folder one after the other, so that the stream takes them in
    this order. All batches have the same number of files, as the stream takes so many at once: what a batch lacks are empty ones."""
    spark = rows.sparkSession
    folder = f"{shared_dir(spark)}/batches-{uuid.uuid4().hex}"
    at = F.unix_micros(at) if isinstance(at, str) else at
    low, high, known = rows.agg(F.min(at), F.max(at), F.count(at)).first()
    if low is None:
        rows.write.parquet(folder)
        return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    edges = [low + (high - low) * k // parts for k in range(parts)]
    inside = [(at >= edges[i]) & ((at < edges[i + 1]) if i < parts - 1 else (at <= high)) for i in range(parts)]
    most = known if known <= FILE_ROWS else max(rows.agg(*(F.count_if(x) for x in inside)).first())
    files = -(-most // FILE_ROWS)
    for i, x in enumerate(inside):
        batch = rows.where(x)
        (batch.repartition(files) if files > 1 else batch.coalesce(1)).write.mode("append").option("maxRecordsPerFile", 0).parquet(folder)
        # tasks without rows write no file
        for _ in range(files * (i + 1) - len(spark.read.schema(rows.schema).parquet(folder).inputFiles()) if files > 1 else 0):
            spark.createDataFrame([], rows.schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


def ran(stream: DataFrame, name: str, mode: str = "append", keep: Callable[[DataFrame, int], None] | None = None, conf: Mapping[str, str] | None = None) -> str:
    """Runs a stream over all that is there, into Parquet in the shared folder or a function of each batch; returns the folder. conf holds for this stream."""
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in conf or {}}
    for k, v in (conf or {}).items():
        spark.conf.set(k, v)
    try:
        writer = stream.writeStream.trigger(availableNow=True).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint")
        query: StreamingQuery = writer.foreachBatch(keep).start() if keep else writer.format("parquet").start(f"{folder}/out")
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    if query.exception():
        raise RuntimeError(str(query.exception()))
    return f"{folder}/out"
