"""Path claims with a lease, releases, waits, sessions, deadlocks.

Events are (ts, op, path, block_key, note) with op claim, release or done (of a whole
session). A claim is ok if the path is free, expired or already the claimant's, else
held; a release is ok if the releaser holds the path. State by path is one lease, so
the fold streams over events sorted by path and time, whatever their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators.graph import cycle_members
from quarry.sources.checkpoints import cut, remove
from quarry.sources.package import send_package

TTL = 600
RESULT = "path string, ts timestamp, op string, block_key string, result string, held_by string"


@dataclass
class Lease:
    holder: str | None = None
    expires: float = 0.0

    def step(self, at: float, op: str, who: str, ttl: float = TTL) -> tuple[str, str | None]:
        """Applies one event: its result and the holder afterwards."""
        if self.holder is not None and self.expires <= at:
            self.holder = None
        if op == "claim":
            if self.holder in (None, who):
                self.holder, self.expires = who, at + max(1.0, ttl)
                return "ok", who
            return "held", self.holder
        if self.holder == who:
            self.holder = None
            return "ok", None
        if op in ("done", "end"):
            return "none", self.holder
        return ("held" if self.holder else "none"), self.holder


def normalised(path: str, allowed: tuple[str, ...] = ()) -> str | None:
    """A relative path without `.` parts, or null if it climbs out or isn't below an allowed folder."""
    parts = [p for p in path.replace("\\", "/").split("/") if p not in ("", ".")]
    if ".." in parts or not parts:
        return None
    out = "/".join(parts)
    return out if not allowed or any(out == a or out.startswith(f"{a.rstrip('/')}/") for a in allowed) else None


def by_path(events: DataFrame) -> DataFrame:
    """Events with each session's end dealt to all paths that it ever claimed."""
    claimed = events.where("op = 'claim'").select("path", "block_key").distinct()
    ends = events.where("op = 'done'").drop("path").join(claimed, "block_key")
    return events.where("op <> 'done'").unionByName(ends.select(*events.columns))


ORDER = ["ts", "op", "block_key"]


def folded(events: DataFrame, ttl: float = TTL, leases: DataFrame | None = None) -> DataFrame:
    """RESULT and expires (of the lease afterwards) for every event, in order of time; of equal times by op, then block.

    leases (path, holder, expires) are those that run before the first event. The events of one path are
    one task's by nature, as each result hangs on the one before; paths are dealt to tasks.
    """
    names = [*(c.split()[0] for c in RESULT.split(", ")), "expires"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, lease = None, Lease()
        for batch in batches:
            out: list[tuple] = []
            for at, ts, op, who, until in zip(*(batch[c].array for c in ("path", "ts", "op", "block_key", "expires")), strict=True):
                if at != path:
                    path, lease = at, Lease()
                if op == "lease":
                    lease = Lease(who, until)
                else:
                    out.append((at, ts, op, who, *lease.step(ts.timestamp(), op, who, ttl), lease.expires if lease.holder else None))
            yield pd.DataFrame(out, columns=names)

    send_package(events.sparkSession)
    rows = by_path(events).select("path", F.lit(1).alias("after"), *ORDER, F.lit(None).cast("double").alias("expires"))
    if leases is not None:
        rows = rows.unionByName(leases.select("path", F.lit(0).alias("after"), F.lit(None).cast("timestamp").alias("ts"), F.lit("lease").alias("op"), F.col("holder").alias("block_key"), "expires"))
    return rows.repartition("path").sortWithinPartitions("path", "after", *ORDER).mapInPandas(run, f"{RESULT}, expires double")


def maintain(stream: DataFrame, folder: str, ttl: float = TTL) -> Callable[[DataFrame, int], None]:
    """A batch function that folds a stream of events, ends of sessions included, in the order of its batches.

    Version n + 1 of the leases and of the paths that each running session has claimed is version n with the batch
    folded; results of the batch are in folder/results-n. A repeated batch writes the same again; versions before n are removed.
    """
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        before = f"{folder}/v{number}"
        leases = spark.read.parquet(f"{before}/leases") if number else spark.createDataFrame([], "path string, holder string, expires double")
        claimed = spark.read.parquet(f"{before}/claimed") if number else spark.createDataFrame([], "path string, block_key string")
        rows = cut(batch.select("op", "path", "ts", "block_key"))
        claims = cut(claimed.unionByName(rows.where("op = 'claim'").select("path", "block_key")).distinct())
        # an end reaches all that its session has claimed, in this batch or before
        ends = rows.where("op = 'done'").drop("path").join(claims, "block_key").select(*rows.columns)
        results = cut(folded(rows.where("op <> 'done'").unionByName(ends.withColumn("op", F.lit("end"))), ttl, leases))
        results.withColumn("op", F.when(F.col("op") == "end", "done").otherwise(F.col("op"))).write.mode("overwrite").parquet(f"{folder}/results-{number}")
        last = results.groupBy("path").agg(F.max_by(F.struct(F.col("held_by").alias("holder"), "expires"), F.struct(*ORDER)).alias("lease"))
        kept = leases.join(last, "path", "left_anti").unionByName(last.where("lease.holder IS NOT NULL").select("path", "lease.*"))
        kept.write.mode("overwrite").parquet(f"{folder}/v{number + 1}/leases")
        ended = rows.where("op = 'done'").select("block_key").distinct()
        claims.join(ended, "block_key", "left_anti").select("path", "block_key").write.mode("overwrite").parquet(f"{folder}/v{number + 1}/claimed")
        if number > 1:
            remove(spark, f"{folder}/v{number - 1}")

    return keep


def holders(results: DataFrame, now: str, ttl: float = TTL) -> DataFrame:
    """(path, block_key, expires) of the leases that run at a time, from fold results."""
    w = Window.partitionBy("path").orderBy(F.desc("ts"), F.desc("op"), F.desc("block_key"))
    changed = results.where("result = 'ok'").where(F.col("ts") <= F.lit(now).cast("timestamp")).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    expires = F.col("ts") + F.make_dt_interval(secs=F.lit(float(ttl)))
    return changed.where((F.col("op") == "claim") & (expires > F.lit(now).cast("timestamp"))).select("path", "block_key", expires.alias("expires"))


def awaited(waits: DataFrame, held: DataFrame, now: str) -> DataFrame:
    """(waiter, path, status) at a time of waits (waiter, path, since, seconds): ready if nobody else's lease (path, block_key) runs,
    deadlock if the waiter waits for itself through the holders, timeout if it has waited its seconds, else waiting."""
    cycle = deadlocked(waits, held).select(F.col("node").alias("waiter"), F.lit(True).alias("_cycle"))
    late = F.lit(now).cast("timestamp") >= F.col("since") + F.make_dt_interval(secs=F.col("seconds").cast("double"))
    status = F.when(F.col("block_key").isNull(), "ready").when(F.col("_cycle"), "deadlock").when(late, "timeout").otherwise("waiting")
    return waits.join(held.select("path", "block_key"), "path", "left").join(cycle, "waiter", "left").select("waiter", "path", status.alias("status"))


def deadlocked(waits: DataFrame, held: DataFrame) -> DataFrame:
    """(node): waiters (waiter, path) that wait for themselves through the holders (path, block_key)."""
    return cycle_members(waits.join(held, "path").select(F.col("waiter").alias("src"), F.col("block_key").alias("dst")))


def sessions(events: DataFrame) -> DataFrame:
    """(block_key, status, started, ended) from (ts, block_key, status): the first end (done, failed, timed_out) counts, of equal times
    the first by name; later ones are rejected."""
    w = Window.partitionBy("block_key").orderBy("ts", "status")
    ends = events.where(F.col("status") != "running").withColumn("_n", F.row_number().over(w)).where("_n = 1").select("block_key", F.col("status").alias("_end"), F.col("ts").alias("ended"))
    starts = events.groupBy("block_key").agg(F.min("ts").alias("started"))
    return starts.join(ends, "block_key", "left").select("block_key", F.coalesce("_end", F.lit("running")).alias("status"), "started", "ended")


def outcome_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("status").agg(F.count("*").alias("n"))
