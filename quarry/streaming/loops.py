"""Loop sessions: iterations, reindexing, signals; usage counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.sources.checkpoints import cut

#: Rows up to which a side of a join is broadcast.
FEW = 100_000
EVERY_N, STALE_WARN, MOST_ITERATIONS = 3, 5, 50


def should_reindex(policy: str, iteration: Column, stale: Column, every_n: int = EVERY_N) -> Column:
    if policy == "if_stale":
        return stale > 0
    if policy == "every_n":
        return iteration % every_n == 0 if every_n > 0 else F.lit(False)
    return F.lit(policy == "always")


def signals(ticks: DataFrame, policy: str = "if_stale", every_n: int = EVERY_N, warn: int = STALE_WARN, most: int = MOST_ITERATIONS) -> DataFrame:
    """(session, iteration, stale_count, reindexed, recommended, pause, stop) of ticks (session, at, stale_count); a reindexed tick has nothing stale left."""
    w = Window.partitionBy("session").orderBy("at")
    t = ticks.withColumn("iteration", F.row_number().over(w)).withColumn("reindexed", should_reindex(policy, F.col("iteration"), F.col("stale_count"), every_n))
    left = F.when(F.col("reindexed"), 0).otherwise(F.col("stale_count"))
    recommended = (F.col("stale_count") > 0) | F.lit(policy in ("always", "every_n"))
    return t.select("session", "iteration", left.alias("stale_count"), "reindexed", recommended.alias("recommended"), ((left >= warn) & ~F.col("reindexed")).alias("pause"), (F.col("iteration") >= most).alias("stop"))


def touched(records: DataFrame) -> DataFrame:
    """(session, iterations, files): what a session touched."""
    return records.groupBy("session").agg(F.count("*").alias("iterations"), F.array_sort(F.collect_set("path")).alias("files"))


def usage(events: DataFrame) -> DataFrame:
    """(tool, key, n); the same over a stream."""
    return events.groupBy("tool", "key").agg(F.count("*").alias("n"))


def _few(rows: DataFrame) -> DataFrame:
    """rows, made once; broadcast where there are few."""
    rows = cut(rows)
    return F.broadcast(rows) if rows.count() <= FEW else rows


def rings(edges: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(file, near): what a file depends on in one or two steps, without itself; of (file): of these files alone, whose rings are made once and kept.

    Edges that don't leave these files or what is next to them go before anything is dealt out."""
    one = edges.select(F.col("src").alias("file"), F.col("dst").alias("near"))
    if of is not None:
        one = cut(one.join(_few(of.select("file").distinct()), "file", "left_semi").distinct())
        edges = edges.join(_few(one.select(F.col("near").alias("src")).distinct()), "src", "left_semi")
    else:
        one = one.distinct()
    two = one.select("file", F.col("near").alias("src")).join(edges, "src").select("file", F.col("dst").alias("near"))
    out = one.unionByName(two).where("file <> near").distinct()
    return out if of is None else _few(out)


def prefetched(ticks: DataFrame, ring: DataFrame) -> DataFrame:
    """(session, file, at) of ticks (session, at, file), of a table or a stream: the ring of the tick's active file, each file once a session, at the
    first tick that needs it; so a tick's prefetch is what was not sent before. State is one row for each session and file."""
    near = ticks.join(ring, "file").select("session", "at", F.col("near").alias("file"))
    return near.groupBy("session", "file").agg(F.min("at").alias("at"))


def resolved(root: str, file: Column) -> Column:
    """A file's path below root, without leading ./; as it is if it lies elsewhere."""
    top = root.rstrip("/") + "/"
    below = F.when(file.startswith(top), F.substring(file, len(top) + 1, 2**31 - 1)).otherwise(file)
    return F.regexp_replace(below, r"^(\./)+", "")


def _open(events: DataFrame) -> DataFrame:
    """The events of sessions from their first begin to their first end after it, with the session's times; equal times go by seq."""
    at = F.struct("at", "seq")
    begun = events.where("op = 'begin'").groupBy("session").agg(F.min(at).alias("begun"))
    later = events.join(begun, "session").where(at >= F.col("begun"))
    ended = later.where("op = 'end'").groupBy("session").agg(F.min(at).alias("ended"))
    return later.join(ended, "session", "left")


def sessions(events: DataFrame) -> DataFrame:
    """(session, goal, iterations, touched, closed, rejected) of events (session, at, seq, op, goal, files): op is begin, tick, record or end.

    A session begins with its first begin, whose goal it has; what comes before isn't its own and a second begin changes nothing. Its
    first end closes it; later events but begins are rejected. touched is the number of different files recorded while it was open.
    """
    inside = _open(events)
    open_ = F.col("ended").isNull() | (F.struct("at", "seq") < F.col("ended"))
    late = ~open_ & (F.struct("at", "seq") > F.col("ended")) & (F.col("op") != "begin")
    numbers = inside.groupBy("session").agg(
        F.min_by(F.when(F.col("op") == "begin", F.col("goal")), F.struct((F.col("op") != "begin").alias("no"), "at", "seq")).alias("goal"),
        F.count_if((F.col("op") == "tick") & open_).alias("iterations"),
        F.max(F.col("ended").isNotNull()).alias("closed"),
        F.count_if(late).alias("rejected"),
    )
    touched = session_files(events).where("touched").groupBy("session").agg(F.count("*").alias("touched"))
    return numbers.join(touched, "session", "left").withColumn("touched", F.coalesce("touched", F.lit(0)))


def session_files(events: DataFrame, root: str = "") -> DataFrame:
    """(session, file, touched, primary): the active files of sessions, those of the begin and those recorded while it was open, each once.

    touched: it was recorded. primary: the first active file, of one event the first of its list.
    """
    open_ = F.col("ended").isNull() | (F.struct("at", "seq") < F.col("ended"))
    first = (F.col("op") == "begin") & (F.struct("at", "seq") == F.col("begun"))
    each = _open(events).where(first | ((F.col("op") == "record") & open_)).select("session", "op", "at", "seq", F.posexplode("files").alias("place", "file"))
    each = each.where("file IS NOT NULL").withColumn("file", resolved(root, F.col("file")) if root else F.col("file"))
    active = each.groupBy("session", "file").agg(F.max(F.col("op") == "record").alias("touched"), F.min(F.struct("at", "seq", "place")).alias("since"))
    heads = active.groupBy("session").agg(F.min("since").alias("head"))
    return active.join(heads, "session").select("session", "file", "touched", (F.col("since") == F.col("head")).alias("primary"))
