"""State operators, in batch and as streams, over the driver's tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import graph
from quarry.plans.tables import SUPPLY_SQL, supply_edges, table
from quarry.sources import blame, sinks
from quarry.sources.checkpoints import written
from quarry.streaming import changes, leases, locks, loops, staleness, versions


def _changes(df: DataFrame) -> DataFrame:
    """Events as changes of one file a user; errors delete it."""
    return df.select(F.lit("r").alias("repo"), F.col("user_id").cast("string").alias("path"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("string").alias("content"))


def _locks(df: DataFrame) -> DataFrame:
    """Clicks claim the path that props names for the user, purchases release it."""
    kinds = df.where(F.col("event_type").isin("click", "purchase"))
    return kinds.select(F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "click", "claim").otherwise("release").alias("op"), F.get_json_object("props", "$.k").alias("path"), F.col("user_id").cast("string").alias("block_key"))


def debounced_changes(spark, sf_dir):
    return changes.debounced(_changes(table(spark, sf_dir, "events")), "6 hours").select("path", "content")


def applied_changes(spark, sf_dir):
    files = table(spark, sf_dir, "customer").select(F.lit("r").alias("repo"), F.col("c_custkey").cast("string").alias("path"), F.col("c_name").alias("content"))
    return changes.applied(files, _changes(table(spark, sf_dir, "events"))).select("path", "content")


def window_counts(spark, sf_dir):
    return changes.window_counts(table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts")), "event_type", "1 day").select("event_type", F.col("start").cast("string").alias("start"), "n")


def stream_window_counts(spark, sf_dir):
    """The same counts from a stream; every window is out, as the whole table is one batch in update mode."""
    events = changes.stream_of(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    seen: list[str] = []
    folder = f"{changes.shared_dir(spark)}/windows"

    def keep(batch: DataFrame, number: int) -> None:
        out = f"{folder}-{batch.sparkSession.sparkContext.applicationId}-{id(seen)}-{number}"
        batch.write.mode("overwrite").parquet(out)
        seen.append(out)

    changes.ran(changes.window_counts(events, "event_type", "1 day"), "windows", "update", keep)
    rows = spark.read.parquet(*dict.fromkeys(seen))
    return rows.groupBy("event_type", "start").agg(F.max("n").alias("n")).select("event_type", F.col("start").cast("string").alias("start"), "n")


def stream_session_counts(spark, sf_dir):
    """Bursts of a user's events from a stream, those that are open at its end included."""
    stream = _changes(changes.stream_of(spark, sf_dir, "events"))
    out = f"{changes.shared_dir(spark)}/sessions-{uuid.uuid4().hex}"
    changes.ran(changes.session_counts(stream, "6 hours"), "sessions", "complete", lambda batch, number: batch.write.mode("overwrite").parquet(out))
    return spark.read.parquet(out).select("path", F.col("start").cast("string").alias("start"), "n")


def stream_upserts(spark, sf_dir):
    """A table of files kept from the stream of changes, in four batches, by deltas that are merged when read."""
    stream = changes.in_batches(_changes(table(spark, sf_dir, "events")), "ts", 4)
    kept = versions.Versions(spark, f"{changes.shared_dir(spark)}/files-{uuid.uuid4().hex}")
    return versions.kept(stream, kept, "upserts", "files").select("path", "content")


def lock_fold(spark, sf_dir):
    return locks.folded(_locks(table(spark, sf_dir, "events"))).select("path", F.col("ts").cast("string").alias("ts"), "op", "block_key", "result", "held_by")


def stream_locks(spark, sf_dir):
    stream = _locks(changes.stream_of(spark, sf_dir, "events"))
    folder = f"{changes.shared_dir(spark)}/leases-{uuid.uuid4().hex}"
    changes.ran(stream, "locks", "append", locks.maintain(stream, folder))
    return spark.read.parquet(f"{folder}/results-*").select("path", F.col("ts").cast("string").alias("ts"), "op", "block_key", "result", "held_by")


LEASE_TTL, WAIT = 6 * 3600, 4 * 3600


def _lease_events(df: DataFrame) -> DataFrame:
    """Clicks claim the path that props names for the user, purchases release it, signups wait for it, errors end the user's session; in milliseconds, as watermarks are."""
    op = F.create_map(*(F.lit(x) for pair in (("click", "claim"), ("purchase", "release"), ("signup", "wait"), ("error", "done")) for x in pair))[F.col("event_type")]
    path = F.when(op != "done", F.get_json_object("props", "$.k"))
    return df.where("event_type <> 'view'").select(F.date_trunc("millisecond", F.col("ts").cast("timestamp")).alias("ts"), op.alias("op"), path.alias("path"), F.col("user_id").cast("string").alias("block_key"), F.when(op == "wait", float(WAIT)).alias("seconds"))


def lease_timeline(spark, sf_dir):
    found = leases.timeline(_lease_events(table(spark, sf_dir, "events")), LEASE_TTL)
    return found.withColumn("ts", F.col("ts").cast("string"))


def stream_lease_timeline(spark, sf_dir):
    """The same from a stream of six batches: expiries, waits that become ready and timeouts come from timers."""
    stream = changes.in_batches(_lease_events(table(spark, sf_dir, "events")), "ts", 6)
    out = changes.ran(leases.streamed(stream, LEASE_TTL), "lease-timeline", conf=leases.ROCKSDB)
    return spark.read.schema(leases.ROWS).parquet(out).withColumn("ts", F.col("ts").cast("string"))


def lock_awaits(spark, sf_dir):
    """Each user waits on the path of the last signup for five days; the holders are those of the last click on a path."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.get_json_object("props", "$.k").alias("path"))
    held = e.where("event_type = 'click' AND event_id % 3 > 0").groupBy("path").agg(F.max_by("user_id", "event_id").cast("string").alias("block_key"))
    last = e.where("event_type = 'signup'").groupBy("user_id").agg(F.max_by(F.struct("path", "ts"), "event_id").alias("w"))
    waits = last.select(F.col("user_id").cast("string").alias("waiter"), "w.path", F.col("w.ts").alias("since"), F.lit(5 * 86400).alias("seconds"))
    now = e.agg(F.max("ts").cast("string").alias("now")).first()["now"]
    return locks.awaited(waits, held, now)


def wait_cycle(spark, sf_dir):
    """A shortest cycle of waits."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.get_json_object("props", "$.k").alias("path"))
    held = e.where("event_type = 'click'").groupBy("path").agg(F.max_by("user_id", "event_id").cast("string").alias("dst"))
    waits = e.where("event_type = 'signup'").select(F.col("user_id").cast("string").alias("src"), "path").distinct()
    return graph.cycle_path(waits.join(held, "path").select("src", "dst").distinct())


def deadlock_cycles(spark, sf_dir):
    """A user waits for the holder of the path of a later view: the user of the last click on it."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.get_json_object("props", "$.k").alias("path"))
    held = e.where("event_type = 'click'").groupBy("path").agg(F.max_by("user_id", "event_id").cast("string").alias("block_key"))
    waits = e.where("event_type = 'signup'").groupBy("user_id").agg(F.max_by("path", "event_id").alias("path")).select(F.col("user_id").cast("string").alias("waiter"), "path")
    return locks.deadlocked(waits, held)


def session_outcomes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("block_key"), F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "timed_out").otherwise("running").alias("status"))
    return locks.outcome_counts(locks.sessions(e))


def loop_signals(spark, sf_dir):
    ticks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("at"), (F.length("text") % 9).alias("stale_count"))
    return loops.signals(ticks, "every_n", 3, 5, 4)


def loop_touched(spark, sf_dir):
    return loops.touched(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("role").alias("path"))).select("session", "iterations", F.array_join("files", ",").alias("files"))


def loop_iterations(spark, sf_dir):
    """Iterations kept one by one as artifacts of their session, and read back."""
    ticks = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("iteration"), F.col("role").alias("goal"))
    folder = f"{changes.shared_dir(spark)}/loops-{uuid.uuid4().hex}"
    sinks.write_iterations(ticks, folder)
    return sinks.read_session(spark, folder, "7").select("iteration", "goal")


def usage_counters(spark, sf_dir):
    return loops.usage(table(spark, sf_dir, "events").select(F.col("event_type").alias("tool"), F.get_json_object("props", "$.k").alias("key")))


def stream_debounced(spark, sf_dir):
    """The last changes of bursts, in five batches: those that the watermark has passed from the stream, the open rest named."""
    rows = _changes(table(spark, sf_dir, "events")).withColumn("ts", F.date_trunc("millisecond", "ts"))
    out = changes.ran(changes.debounced_stream(changes.in_batches(rows, "ts", 5), "6 hours"), "debounced")
    passed = spark.read.schema("path string, repo string, op string, ts timestamp, content string").parquet(out)
    return passed.select("path", "content", F.lit(False).alias("open")).unionByName(changes.open_bursts(rows, "6 hours").select("path", "content", F.lit(True).alias("open")))


def _sections(spark, sf_dir):
    """Each user's document links to the next user's code by path, and to a symbol that the seventh next defines."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("u"), F.col("event_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    name = lambda top, u, end: F.concat(F.lit(top), u.cast("string"), F.lit(end))
    changed = e.where("event_type IN ('click', 'view')").select(F.when(F.col("event_type") == "click", name("src/u", F.col("u"), ".py")).otherwise(name("docs/u", F.col("u"), ".md")).alias("path"), "ts")
    users = e.select("u").distinct()
    targets = F.array(name("src/u", F.col("u") + 1, ".py"), name("::s", F.col("u") + 7, ""))
    linked = users.select(F.col("u").cast("string").alias("id"), name("docs/u", F.col("u"), ".md").alias("file"), F.explode(targets).alias("target"), F.lit(False).alias("broken"))
    return linked, users.select(name("s", F.col("u"), "").alias("name"), name("src/u", F.col("u"), ".py").alias("path")), changed


def section_staleness(spark, sf_dir):
    linked, symbols, changed = _sections(spark, sf_dir)
    return staleness.flags(linked, staleness.folded(changed, staleness.links(linked, symbols)))


def stream_staleness(spark, sf_dir):
    """The same from a stream of four batches that don't come in order of time."""
    linked, symbols, changed = _sections(spark, sf_dir)
    stream = changes.in_batches(changed, F.pmod(F.xxhash64("path", "ts"), F.lit(1 << 20)), 4)
    folder = f"{changes.shared_dir(spark)}/flags-{uuid.uuid4().hex}"
    # sections and links are made of all events: once, not by each batch
    linked = written(linked)
    static = written(staleness.links(linked, symbols))
    changes.ran(staleness.folded(stream, static), "staleness", "update", staleness.keeper(folder))
    return staleness.flags(linked, spark.read.parquet(f"{folder}/flags-*"))


def _ticks(df: DataFrame) -> DataFrame:
    """Turns as ticks of a conversation's loop; each works on a part."""
    return df.select(F.col("conv_id").alias("session"), F.col("turn").alias("at"), F.concat(F.lit("p"), ((F.col("conv_id") * 7 + F.col("turn")) % 200 + 1).cast("string")).alias("file"))


def loop_prefetch(spark, sf_dir):
    ticks = _ticks(table(spark, sf_dir, "conversations"))
    return loops.prefetched(ticks, loops.rings(supply_edges(spark, sf_dir), ticks))


def stream_prefetch(spark, sf_dir):
    """The same from a stream of three batches of turns."""
    ticks = _ticks(table(spark, sf_dir, "conversations"))
    stream = changes.in_batches(ticks, F.col("at"), 3)
    folder = f"{changes.shared_dir(spark)}/prefetch-{uuid.uuid4().hex}"
    changes.ran(loops.prefetched(stream, loops.rings(supply_edges(spark, sf_dir), ticks)), "prefetch", "update", staleness.keeper(folder))
    return spark.read.parquet(f"{folder}/flags-*").groupBy("session", "file").agg(F.min("at").alias("at"))


def _hunks(spark, sf_dir):
    """Histories of a file for each document: lines by the text's length, then four commits, each with a new first line and another line rewritten; the third removes the last."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("path"), "doc_id", (F.coalesce(F.length("text"), F.lit(0)) % 50 + 2).alias("n"))
    h = lambda seq, old, a, new, b: F.struct(F.lit(seq).alias("seq"), F.concat(F.lit("c"), F.lit(seq).cast("string")).alias("commit"), old.cast("long").alias("old_start"), a.cast("long").alias("old_count"), new.cast("long").alias("new_start"), b.cast("long").alias("new_count"))
    zero, one = F.lit(0), F.lit(1)
    found = [h(0, zero, zero, one, F.col("n"))]
    for k in range(1, 5):
        # lines before this commit: one more for each, one less after the third
        n = F.col("n") + (k - 1 if k < 4 else k - 2)
        at = F.pmod(F.col("doc_id") * k, n - 1) + 1
        found += [h(k, zero, zero, one, one), h(k, at, one, at + 1, one)]
        if k == 3:
            found.append(h(k, n, one, n, zero))
    return d.select("path", F.explode(F.array(*found)).alias("h")).select("path", "h.*")


def blame_generated(spark, sf_dir):
    """Every line of generated histories of all documents, with the commit that last changed it."""
    return blame.lines(blame.blamed(_hunks(spark, sf_dir)))


_NAMES = "stream_debounced section_staleness stream_staleness loop_prefetch stream_prefetch blame_generated debounced_changes applied_changes window_counts stream_window_counts stream_session_counts stream_upserts lock_fold stream_locks lease_timeline stream_lease_timeline lock_awaits wait_cycle deadlock_cycles session_outcomes loop_signals loop_touched loop_iterations usage_counters".split()
QUERIES = {name: globals()[name] for name in _NAMES}

_WINDOWS = "SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM events GROUP BY ALL"
_SESSIONS = """SELECT path, min(ts)::VARCHAR AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (
  SELECT user_id::VARCHAR AS path, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events)) GROUP BY path, k"""
# steps through the events of all paths at once: the k-th of each path hangs on the one before
_FOLD = """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts, op, who) AS k FROM (
  SELECT props->>'$.k' AS path, ts, CASE event_type WHEN 'click' THEN 'claim' ELSE 'release' END AS op, user_id::VARCHAR AS who FROM events WHERE event_type IN ('click', 'purchase'))),
f AS (SELECT path, 0::BIGINT AS k, NULL::TIMESTAMP AS ts, '' AS op, '' AS who, '' AS result, NULL::VARCHAR AS holder, NULL::TIMESTAMP AS until FROM (SELECT DISTINCT path FROM e)
  UNION ALL SELECT path, k, ts, op, who, CASE WHEN op = 'claim' AND (live IS NULL OR live = who) OR op = 'release' AND live = who THEN 'ok' WHEN live IS NULL THEN 'none' ELSE 'held' END,
    CASE WHEN op = 'claim' THEN coalesce(live, who) WHEN live = who THEN NULL ELSE live END, CASE WHEN op = 'claim' AND (live IS NULL OR live = who) THEN ts + INTERVAL 600 SECONDS ELSE until END
  FROM (SELECT e.path, e.k, e.ts, e.op, e.who, CASE WHEN f.until > e.ts THEN f.holder END AS live, f.until FROM f JOIN e ON e.path IS NOT DISTINCT FROM f.path AND e.k = f.k + 1))
SELECT path, ts::VARCHAR AS ts, op, who AS block_key, result, holder AS held_by FROM f WHERE k > 0"""
# the fold as above, with waits, ends dealt to the paths that a session ever claims, expiries between events and the first time after a wait that its path is free
_TIMELINE = f"""WITH RECURSIVE r AS (SELECT date_trunc('millisecond', ts) AS ts, event_type AS t, user_id::VARCHAR AS who, props->>'$.k' AS path FROM events WHERE event_type <> 'view'), m AS (SELECT max(ts) AS last FROM r),
x AS (SELECT path, ts, CASE t WHEN 'click' THEN 'claim' WHEN 'purchase' THEN 'release' ELSE 'wait' END AS op, who FROM r WHERE t <> 'error'
  UNION ALL SELECT c.path, r.ts, 'end', r.who FROM r JOIN (SELECT DISTINCT path, who FROM r WHERE t = 'click') c USING (who) WHERE t = 'error'),
e AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts, op, who) AS k FROM x),
f AS (SELECT path, 0::BIGINT AS k, NULL::TIMESTAMP AS ts, '' AS op, '' AS who, NULL::VARCHAR AS live, NULL::VARCHAR AS holder, NULL::TIMESTAMP AS until FROM (SELECT DISTINCT path FROM e)
  UNION ALL SELECT path, k, ts, op, who, live, CASE WHEN op = 'claim' THEN coalesce(live, who) WHEN op <> 'wait' AND live = who THEN NULL ELSE live END,
    CASE WHEN op = 'claim' AND (live IS NULL OR live = who) THEN ts + INTERVAL {LEASE_TTL} SECONDS ELSE until END
  FROM (SELECT e.path, e.k, e.ts, e.op, e.who, CASE WHEN f.until > e.ts THEN f.holder END AS live, f.until FROM f JOIN e ON e.path IS NOT DISTINCT FROM f.path AND e.k = f.k + 1)),
n AS (SELECT *, lead(ts) OVER (PARTITION BY path ORDER BY k) AS nx FROM f),
ex AS (SELECT path, k, until AS ts, holder FROM n, m WHERE holder IS NOT NULL AND until <= coalesce(nx, last)),
free AS (SELECT path, k, ts FROM n WHERE k > 0 AND op IN ('release', 'end') AND live = who UNION ALL SELECT path, k, ts FROM ex),
w AS (SELECT n.path, n.k, n.who, n.ts, n.holder, n.ts + INTERVAL {WAIT} SECONDS AS late, (SELECT min(free.ts) FROM free WHERE free.path IS NOT DISTINCT FROM n.path AND free.k >= n.k) AS free_at FROM n WHERE op = 'wait' AND live IS NOT NULL AND live <> who)
SELECT path, ts::VARCHAR AS ts, op, who AS block_key, CASE WHEN op = 'wait' THEN CASE WHEN live IS NULL THEN 'ready' ELSE 'deadlock' END WHEN op = 'claim' AND (live IS NULL OR live = who) OR op <> 'claim' AND live = who THEN 'ok' WHEN live IS NULL THEN 'none' ELSE 'held' END AS result, holder AS held_by
FROM n WHERE k > 0 AND NOT (op = 'end' AND live IS DISTINCT FROM who) AND NOT (op = 'wait' AND live IS NOT NULL AND live <> who)
UNION ALL SELECT path, ts::VARCHAR, 'expire', holder, 'expired', NULL FROM ex
UNION ALL SELECT path, free_at::VARCHAR, 'wait', who, 'ready', NULL FROM w WHERE free_at <= late
UNION ALL SELECT path, late::VARCHAR, 'wait', who, 'timeout', (SELECT arg_max(f.holder, f.k) FROM f WHERE f.path IS NOT DISTINCT FROM w.path AND f.ts < late) FROM w, m WHERE (free_at IS NULL OR free_at > late) AND late <= last"""
_STALE = """WITH e AS (SELECT user_id AS u, max(ts) FILTER (event_type = 'click') AS c, max(ts) FILTER (event_type = 'view') AS v FROM events GROUP BY 1)
SELECT a.u::VARCHAR AS id, coalesce(greatest(b.c, s.c) > coalesce(a.v, TIMESTAMP '0001-01-01'), FALSE) AS stale FROM e a LEFT JOIN e b ON b.u = a.u + 1 LEFT JOIN e s ON s.u = a.u + 7"""
_PREFETCH = f"""WITH e AS ({SUPPLY_SQL}), r AS (SELECT src AS f, dst FROM e UNION SELECT a.src, b.dst FROM e a JOIN e b ON a.dst = b.src)
SELECT conv_id AS session, dst AS file, min(turn) AS at FROM conversations JOIN r ON f = 'p' || ((conv_id * 7 + turn) % 200 + 1) WHERE f <> dst GROUP BY ALL"""
# every line followed from commit to commit by its place
_STEP = "b{k} AS (SELECT path, doc_id, n, 1 AS line, 'c{k}' AS commit FROM d UNION ALL SELECT path, doc_id, n, line + 1, CASE WHEN line = (doc_id * {k}) % ({n} - 1) + 1 THEN 'c{k}' ELSE commit END FROM b{j}{where})"
_BLAME = "WITH d AS (SELECT 'doc' || doc_id AS path, doc_id, coalesce(length(text), 0) % 50 + 2 AS n FROM documents), b0 AS (SELECT path, doc_id, n, unnest(range(1, n + 1)) AS line, 'c0' AS commit FROM d), " + ", ".join(
    _STEP.format(k=k, j=k - 1, n=(size := f"(n + {k - 1 if k < 4 else k - 2})"), where=f" WHERE line < {size}" if k == 3 else "") for k in range(1, 5)
) + " SELECT path, line::BIGINT AS line, commit FROM b4"
_LAST = "l AS (SELECT user_id::VARCHAR AS path, arg_max(event_type, ts) AS k, arg_max(event_id, ts)::VARCHAR AS content FROM events GROUP BY 1)"
ORACLES = {
    "debounced_changes": "SELECT user_id::VARCHAR AS path, event_id::VARCHAR AS content FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nx FROM events) WHERE nx IS NULL OR nx - ts > INTERVAL 6 HOURS",
    "applied_changes": f"WITH {_LAST} SELECT c_custkey::VARCHAR AS path, c_name AS content FROM customer WHERE c_custkey::VARCHAR NOT IN (SELECT path FROM l) UNION ALL SELECT path, content FROM l WHERE k <> 'error'",
    "window_counts": _WINDOWS,
    "stream_window_counts": _WINDOWS,
    "stream_session_counts": _SESSIONS,
    "lock_fold": _FOLD,
    "stream_locks": _FOLD,
    "stream_debounced": "SELECT user_id::VARCHAR AS path, event_id::VARCHAR AS content, t + INTERVAL 6 HOURS > m - INTERVAL 1 HOUR AS open FROM (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS nx, max(t) OVER () AS m FROM (SELECT *, date_trunc('millisecond', ts) AS t FROM events)) WHERE nx IS NULL OR nx - t > INTERVAL 6 HOURS",
    "section_staleness": _STALE,
    "stream_staleness": _STALE,
    "loop_prefetch": _PREFETCH,
    "stream_prefetch": _PREFETCH,
    "blame_generated": _BLAME,
    "lease_timeline": _TIMELINE,
    "stream_lease_timeline": _TIMELINE,
    "lock_awaits": """WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS u, event_type, event_id, ts, props->>'$.k' AS path FROM events), h AS (SELECT path, arg_max(u, event_id) AS h FROM e WHERE event_type = 'click' AND event_id % 3 > 0 GROUP BY path),
w AS (SELECT u, arg_max(path, event_id) AS path, arg_max(ts, event_id) AS since FROM e WHERE event_type = 'signup' GROUP BY u), g AS (SELECT DISTINCT u AS a, h AS b FROM w JOIN h USING (path)),
c AS (SELECT a, b FROM g UNION SELECT c.a, g.b FROM c JOIN g ON c.b = g.a), d AS (SELECT DISTINCT a FROM c WHERE a = b)
SELECT u AS waiter, w.path, CASE WHEN h IS NULL THEN 'ready' WHEN u IN (SELECT a FROM d) THEN 'deadlock' WHEN (SELECT max(ts) FROM e) >= since + INTERVAL 5 DAYS THEN 'timeout' ELSE 'waiting' END AS status FROM w LEFT JOIN h USING (path)""",
    "wait_cycle": """WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS u, event_type, event_id, props->>'$.k' AS path FROM events), h AS (SELECT path, arg_max(u, event_id) AS h FROM e WHERE event_type = 'click' GROUP BY path),
g AS (SELECT DISTINCT u AS a, h AS b FROM e JOIN h USING (path) WHERE event_type = 'signup'), c AS (SELECT a, b FROM g UNION SELECT c.a, g.b FROM c JOIN g ON c.b = g.a),
s AS (SELECT min(a) AS s FROM c WHERE a = b), p AS (SELECT [s] AS way, s AS here, FALSE AS closed FROM s WHERE s IS NOT NULL
  UNION ALL SELECT list_append(way, b), b, b = way[1] FROM p JOIN g ON a = here WHERE NOT closed AND len(way) < 7 AND (b = way[1] OR NOT list_contains(way, b))),
best AS (SELECT way FROM p WHERE closed ORDER BY len(way), way LIMIT 1)
SELECT (i - 1)::INTEGER AS place, way[i] AS node FROM (SELECT way, unnest(range(1, len(way) + 1)) AS i FROM best)""",
    "stream_upserts": f"WITH {_LAST} SELECT path, content FROM l WHERE k <> 'error'",
    "deadlock_cycles": """WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS u, event_type, event_id, props->>'$.k' AS path FROM events), h AS (SELECT path, arg_max(u, event_id) AS h FROM e WHERE event_type = 'click' GROUP BY path),
w AS (SELECT u, arg_max(path, event_id) AS path FROM e WHERE event_type = 'signup' GROUP BY u), g AS (SELECT DISTINCT u AS a, h AS b FROM w JOIN h USING (path)),
c AS (SELECT a, b FROM g UNION SELECT c.a, g.b FROM c JOIN g ON c.b = g.a) SELECT DISTINCT a AS node FROM c WHERE a = b""",
    "session_outcomes": "SELECT status, count(*) AS n FROM (SELECT user_id, coalesce(arg_min(CASE event_type WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'timed_out' ELSE 'failed' END, ts) FILTER (event_type IN ('purchase', 'error', 'signup')), 'running') AS status FROM events GROUP BY user_id) GROUP BY status",
    "loop_signals": """SELECT conv_id AS session, i::INTEGER AS iteration, CASE WHEN i % 3 = 0 THEN 0 ELSE s END::INTEGER AS stale_count, i % 3 = 0 AS reindexed, TRUE AS recommended, s >= 5 AND i % 3 <> 0 AS pause, i >= 4 AS stop
FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, length(text) % 9 AS s FROM conversations)""",
    "loop_touched": "SELECT conv_id AS session, count(*) AS iterations, array_to_string(list_sort(list(DISTINCT role)), ',') AS files FROM conversations GROUP BY 1",
    "loop_iterations": "SELECT turn AS iteration, role AS goal FROM conversations WHERE conv_id = 7",
    "usage_counters": "SELECT event_type AS tool, props->>'$.k' AS key, count(*) AS n FROM events GROUP BY ALL",
}
