"""Snapshots, sessions of loops, the index's status, documentation search and sinks over the driver's tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import packages, search
from quarry.plans.tables import commits, files, table
from quarry.sources import repos, sinks
from quarry.sources.checkpoints import cut, remove, shared_dir
from quarry.streaming import changes, loops, snapshots, staleness


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents in folders of ten, before and after: of each ten folders one has other texts and one has moved."""
    d = table(spark, sf_dir, "documents")
    group = F.floor(F.col("doc_id") / 10)
    place = lambda top: F.concat_ws("/", top, "source", "lang", F.concat(F.lit("g"), group.cast("string")), F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    after = d.select("source", place(F.lit("docs")).alias("path"), F.col("text").alias("content"))
    moved = F.when(group % 10 == 5, F.lit("old")).otherwise(F.lit("docs"))
    before = d.select("source", place(moved).alias("path"), F.when(group % 10 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"))
    return tuple(df.select(F.col("source").alias("repo"), "path", "content") for df in (before, after))


def snapshot_changes(spark, sf_dir):
    """What differs between two snapshots of all documents, by folder hashes: the changes that bring an index up to date."""
    before, after = _snapshots(spark, sf_dir)
    folder = _folder(spark, "snapshots")
    found = snapshots.compared(snapshots.written(before, f"{folder}/before"), snapshots.written(after, f"{folder}/after"))
    return snapshots.as_changes(found, after, "2024-01-02").select("repo", "path", "op", F.md5("content").alias("md5"))


def _loop_events(df: DataFrame) -> DataFrame:
    """Events of users as sessions: signups begin them, views and purchases are ticks, clicks record a file, errors end them."""
    op = F.create_map(*(F.lit(x) for pair in (("signup", "begin"), ("view", "tick"), ("purchase", "tick"), ("click", "record"), ("error", "end")) for x in pair))[F.col("event_type")]
    key = F.get_json_object("props", "$.k")
    return df.select(F.col("user_id").alias("session"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), op.alias("op"), F.concat(F.lit("goal "), F.col("event_id").cast("string")).alias("goal"), F.array(F.concat(F.lit("/repo/./k"), key)).alias("files"))


def loop_sessions(spark, sf_dir):
    return loops.sessions(_loop_events(table(spark, sf_dir, "events")))


def loop_files(spark, sf_dir):
    return loops.session_files(_loop_events(table(spark, sf_dir, "events")), "/repo")


def stream_usage(spark, sf_dir):
    """Usage counters from a stream of three batches."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_type").alias("tool"), F.get_json_object("props", "$.k").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    folder = _folder(spark, "usage")
    changes.ran(loops.usage(changes.in_batches(rows, "ts", 3)), "usage", "update", staleness.keeper(folder))
    return spark.read.schema("tool string, key string, n long").parquet(f"{folder}/flags-*").groupBy("tool", "key").agg(F.max("n").alias("n"))


def index_status(spark, sf_dir):
    """The status of an index of users' files made on 20 January."""
    e = commits(spark, sf_dir)
    newest = lambda df: df.groupBy("path").agg(F.max("ts").alias("mtime"))
    found = repos.index_status(newest(e), newest(e.where(F.col("ts") < "2024-01-20")), "2024-01-20")
    return found.withColumn("newest", F.col("newest").cast("string"))


DOC_WORDS = "Licensed, the: idiot?"


def docs_boosted_topk(spark, sf_dir):
    """Documents as sections: their first line is the heading; those of an odd number of characters are stale."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.substring_index("text", "\n", 1).alias("heading"), (F.col("n_chars") % 2 == 1).alias("stale"))
    return search.keywords(d, DOC_WORDS, 20, heading="heading", stale="stale").select("doc_id", F.round("score", 6).alias("score"))


def kept_dictionary(spark, sf_dir):
    """The dictionary of paths as JSON, read again."""
    folder = _folder(spark, "dictionary")
    sinks.write_json(packages.path_ids(files(spark, sf_dir)), folder, "dictionary")
    out = cut(spark.read.schema("id string, path string").json(f"{folder}/dictionary.json"))
    remove(spark, folder)
    return out


QUERIES = {f.__name__: f for f in (snapshot_changes, loop_sessions, loop_files, stream_usage, index_status, docs_boosted_topk, kept_dictionary)}

_INSIDE = """WITH e AS (SELECT user_id AS s, ts, event_id AS q, CASE event_type WHEN 'signup' THEN 'begin' WHEN 'click' THEN 'record' WHEN 'error' THEN 'end' ELSE 'tick' END AS op, 'k' || (props->>'$.k') AS file FROM events),
b AS (SELECT s, min((ts, q)) AS b, arg_min(q, (ts, q)) AS g FROM e WHERE op = 'begin' GROUP BY s), l AS (SELECT e.*, b.b, b.g FROM e JOIN b USING (s) WHERE (ts, q) >= b.b),
x AS (SELECT s, min((ts, q)) AS x FROM l WHERE op = 'end' GROUP BY s), i AS (SELECT l.*, x.x, x.x IS NULL OR (l.ts, l.q) < x.x AS live FROM l LEFT JOIN x USING (s)),
a AS (SELECT s, file, bool_or(op = 'record') AS touched, min((ts, q)) AS since FROM i WHERE file IS NOT NULL AND ((ts, q) = b OR op = 'record' AND live) GROUP BY s, file)"""
_PLACE = "concat_ws('/', {top}, source, lang, 'g' || (doc_id // 10), doc_id || '.md')"
ORACLES = {
    "snapshot_changes": f"""WITH n AS (SELECT source AS repo, {_PLACE.format(top="'docs'")} AS path, text AS content FROM documents),
o AS (SELECT source AS repo, {_PLACE.format(top="CASE WHEN doc_id // 10 % 10 = 5 THEN 'old' ELSE 'docs' END")} AS path, CASE WHEN doc_id // 10 % 10 = 3 THEN text || '!' ELSE text END AS content FROM documents)
SELECT repo, path, 'upsert' AS op, md5(content) AS md5 FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.repo IS NOT DISTINCT FROM n.repo AND o.path = n.path AND o.content IS NOT DISTINCT FROM n.content)
UNION ALL SELECT repo, path, 'delete', NULL FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE o.repo IS NOT DISTINCT FROM n.repo AND o.path = n.path)""",
    "loop_sessions": f"""{_INSIDE} SELECT s AS session, 'goal ' || any_value(g) AS goal, count(*) FILTER (op = 'tick' AND live) AS iterations, (SELECT count(*) FROM a WHERE a.s = i.s AND touched) AS touched,
bool_or(x IS NOT NULL) AS closed, count(*) FILTER (NOT live AND (ts, q) > x AND op <> 'begin') AS rejected FROM i GROUP BY s""",
    "loop_files": f"{_INSIDE} SELECT s AS session, file, touched, since = min(since) OVER (PARTITION BY s) AS primary FROM a",
    "stream_usage": "SELECT event_type AS tool, props->>'$.k' AS key, count(*) AS n FROM events GROUP BY ALL",
    "index_status": """WITH s AS (SELECT count(*) AS stale, (SELECT max(ts) FROM events)::VARCHAR AS newest FROM (SELECT user_id, max(ts) AS a, max(ts) FILTER (ts < TIMESTAMP '2024-01-20') AS b FROM events GROUP BY 1) WHERE b IS NULL OR a > b)
SELECT '2024-01-20' AS indexed_at, newest, stale > 0 AS dirty, stale, CASE WHEN stale > 0 THEN stale || ' files differ from the index' END AS warning FROM s""",
    "docs_boosted_topk": """WITH s AS (SELECT *, split_part(text, chr(10), 1) AS heading, concat_ws(' ', split_part(text, chr(10), 1), text) AS hay FROM documents),
k AS (SELECT doc_id, (contains(lower(hay), 'licensed')::INT + contains(lower(hay), 'the')::INT + contains(lower(hay), 'idiot')::INT) AS hits, contains(lower(heading), 'licensed') AS top, n_chars % 2 = 1 AS stale FROM s),
r AS (SELECT doc_id, hits / 3.0::DOUBLE + CASE WHEN top THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN stale THEN 0.05::DOUBLE ELSE 0 END AS score FROM k WHERE hits > 0)
SELECT doc_id, round(score, 6) AS score FROM r ORDER BY round(r.score, 9) DESC, doc_id LIMIT 20""",
    "kept_dictionary": "WITH p AS (SELECT DISTINCT concat_ws('/', source, lang, doc_id || '.md') AS path FROM documents) SELECT 'p' || row_number() OVER (ORDER BY path) AS id, path FROM p",
}
