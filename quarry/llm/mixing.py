"""Mixing sources to target weights by hash-threshold histograms.

Targets: sources in code point order (null last) weigh 3, 1, 2, repeating, and share
`total_share` of all words; a target stops at `most_repeats` times its source's size
and the excess is shared again by weight until none is above. That is one water
level: target = min(most_repeats * size, level * weight).

Taking: a source whose target is r times its size takes every document floor(r)
times, and once more those whose hash lies below a threshold. The threshold is found
without sorting rows: words are summed by (source, top 12 bits of the hash), the
bucket that crosses the budget is found, and only its rows are summed by the next 12
bits, three times. The last bucket (36 bits) goes in if that comes nearer the budget.
Thresholds of growing budgets are nested, so a larger mix contains a smaller one.

Nulls: null texts have size 0, null sources are one source (the last), a null id counts
as an id of its own. The hash is of id and text, so only repeated rows are taken together;
there are no other ties but clashes of 36 bits. Very long texts count whole. An empty
table gives an empty result; a source without words has target 0. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import all_columns, cut, free, hex_long, id_text, table
from quarry.operators.numbering import numbered

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MOST_REPEATS = 2
#: Bits of the hash that one histogram level resolves, and the levels.
BITS, LEVELS = 12, 3
#: A table with a row for each source is broadcast up to this many rows, and joined by shuffling beyond.
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, total_share: float = TOTAL_SHARE, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size) -> with target. One window without a partition runs over one row for each distinct ratio of size and weight."""
    ranked = numbered(sources.withColumn("none", F.col("source").isNull()), ["none", "source"])
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("n") - 1) % len(weights) + 1).cast("int"))
    s = cut(ranked.withColumn("weight", weight).withColumn("most", (F.col("source_size") * most_repeats).cast("double")))
    ratios = s.groupBy((F.col("most") / F.col("weight")).alias("ratio")).agg(F.sum("most").alias("most"), F.sum("weight").alias("weight"), F.sum(F.col("source_size").cast("double")).alias("size"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    below = Window.orderBy("ratio").rowsBetween(Window.unboundedPreceding, -1)
    # the level if those before this ratio are capped; the largest that fits is the water level
    capped, taken = (F.coalesce(F.sum(c).over(below), F.lit(0.0)) for c in ("most", "weight"))
    levels = ratios.withColumn("level", (F.sum("size").over(everything) * total_share - capped) / (F.sum("weight").over(everything) - taken))
    level = levels.agg(F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).alias("level")).first()["level"]
    return s.select("source", "source_size", (F.col("most") if level is None else F.least(F.col("most"), F.lit(level) * F.col("weight"))).alias("target"))


def with_sources(rows: DataFrame, per_source: DataFrame, small: bool) -> DataFrame:
    other = per_source.withColumnRenamed("source", "_source")
    return rows.join(F.broadcast(other) if small else other, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def thresholds(rows: DataFrame, per_source: DataFrame, small: bool) -> DataFrame:
    """(source, below): rows with hash < below make up the part of the target beyond whole repeats, as nearly as 36 bits allow."""
    state = per_source.select("source", (F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size")).alias("budget"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("base"))
    state = state.where(F.col("budget") > 0)
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        inside = rows if level == 1 else with_sources(rows, state.select("source", "prefix"), small).where(F.shiftright("hash", shift + BITS) == F.col("prefix"))
        sums = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        upto = F.col("base") + F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        crossed = with_sources(sums, state.select("source", "budget", "base"), small).withColumn("upto", upto).where(F.col("upto") >= F.col("budget"))
        state = cut(crossed.groupBy("source").agg(F.first("budget").alias("budget"), F.min("bucket").alias("prefix"), F.min("upto").alias("upto"), F.min_by("words", "bucket").alias("words")).select("source", "budget", "prefix", "upto", (F.col("upto") - F.col("words")).alias("base")))
    nearer = F.col("upto") - F.col("budget") <= F.col("budget") - F.col("base")
    return state.select("source", (F.col("prefix") + nearer.cast("long")).alias("below"))


def hashed(doc_id: str = "doc_id", text: str = "text") -> Column:
    own = F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))
    return hex_long(F.md5(F.concat_ws("|", F.lit("mix"), id_text(doc_id), own)), 1, BITS * LEVELS // 4)


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: Sequence[int] = WEIGHTS, total_share: float = TOTAL_SHARE, most_repeats: int = MOST_REPEATS) -> tuple[DataFrame, DataFrame, bool]:
    """The words of each row (doc_id, source, size, hash), the plan of each source (source, source_size, target, whole, below), and whether the plan may be broadcast."""
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), hashed(doc_id, text).alias("hash")))
    sources = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, total_share, most_repeats))
    small = sources.count() <= BROADCAST_SOURCES
    found = thresholds(rows, sources.where(F.col("source_size") > 0), small)
    other = found.withColumnRenamed("source", "_source")
    whole = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0))
    plan = cut(sources.join(other, F.col("source").eqNullSafe(F.col("_source")), "left").select("source", "source_size", "target", whole.alias("whole"), F.coalesce("below", F.lit(0)).alias("below")))
    return rows, plan, small


def repeats(hash_: Column) -> Column:
    """How often the mix takes a row of a source with this plan."""
    return F.col("whole") + (hash_ < F.col("below")).cast("long")


def mixed(docs: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it; docs must have doc_id, text and source."""
    _, plan, small = mix(docs)
    source, whole, below, copy = (free(docs, c) for c in ("_source", "_whole", "_below", "_copy"))
    renamed = plan.select(F.col("source").alias(source), F.col("whole").alias(whole), F.col("below").alias(below))
    taken = docs.join(F.broadcast(renamed) if small else renamed, F.col("source").eqNullSafe(F.col(source)))
    times = F.col(whole) + (hashed() < F.col(below)).cast("long")
    return taken.withColumn(copy, F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select(*all_columns(docs))


def op10_hash_threshold_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, plan, small = mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return with_sources(rows, plan, small).select("doc_id", "size", "source_size", "target", (F.col("size") * repeats(F.col("hash"))).alias("taken"))


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, ''))), 1, {BITS * LEVELS // 4}))::BIGINT AS hash
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, list_extract([3.0::DOUBLE, 1.0, 2.0], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT) AS w FROM d GROUP BY source),
l AS (
  SELECT *, 2.0::DOUBLE * source_size AS most, sum(source_size) OVER () * 1.5::DOUBLE AS total,
    coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open
  FROM s),
v AS (SELECT max((total - capped) / open) FILTER (WHERE (total - capped) / open * w <= most) AS level FROM l),
t AS (SELECT source, source_size, least(most, coalesce(level * w, most)) AS target FROM l, v),
b AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS whole, CASE WHEN source_size = 0 THEN 0 ELSE target - floor(target / source_size) * source_size END AS budget FROM t),
c AS (SELECT source, hash, words, sum(words) OVER (PARTITION BY source ORDER BY hash) AS upto FROM (SELECT source, hash, sum(size) AS words FROM d GROUP BY source, hash)),
x AS (SELECT c.source, min(c.hash) AS hash, arg_min(c.upto, c.hash) AS upto, arg_min(c.words, c.hash) AS words, any_value(budget) AS budget FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source WHERE budget > 0 AND c.upto >= budget GROUP BY c.source)
SELECT d.doc_id, d.size, b.source_size, b.target,
  (d.size * (b.whole + CASE WHEN d.hash < coalesce(x.hash + CASE WHEN x.upto - x.budget <= x.budget - (x.upto - x.words) THEN 1 ELSE 0 END, 0) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source
"""

QUERIES = {"op10_hash_threshold_mix": op10_hash_threshold_mix}
ORACLES = {"op10_hash_threshold_mix": ORACLE}
