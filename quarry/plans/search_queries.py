"""Search operators over the driver's tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import graph, search, stored
from quarry.plans.sqltext import tokens
from quarry.plans.tables import supply_edges, table
from quarry.sources.checkpoints import remove, shared_dir

ASKED = "there and retioner Thanedble"
SOFT_ASKED = "theren answ"
WORDS = "the licensed idiot"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def tokenize_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.term_frequencies(_documents(spark, sf_dir))


def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored.frequencies(_documents(spark, sf_dir))


#: Written indexes of a session: path -> (names, sizes and times of the documents' files, folder).
_written: dict[tuple[str, str], tuple[list, str]] = {}


def _state(spark: SparkSession, sf_dir: str) -> list:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{sf_dir}/documents.parquet")
    return sorted(map(tuple, found.select("path", "length", F.col("modificationTime").cast("string")).collect()))


def _index(spark: SparkSession, sf_dir: str, anew: bool = False) -> stored.Stored:
    """The index of the documents as they are now: it is written once for each state of their files."""
    key, state = (spark.sparkContext.applicationId, sf_dir), _state(spark, sf_dir)
    before = _written.get(key)
    if anew or before is None or before[0] != state:
        folder = f"{shared_dir(spark)}/search-{uuid.uuid4().hex}"
        stored.write(_documents(spark, sf_dir), folder)
        _written[key] = (state, folder)
        if before:
            remove(spark, before[1])
    return stored.Stored(spark, _written[key][1])


def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Builds the index of the documents anew: its numbers."""
    made = _index(spark, sf_dir, anew=True)
    sizes = made.table("dictionary").agg(F.count("*").alias("terms"), F.sum("df").alias("postings"))
    return made.table("stats").select("n_docs", F.round("avg_dl", 6).alias("avg_dl")).join(F.broadcast(sizes))


def _ranked(spark: SparkSession, sf_dir: str, query: str, soft: bool) -> DataFrame:
    return _index(spark, sf_dir).ranked(query, 20, soft).select("doc_id", F.round("score", 6).alias("score"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, ASKED, False)


def bm25_soft_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, SOFT_ASKED, True)


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as symbols, nations as files, regions as packages."""
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("path"), F.lit("symbol").alias("kind"), F.col("s_name").alias("name"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("path"), F.lit("file").alias("kind"), F.col("n_name").alias("name"))
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("path"), F.lit("package").alias("kind"), F.col("r_name").alias("name"))
    return s.unionByName(n).unionByName(r).select(F.col("path").alias("doc_id"), "path", "kind", "name", F.col("name").alias("text"))


PLACE = "supplier africa nation 000000007"


def bm25_proximity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = search.build(_kinds(spark, sf_dir))
    near = graph.hop_scores(supply_edges(spark, sf_dir), ["p7"])
    return search.with_proximity(index, PLACE, near, 20).select("doc_id", "kind", "name", F.round("score", 6).alias("score"))


def ngram_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text"))
    return search.semantic(parts, "green widgets", 20).select("doc_id", F.round("score", 6).alias("score"))


def docs_keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.keywords(_documents(spark, sf_dir), WORDS, 20).select("doc_id", F.round("score", 6).alias("score"))


QUERIES = {
    "index_build": index_build,
    "bm25_topk": bm25_topk,
    "tokenize_tf": tokenize_tf,
    "term_df": term_df,
    "bm25_soft_topk": bm25_soft_topk,
    "bm25_proximity_topk": bm25_proximity_topk,
    "ngram_cosine_topk": ngram_cosine_topk,
    "docs_keyword_topk": docs_keyword_topk,
}

_TF = f"tf AS (SELECT doc_id, term, count(*) AS tf FROM ({tokens('d', 'doc_id', 'text')}) GROUP BY doc_id, term)"
_INDEX = f"""{_TF},
p AS (SELECT doc_id, term, max(tf) AS tf FROM (SELECT * FROM tf UNION ALL SELECT doc_id, left(term, 4), 0 FROM tf WHERE length(term) >= 4) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
dl AS (SELECT d.doc_id, greatest(coalesce(sum(tf), 0), 1) AS dl FROM d LEFT JOIN tf USING (doc_id) GROUP BY d.doc_id),
st AS (SELECT count(*) AS n_docs, avg(dl) AS avg_dl FROM dl)"""
_DOCS = "d AS (SELECT doc_id, text FROM documents)"


def _bm25(docs: str, query: str, soft: bool) -> str:
    asked = f"q AS (SELECT term, count(*) AS n FROM ({tokens(f'''(SELECT 0 AS k, '{query}' AS text)''', 'k', 'text')}) GROUP BY term)"
    loose = """,
nr AS (SELECT df.term, q.term AS asked, n, df FROM df, q WHERE starts_with(df.term, q.term) OR starts_with(q.term, df.term)),
rc AS (SELECT asked, max(df) AS df FROM nr GROUP BY asked),
ls AS (SELECT doc_id, asked AS term, any_value(n) AS n, max(tf) AS tf FROM p JOIN nr USING (term) GROUP BY doc_id, asked),
h AS (SELECT * FROM ex UNION ALL SELECT ls.doc_id, ls.term, ls.n, ls.tf, rc.df FROM ls JOIN rc ON rc.asked = ls.term WHERE tf > 0 AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.doc_id = ls.doc_id AND ex.term = ls.term))"""
    return f"""WITH {docs}, {_INDEX}, {asked},
ex AS (SELECT doc_id, term, n, tf, df FROM p JOIN q USING (term) JOIN df USING (term) WHERE tf > 0){loose if soft else ", h AS (SELECT * FROM ex)"},
sc AS (SELECT doc_id, sum(n * ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))) AS score FROM h JOIN dl USING (doc_id), st GROUP BY doc_id)"""


_KIND_DOCS = """d AS (SELECT 's' || s_suppkey AS doc_id, s_name AS text, 'symbol' AS kind FROM supplier UNION ALL SELECT 'n' || n_nationkey, n_name, 'file' FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name, 'package' FROM region)"""
_HOPS = """e AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
h1 AS (SELECT DISTINCT dst AS node FROM e WHERE src = 'p7'), h2 AS (SELECT DISTINCT dst AS node FROM e JOIN h1 ON src = node),
hop AS (SELECT node, min(hop) AS hop FROM (SELECT 'p7' AS node, 0 AS hop UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2) GROUP BY node)"""

ORACLES = {
    "tokenize_tf": f"WITH {_DOCS}, {_TF} SELECT doc_id, term, tf FROM tf",
    "index_build": f"WITH {_DOCS}, {_INDEX} SELECT n_docs, round(avg_dl, 6) AS avg_dl, (SELECT count(*) FROM df) AS terms, (SELECT sum(df)::BIGINT FROM df) AS postings FROM st",
    "term_df": f"WITH {_DOCS}, {_INDEX} SELECT term, df FROM df",
    "bm25_topk": f"{_bm25(_DOCS, ASKED, False)} SELECT doc_id, round(score, 6) AS score FROM sc WHERE score > 0 ORDER BY round(score, 9) DESC, doc_id LIMIT 20",
    "bm25_soft_topk": f"{_bm25(_DOCS, SOFT_ASKED, True)} SELECT doc_id, round(score, 6) AS score FROM sc WHERE score > 0 ORDER BY round(score, 9) DESC, doc_id LIMIT 20",
    "bm25_proximity_topk": f"""{_bm25(_KIND_DOCS, PLACE, True)}, {_HOPS},
b AS (SELECT d.doc_id, d.kind, d.text AS name, score + coalesce(CASE hop WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.25 END, 0.1) * CASE kind WHEN 'package' THEN 0.1 WHEN 'file' THEN 0.2 ELSE 0.3 END AS score
  FROM sc JOIN d USING (doc_id) LEFT JOIN hop ON hop.node = d.doc_id WHERE score > 0)
SELECT doc_id, kind, name, round(score, 6) AS score FROM b ORDER BY round(b.score, 9) DESC, doc_id LIMIT 20""",
    "ngram_cosine_topk": r"""WITH t AS (SELECT p_partkey AS doc_id, regexp_replace(lower(p_name), '[^\p{L}\p{N}]+', '', 'g') AS s FROM part UNION ALL SELECT -1, 'greenwidgets'),
g AS (SELECT doc_id, substr(s, i, 3) AS gram, count(*) AS k FROM (SELECT doc_id, s, unnest(range(1, greatest(1, length(s) - 2) + 1)) AS i FROM t WHERE s <> '') GROUP BY ALL),
w AS (SELECT doc_id, gram, k / greatest(sqrt(sum(k * k) OVER (PARTITION BY doc_id)), 0.000001) AS w FROM g),
s AS (SELECT a.doc_id, sum(a.w * b.w) AS score FROM w a JOIN w b ON a.gram = b.gram AND b.doc_id = -1 WHERE a.doc_id <> -1 GROUP BY a.doc_id)
SELECT doc_id, round(score, 6) AS score FROM s WHERE score > 0.05 ORDER BY round(s.score, 9) DESC, doc_id LIMIT 20""",
    "docs_keyword_topk": "WITH s AS (SELECT doc_id, (contains(lower(text), 'the')::INT + contains(lower(text), 'licensed')::INT + contains(lower(text), 'idiot')::INT) / 3.0 AS score FROM documents) SELECT doc_id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY round(s.score, 9) DESC, doc_id LIMIT 20",
}
