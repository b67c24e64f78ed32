"""The driver's tables in the roles of the data model: files, edges, calls, symbols, commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part -> supplier -> nation -> region."""
    lineitem = table(spark, sf_dir, "lineitem").select(node("p", "l_partkey").alias("src"), node("s", "l_suppkey").alias("dst")).distinct()
    supplier = table(spark, sf_dir, "supplier").select(node("s", "s_suppkey").alias("src"), node("n", "s_nationkey").alias("dst"))
    nation = table(spark, sf_dir, "nation").select(node("n", "n_nationkey").alias("src"), node("r", "n_regionkey").alias("dst"))
    return lineitem.unionByName(supplier).unionByName(nation)


SUPPLY_SQL = """SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation"""


def order_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders call parts: a multigraph with the line as weight; every call is resolved but those of line 7."""
    l = table(spark, sf_dir, "lineitem")
    return l.select(
        F.lit("orders").alias("caller_file"),
        node("o", "l_orderkey").alias("caller_sym"),
        node("p", "l_partkey").alias("callee_name"),
        F.when(F.col("l_linenumber") < 7, F.lit("parts")).alias("callee_file"),
        F.col("l_linenumber").alias("line"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files (path, content) with the source as package."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"), F.col("text").alias("content"), F.col("text"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as commits: a file for each user, errors are bug fixes."""
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("sha"), F.when(F.col("event_type") == "error", "fix crash").otherwise(F.col("event_type")).alias("subject"))
