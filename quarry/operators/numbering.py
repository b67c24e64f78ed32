"""Global row numbers without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.sources.checkpoints import cut


def numbered(rows: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """rows with n, 1 onwards by `order`, which must tell them apart.

    Rows are dealt to ranges; each range is numbered by itself and shifted by the counts of the ranges before it, one row a range.
    """
    spark = rows.sparkSession
    k = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(k, *order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_size"))
    shifts = sizes.withColumn("_shift", F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).drop("_size")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_row", inside).join(F.broadcast(shifts), "_part").withColumn("n", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift")
