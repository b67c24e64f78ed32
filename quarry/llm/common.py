"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.sources.checkpoints import cut, remove, shared_dir
from quarry.sources.package import send_package

__all__ = ["added", "all_columns", "cut", "free", "held_out", "hex_long", "id_text", "map_arrow", "remove", "shared_dir", "table"]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def map_arrow(df: DataFrame, run: Callable, schema: str | T.StructType) -> DataFrame:
    """mapInArrow with this package sent to the executors, as they may not have it installed."""
    send_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def free(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever columns it brings."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def all_columns(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def added(df: DataFrame, *new: tuple[str, T.DataType]) -> T.StructType:
    """df's schema and further columns."""
    return T.StructType([*(T.StructField(f.name, f.dataType) for f in df.schema.fields), *(T.StructField(n, t) for n, t in new)])


def hex_long(digest: Column, start: int, digits: int) -> Column:
    """The integer that `digits` hex digits of a digest, from position `start` (1-based), spell."""
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")


def id_text(column: str | Column) -> Column:
    """An id as text; null has a text of its own."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit("null"))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32(doc_id as text) mod `modulus` == `remainder`; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))
