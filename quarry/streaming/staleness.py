"""Staleness of documentation sections as a fold over a stream of changes of code and documentation.

Links are a static table: a section's linked paths, the files that define the symbols it links to, and its own file. A change is
joined with those that it may mean by the file's name, and each section folds two maxima: the last change of linked code
and of its own file. A section is stale if the first is later. Maxima don't depend on the order of batches, a repeated
change alters nothing, and a flag is carried until the section's own file changes. State is one row for each section.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import paths
from quarry.operators.docs import reference


def links(linked: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """(id, side, means, file_name): linked is (id, file, target, broken), symbols (name, path). Broken links don't count."""
    target = linked.where(~F.col("broken")).select("id", reference(F.col("target")).alias("r")).select("id", F.col("r.path").alias("path"), F.col("r.anchor").alias("anchor"))
    out = target.where("path <> ''").select("id", F.lit("path").alias("side"), F.col("path").alias("means"))
    out = out.unionByName(linked.select("id", F.lit("own").alias("side"), F.col("file").alias("means")))
    if symbols is not None:
        defined = symbols.select(F.col("name").alias("anchor"), F.col("path").alias("means")).distinct()
        out = out.unionByName(target.where("path = ''").join(defined, "anchor").select("id", F.lit("symbol").alias("side"), "means"))
    return out.distinct().withColumn("file_name", paths.basename(F.col("means")))


def folded(changes: DataFrame, static: DataFrame) -> DataFrame:
    """(id, code, own): the last changes (path, ts), of a table or a stream, by section."""
    c = changes.select(F.col("path").alias("changed"), "ts", paths.basename(F.col("path")).alias("file_name"))
    fits = F.when(F.col("side") == "path", paths.fits_either_way(F.col("means"), F.col("changed")) | ~F.contains("means", F.lit("/"))).otherwise(F.col("means") == F.col("changed"))
    met = c.join(static, "file_name").where(fits)
    return met.groupBy("id").agg(F.max(F.when(F.col("side") != "own", F.col("ts"))).alias("code"), F.max(F.when(F.col("side") == "own", F.col("ts"))).alias("own"))


def flags(linked: DataFrame, last: DataFrame) -> DataFrame:
    """(id, stale) of all sections; last: (id, code, own), perhaps several rows a section."""
    one = last.groupBy("id").agg(F.max("code").alias("code"), F.max("own").alias("own"))
    stale = F.coalesce(F.col("code") > F.coalesce("own", F.lit("0001-01-01").cast("timestamp")), F.lit(False))
    return linked.select("id").distinct().join(one, "id", "left").select("id", stale.alias("stale"))


def keeper(folder: str) -> Callable[[DataFrame, int], None]:
    """A batch function that writes what a batch has changed; all of it together has each section's maxima."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/flags-{number}")
