"""Cutting lineage in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a temporary folder if all executors are threads of this process (tests), else an error."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found is None:
        found = sc.getConf().get("spark.checkpoint.dir")
        if not found:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            found = tempfile.mkdtemp(prefix="quarry-checkpoint-")
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df, computed once and written as Parquet to the shared folder: smaller than a checkpoint, and only the columns that are asked are read."""
    folder = f"{shared_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _located(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that isn't read any more, wherever it lies."""
    where, system = _located(spark, path)
    system.delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where, system = _located(spark, path)
    return system.exists(where)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Renames a file or folder of one file system; the new name must be free."""
    where, system = _located(spark, path)
    if not system.rename(where, _located(spark, to)[0]):
        raise OSError(f"{path} can't be renamed to {to}")


def qualified(spark: SparkSession, path: str) -> str:
    """The path as readers of files report it, with its file system."""
    where, system = _located(spark, path)
    return system.makeQualified(where).toString()


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """Writes a small file wherever it lies, so that executors can read it."""
    where, system = _located(spark, path)
    out = system.create(where)
    out.write(content)
    out.close()
