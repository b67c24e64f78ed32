"""Versions of an index that are merged when read: a batch writes what it changes, not the tables.

Each batch writes a delta, the new rows of the changed files in every table, and a tombstone for each changed path; rows of
a path that are older than its last tombstone don't count. Paths are dealt to buckets. A bucket whose tombstones are
many against its files is compacted: its live rows become its new base, and what came before isn't read for it any more. So
the bytes of a batch follow the batch, and those of all compactions follow the bytes of all batches times a constant.

A manifest names the parts of a version: the base of each bucket, the deltas after it, and how many tombstones it has. Manifest
n + 1 comes from manifest n and batch n alone, and parts are named by their batch: a repeated batch writes the same again.
Parts that neither of the last two versions names are removed.

Changes are those of changes.CHANGES; of equal times the last by op and content counts. A null path is a path of its own.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.sources.checkpoints import cut, put, remove
from quarry.streaming.changes import latest, ran

#: Buckets of paths; a bucket is compacted if it has over LEAST tombstones and over SHARE of its files' number.
BUCKETS, LEAST, SHARE = 64, 1_000, 0.5
GONE = "repo string, path string, bucket int, version int"
FILES = "repo string, path string, content string"


@dataclass
class Manifest:
    #: By bucket: the batch whose compaction wrote its base, and the files in it.
    base: dict[int, tuple[int, int]] = field(default_factory=dict)
    #: By bucket: tombstones since its base.
    gone: dict[int, int] = field(default_factory=dict)
    #: Batches whose deltas are read.
    deltas: list[int] = field(default_factory=list)

    @classmethod
    def read(cls, spark: SparkSession, folder: str, number: int) -> Manifest:
        if not number:
            return cls()
        made = json.loads(spark.read.text(f"{folder}/manifest-{number}.json", wholetext=True).first()[0])
        return cls({int(k): tuple(v) for k, v in made["base"].items()}, {int(k): v for k, v in made["gone"].items()}, made["deltas"])

    def parts(self) -> set[str]:
        return {f"base-{v}" for v, _ in self.base.values()} | {f"delta-{v}" for v in self.deltas}


def bucket(buckets: int) -> F.Column:
    return F.pmod(F.xxhash64("repo", "path"), F.lit(buckets)).cast("int")


class Versions:
    """Tables in a folder: files, and those that `derived` makes of files (repo, path, content), with repo and path."""

    def __init__(self, spark: SparkSession, folder: str, derived: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None, buckets: int = BUCKETS, least: int = LEAST, share: float = SHARE) -> None:
        self.spark, self.folder, self.buckets, self.least, self.share = spark, folder, buckets, least, share
        self.tables: dict[str, Callable[[DataFrame], DataFrame]] = {"files": lambda f: f.select("repo", "path", "content"), **(derived or {})}
        none = spark.createDataFrame([], FILES)
        extra = [T.StructField("version", T.IntegerType()), T.StructField("bucket", T.IntegerType())]
        self.schemas = {name: T.StructType([*make(none).schema.fields, *extra]) for name, make in self.tables.items()}

    def _write(self, rows: DataFrame, name: str, part: str) -> None:
        """Rows of a table with version and bucket, by bucket. Those of a bucket may be many: tasks of a part each write their own file."""
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{name}/{part}")

    def _of(self, name: str, manifest: Manifest, buckets: set[int] | None = None) -> DataFrame:
        """All rows of a version that its tombstones don't hide, with version and bucket."""
        schema = self.schemas[name] if name != "gone" else T.StructType.fromDDL(GONE)
        top = f"{self.folder}/{name}"
        begun = {b: v for b, (v, _) in manifest.base.items()}
        wanted = F.col("bucket").isin(sorted(buckets)) if buckets is not None else F.lit(True)
        since = F.coalesce(*(F.when(F.col("bucket") == b, F.lit(v)) for b, v in begun.items()), F.lit(-1))
        out = self.spark.createDataFrame([], schema)
        for v in sorted({v for v in begun.values()}) if name != "gone" else []:
            out = out.unionByName(self.spark.read.schema(schema).parquet(f"{top}/base-{v}").where(F.col("bucket").isin([b for b, w in begun.items() if w == v])))
        if manifest.deltas:
            # a delta part holds the buckets that its batch has met
            paths = [f"{top}/delta-{v}" for v in manifest.deltas]
            for p in paths:
                out = out.unionByName(self.spark.read.schema(schema).parquet(p).where(F.col("version") > since))
        return out.where(wanted)

    def _live(self, name: str, manifest: Manifest, buckets: set[int] | None = None) -> DataFrame:
        last = self._of("gone", manifest, buckets).groupBy("repo", "path").agg(F.max("version").alias("_gone"))
        rows = self._of(name, manifest, buckets).alias("r")
        same = F.col("r.repo").eqNullSafe(F.col("g.repo")) & F.col("r.path").eqNullSafe(F.col("g.path"))
        return rows.join(last.alias("g"), same, "left").where(F.col("_gone").isNull() | (F.col("version") >= F.col("_gone"))).select("r.*")

    def read(self, name: str, number: int) -> DataFrame:
        """A table after `number` batches."""
        return self._live(name, Manifest.read(self.spark, self.folder, number)).drop("version", "bucket")

    def keep(self, batch: DataFrame, number: int) -> None:
        """Makes version number + 1 of version number and a batch of changes."""
        before = Manifest.read(self.spark, self.folder, number)
        last = cut(latest(batch.select("repo", "path", "op", "ts", "content")).withColumn("bucket", bucket(self.buckets)))
        marked = lambda df: df.withColumns({"version": F.lit(number), "bucket": bucket(self.buckets)})
        self._write(last.select("repo", "path", "bucket", F.lit(number).alias("version")), "gone", f"delta-{number}")
        new = last.where("op <> 'delete'").select("repo", "path", "content")
        for name, make in self.tables.items():
            self._write(marked(make(new)), name, f"delta-{number}")
        met = {r.bucket: r.n for r in last.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
        gone = {b: before.gone.get(b, 0) + met.get(b, 0) for b in {*before.gone, *met}}
        after = Manifest(dict(before.base), gone, [*before.deltas, number])
        full = {b for b, n in gone.items() if n > self.least and n > self.share * after.base.get(b, (0, 0))[1]}
        if full:
            for name in self.tables:
                rows = self._live(name, after, full).withColumn("version", F.lit(number))
                self._write(rows, name, f"base-{number}")
            held = {r.bucket: r.n for r in self.spark.read.schema(self.schemas["files"]).parquet(f"{self.folder}/files/base-{number}").groupBy("bucket").agg(F.count("*").alias("n")).collect()}
            after.base |= {b: (number, held.get(b, 0)) for b in full}
            after.gone = {b: n for b, n in gone.items() if b not in full}
            # a delta goes when all buckets that came after their base in it are compacted
            oldest = min((after.base.get(b, (-1, 0))[0] for b in range(self.buckets)), default=-1)
            after.deltas = [v for v in after.deltas if v > oldest]
        put(self.spark, f"{self.folder}/manifest-{number + 1}.json", json.dumps({"base": after.base, "gone": after.gone, "deltas": after.deltas}).encode())
        older = Manifest.read(self.spark, self.folder, number - 1).parts() if number > 1 else set()
        for part in (older | {f"delta-{number}"}) - before.parts() - after.parts():
            for name in (*self.tables, "gone"):
                remove(self.spark, f"{self.folder}/{name}/{part}")
        if number > 1:
            # a batch may be repeated, so the manifest before the last two stays
            remove(self.spark, f"{self.folder}/manifest-{number - 2}.json")


def kept(stream: DataFrame, versions: Versions, name: str, table: str) -> DataFrame:
    """Runs a stream of changes over all that is there into versions; a table of the last."""
    last = [0]

    def keep(batch: DataFrame, number: int) -> None:
        versions.keep(batch, number)
        last[0] = number + 1

    ran(stream, name, "append", keep)
    return versions.read(table, last[0])
