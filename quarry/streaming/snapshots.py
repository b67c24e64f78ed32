"""Changes between two snapshots of files, found from the root of their folders down.

Every folder has a hash over its children's names and hashes, so folders with equal hashes hold equal files and nothing
below them is looked at. Hashes are folded upwards a level at a time: a level's groups are combined on the map side by an
exclusive or of 128 bits, so a folder with any number of children is no large group. Levels are written once for each snapshot; a comparison
reads of each level only the children of folders that differ.

Files are (repo, path, content). A path that occurs more than once counts by the greatest hash of its contents, a null path or
repository is one of its own, null content differs from empty. A path may be a file and a folder at once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.checkpoints import cut
from quarry.streaming.changes import CHANGES

#: Folders that differ, up to which a level's files are read by the folders' names, which Parquet's statistics prune.
FEW = 1_000
#: Changed files up to which they are broadcast when their contents are read.
FEW_CHANGES = 1_000_000
#: A name, whether it is a file, its folder, and 128 bits of what it holds.
NODE = ("repo", "parent", "name", "leaf", "a", "b")


def _hashes(*of: str | Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit("a"), *of).alias("a"), F.xxhash64(F.lit("b"), *of).alias("b")


def _key(path: Column) -> Column:
    return F.coalesce(F.concat(F.lit("/"), path), F.lit(""))


def _parent(key: Column) -> Column:
    return F.regexp_replace(key, "/[^/]*$", "")


@dataclass
class Snapshot:
    """The written levels of a snapshot: level 0 has the root of each repository, level n the names in folders of level n - 1."""

    spark: SparkSession
    folder: str
    depth: int

    def level(self, n: int) -> DataFrame:
        none = self.spark.createDataFrame([], "repo string, parent string, name string, leaf boolean, a long, b long")
        return self.spark.read.parquet(f"{self.folder}/level-{n}") if n <= self.depth else none


def written(files: DataFrame, folder: str) -> Snapshot:
    """The levels of files, written to a new folder."""
    spark = files.sparkSession
    key = _key(F.col("path"))
    content = F.coalesce(F.concat(F.lit("="), F.col("content")), F.lit(""))
    held = files.select("repo", key.alias("name"), F.md5(content).alias("md5")).groupBy("repo", "name").agg(F.max("md5").alias("md5"))
    # names of files have their depth in their slashes; a null path lies beside the top folders
    depth = F.greatest(F.length("name") - F.length(F.replace("name", F.lit("/"))), F.lit(1))
    leaves = cut(held.select("repo", _parent(F.col("name")).alias("parent"), "name", F.lit(True).alias("leaf"), *_hashes("md5"), depth.alias("depth")))
    deepest = leaves.agg(F.max("depth")).first()[0] or 0
    below: DataFrame | None = None
    for n in range(deepest, -1, -1):
        here = leaves.where(F.col("depth") == n).select(*NODE)
        if below is not None:
            each = below.select("repo", F.col("parent").alias("name"), *_hashes("name", "leaf", "a", "b"))
            folders = each.groupBy("repo", "name").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
            here = here.unionByName(folders.select("repo", _parent(F.col("name")).alias("parent"), "name", F.lit(False).alias("leaf"), "a", "b"))
        here.repartitionByRange(F.col("parent"), F.col("name")).sortWithinPartitions("parent", "name").write.parquet(f"{folder}/level-{n}")
        below = spark.read.parquet(f"{folder}/level-{n}")
    return Snapshot(spark, folder, deepest if below is not None and leaves.head(1) else -1)


@dataclass
class Compared:
    """(repo, path, op) of what differs, and how many names of either snapshot were compared."""

    changes: DataFrame
    looked: list[int] = field(default_factory=list)


def _under(level: DataFrame, open_: DataFrame, n_open: int) -> DataFrame:
    """The names of a level that lie in open folders (repo, parent)."""
    if n_open <= FEW:
        names = [r.parent for r in open_.select("parent").distinct().collect()]
        level = level.where(F.col("parent").isin(names))
    open_ = open_.select(F.col("repo").alias("_repo"), F.col("parent").alias("_parent"))
    return level.join(F.broadcast(open_) if n_open <= FEW else open_, F.col("repo").eqNullSafe(F.col("_repo")) & (F.col("parent") == F.col("_parent")), "left_semi")


def compared(before: Snapshot, after: Snapshot) -> Compared:
    """upsert for files that are new or have other content, delete for those that are gone."""
    found: list[DataFrame] = []
    out = Compared(before.spark.createDataFrame([], "repo string, path string, op string"))
    open_: DataFrame | None = None
    n_open = 0
    for n in range(max(before.depth, after.depth) + 1):
        old, new = (s.level(n) if open_ is None else _under(s.level(n), open_, n_open) for s in (before, after))
        sides = [df.select(F.col("repo"), "name", "leaf", F.struct("a", "b").alias(side), F.lit(None).cast("struct<a:bigint,b:bigint>").alias(other)) for df, side, other in ((old, "old", "new"), (new, "new", "old"))]
        met = sides[0].unionByName(sides[1]).groupBy("repo", "name", "leaf").agg(F.max("old").alias("old"), F.max("new").alias("new"))
        met = cut(met.withColumn("same", F.col("old").eqNullSafe(F.col("new"))))
        out.looked.append(met.count())
        differs = met.where(~F.col("same"))
        path = F.when(F.col("name") != "", F.substring("name", 2, 2**31 - 1))
        found.append(differs.where("leaf").select("repo", path.alias("path"), F.when(F.col("new").isNull(), "delete").otherwise("upsert").alias("op")))
        open_ = cut(differs.where("NOT leaf").select("repo", F.col("name").alias("parent")))
        n_open = open_.count()
        if not n_open:
            break
    for df in found:
        out.changes = out.changes.unionByName(df)
    return out


def as_changes(compared_: Compared, files: DataFrame, ts: str) -> DataFrame:
    """The changes with the contents of the later files, as changes.CHANGES; contents of other files aren't shuffled if few changed."""
    made = compared_.changes
    few = made.count() <= FEW_CHANGES
    upserts = made.where("op = 'upsert'").select(F.col("repo").alias("_repo"), F.col("path").alias("_path"))
    fits = F.col("repo").eqNullSafe(F.col("_repo")) & F.col("path").eqNullSafe(F.col("_path"))
    content = F.coalesce(F.concat(F.lit("="), F.col("content")), F.lit(""))
    kept = files.join(F.broadcast(upserts) if few else upserts, fits, "left_semi").groupBy("repo", "path").agg(F.max_by("content", F.md5(content)).alias("content"))
    rows = kept.select("repo", "path", F.lit("upsert").alias("op"), F.lit(ts).cast("timestamp").alias("ts"), "content")
    gone = made.where("op = 'delete'").select("repo", "path", "op", F.lit(ts).cast("timestamp").alias("ts"), F.lit(None).cast("string").alias("content"))
    return rows.unionByName(gone).select(*(c.split()[0] for c in CHANGES.split(", ")))
