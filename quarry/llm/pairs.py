"""A pair of tables in common buckets, planned from metadata.

Two tables that are joined on one key lie in numbered files: one by some layout of its own,
the other too. `rebucketed` lays both out again, one file for each table and bucket, so
that buckets can be joined file by file without a shuffle.

Only keys are read to plan this. An aggregation gives each table's contingency matrix,
(starting file, bucket, rows). A file whose row of the matrix has one entry, in a column
that has one entry too, holds exactly a bucket's rows: it stays where it is. All other
files are the listed sources of all other buckets: these alone are read whole, dealt by
bucket and sorted. Afterwards the starting files that don't stay are removed.

Nothing that grows with the tables reaches the driver, a broadcast or one task, but for the
rows of one file, which are sorted with spills and written as a stream. The matrices have
at most files x buckets rows, and only the files that stay are listed on the driver. Which
rows of the second table have no partner is found by a join with one row for each key;
keys with over a thousandth of the rows, fewer than a thousand, are joined apart, and
their rows stay spread until their file is written. Digests of a file's keys in order are
taken from text that many tasks spell, a stretch of rows each; one task a file only hashes.

Keys are integers. Buckets: crc32 of SALT and the decimal key; keys of the second table that
the first lacks have a bucket of their own, null keys (of either table) the next. Rows are
sorted by key descending, then by all other columns from left to right, ascending, nulls
first in both; equal rows are alike. Columns of a type without an order (maps) aren't
sorted by. Repeated rows stay, repeated keys count in the join as often as they meet.
Files hold the columns of their table, whatever their names. Very long texts stay whole.
An empty table has no files.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarry.llm.common import cut, map_arrow, remove, shared_dir, table
from quarry.llm.graph import matched

BUCKETS, SALT = 150, "pair"

Number = Callable[[Column], Column]


@dataclass(frozen=True)
class Side:
    """One table of the pair in its folder: the column that numbers its starting files, and how many there are at most."""

    name: str
    folder: str
    schema: T.StructType
    key: str


def crc(value: Column, salt: str = "") -> Column:
    return F.crc32(F.concat(F.lit(salt), value.cast("string")).cast("binary"))


def raw_bucket(key: Column, buckets: int = BUCKETS, salt: str = SALT) -> Column:
    """The bucket of a key that the first table has, or of a null key."""
    return F.when(key.isNull(), buckets + 1).otherwise(crc(key, salt) % buckets).cast("int")


def _order(schema: T.StructType, key: str) -> list[Column]:
    row = lambda c: F.col("row").getField(c)
    rest = [f.name for f in schema if f.name != key and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return [row(key).desc_nulls_first(), *(row(c).asc_nulls_first() for c in rest)]


def _write(rows: DataFrame, side: Side, files: int) -> None:
    """rows: (number, row). One sorted file for each number below `files` that has rows; the task's number in a file's name is that number."""
    dealt = rows.repartitionById(files, F.col("number")).sortWithinPartitions(*_order(side.schema, side.key))
    dealt.select("row.*").write.mode("append").option("maxRecordsPerFile", 0).parquet(side.folder)


def _listed(spark: SparkSession, folder: str) -> dict[str, int]:
    """Data files of a folder: path -> number."""
    found = spark.read.format("binaryFile").load(folder).select("path", F.regexp_extract("path", r"part-(\d+)-[^/]*$", 1).cast("int").alias("number"))
    return {r.path: r.number for r in found.collect()}


def _read(spark: SparkSession, side: Side, paths: list[str]) -> DataFrame:
    """(number, row, name) of starting or final files."""
    df = spark.read.schema(side.schema).parquet(*paths)
    at = df.metadataColumn("_metadata")
    number = F.regexp_extract(at.getField("file_name"), r"part-(\d+)-", 1).cast("int")
    return df.select(number.alias("number"), F.struct(*(df[f"`{c}`"] for c in side.schema.names)).alias("row"))


def started(df: DataFrame, name: str, folder: str, key: str, number: Column, files: int) -> Side:
    """df written to numbered files of a new folder."""
    side = Side(name, f"{folder}/{name}", df.schema, key)
    _write(df.select(number.alias("number"), F.struct(*(df[f"`{c}`"] for c in df.columns)).alias("row")), side, files)
    return side


def _bucketed(rows: DataFrame, key: str, keys: DataFrame, total: int) -> DataFrame:
    """rows (number, row) with their bucket; keys: key, lines, bucket of all keys of these rows."""
    keyed = rows.withColumn("key", F.col("row").getField(key))
    known = matched(keyed.where("key IS NOT NULL"), keys.select("key", "lines", "bucket"), "key", "lines", total)
    null = keyed.where("key IS NULL").withColumn("bucket", raw_bucket(F.col("key")))
    return known.select("number", "row", "bucket").unionByName(null.select("number", "row", "bucket"))


def matrix(bucketed: DataFrame) -> DataFrame:
    """(number, bucket, n) of rows in starting files."""
    return bucketed.groupBy("number", "bucket").agg(F.count("*").alias("n"))


def planned(cells: DataFrame) -> DataFrame:
    """cells with `stays`: its file holds nothing else, and its bucket lies nowhere else. Cells are bounded by files x buckets."""
    alone = lambda c: F.count("*").over(Window.partitionBy(c)) == 1
    return cells.withColumn("stays", alone("number") & alone("bucket"))


def _rewritten(spark: SparkSession, side: Side, plan: DataFrame, bucketed: Callable[[DataFrame], DataFrame], buckets: int) -> dict[str, tuple[int, bool]]:
    """Writes the final files that don't stay and removes their sources. Final files: path -> (bucket, rewritten)."""
    begun = _listed(spark, side.folder)
    stay = {r.number: r.bucket for r in plan.where("stays").select("number", "bucket").collect()}
    full = {r.number for r in plan.select("number").distinct().collect()}
    filled = {r.bucket for r in plan.select("bucket").distinct().collect()}
    sources = [p for p, n in begun.items() if n in full and n not in stay]
    if sources:
        _write(bucketed(_read(spark, side, sources)).select(F.col("bucket").alias("number"), "row"), side, buckets + 2)
    final = {}
    for path, number in _listed(spark, side.folder).items():
        if path in begun and number in stay and number in full:
            final[path] = (stay[number], False)
        elif path not in begun and number in filled:
            final[path] = (number, True)
        else:
            # a source that has been rewritten, or a file without rows
            remove(spark, path)
    return final


_SPELLED = "name string, path string, first long, n long, ids string"


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of consecutive rows of a file: the first row's index, the number of rows, and the keys as text."""
    for b in batches:
        if not b.num_rows:
            continue
        names, paths, at = b.column(0), b.column(1), b.column(2).to_numpy()
        ids = pc.fill_null(b.column(3), "").to_pylist()
        same = pc.equal(names.slice(1), names.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False) & (at[1:] == at[:-1] + 1)
        edges = [0, *(i + 1 for i in (~same).nonzero()[0].tolist()), b.num_rows]
        cuts = list(zip(edges, edges[1:], strict=False))
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[i].as_py() for i, _ in cuts], pa.string()), pa.array([paths[i].as_py() for i, _ in cuts], pa.string()), pa.array([int(at[i]) for i, _ in cuts], pa.int64()), pa.array([j - i for i, j in cuts], pa.int64()), pa.array([",".join(ids[i:j]) for i, j in cuts], pa.string())],
            names=["name", "path", "first", "n", "ids"],
        )


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and digest of each file, from its stretches in order. A missing stretch raises."""

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([path]), pa.array([rows], pa.int64()), pa.array([sha.hexdigest()])], names=["name", "path", "n_rows", "ids_sha256"])

    name, path, rows, sha = None, None, 0, hashlib.sha256()
    for b in batches:
        for new, at, first, n, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if new != name:
                if name is not None:
                    yield done()
                name, path, rows, sha = new, at, 0, hashlib.sha256()
            if first != rows:
                raise ValueError(f"{path}: row {rows} is missing")
            sha.update(("," * (rows > 0) + ids).encode())
            rows += n
    if name is not None:
        yield done()


def described(spark: SparkSession, side: Side, paths: list[str]) -> DataFrame:
    """(name, path, n_rows, ids_sha256) of files, read back."""
    df = spark.read.schema(side.schema).parquet(*paths)
    at = df.metadataColumn("_metadata")
    rows = df.select(at.getField("file_name").alias("name"), at.getField("file_path").alias("path"), at.getField("row_index").alias("first"), df[f"`{side.key}`"].cast("string").alias("ids"))
    spelled = map_arrow(rows, _spell, _SPELLED)
    return map_arrow(spelled.repartition("name").sortWithinPartitions("name", "first"), _hash, "name string, path string, n_rows long, ids_sha256 string")


_FINAL = "table_name string, name string, bucket int, rewritten boolean, columns string"


def rebucketed(first: Side, second: Side, buckets: int = BUCKETS, salt: str = SALT) -> DataFrame:
    """Both tables, started in numbered files, laid out as one file for each bucket. A row for each final file."""
    spark = SparkSession.getActiveSession()
    own = lambda rows: rows.withColumn("bucket", raw_bucket(F.col("row").getField(first.key), buckets, salt))
    all_of = lambda side: _read(spark, side, list(_listed(spark, side.folder)) or [side.folder])
    key_of = lambda side: F.col("row").getField(side.key).alias("key")
    one = all_of(first).groupBy(key_of(first)).agg(F.count("*").alias("rows"))
    two = all_of(second).groupBy(key_of(second)).agg(F.count("*").alias("lines")).where("key IS NOT NULL")
    keys = two.join(one, "key", "left").withColumn("bucket", F.when(F.col("rows").isNull(), buckets).otherwise(raw_bucket(F.col("key"), buckets, salt)).cast("int"))
    keys = cut(keys)
    total = keys.agg(F.coalesce(F.sum("lines"), F.lit(0))).first()[0]
    partnered = lambda rows: _bucketed(rows, second.key, keys, total)
    met = keys.groupBy("bucket").agg(F.sum(F.col("lines") * F.coalesce("rows", F.lit(0))).alias("n_joined"))
    out, final, lineage = [], [], []
    for side, bucketed in ((first, own), (second, partnered)):
        plan = cut(planned(matrix(bucketed(all_of(side)))))
        files = _rewritten(spark, side, plan, bucketed, buckets)
        final += [(side.name, path.rpartition("/")[2], bucket, new, ",".join(side.schema.names)) for path, (bucket, new) in files.items()]
        if files:
            out.append(described(spark, side, list(files)).withColumn("table_name", F.lit(side.name)))
        spelled = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "n"))), lambda x: F.concat_ws(":", x["number"], x["n"])), ",")
        lineage.append(plan.groupBy("bucket").agg(spelled.alias("lineage"), F.sum("n").alias("planned")).withColumn("table_name", F.lit(side.name)))
    named = spark.createDataFrame(final, _FINAL)
    if not out:
        out = [spark.createDataFrame([], "name string, path string, n_rows long, ids_sha256 string, table_name string")]
    found = out[0].unionByName(out[1]) if len(out) > 1 else out[0]
    # a row for each file, at most two for each bucket
    report = found.join(F.broadcast(named), ["table_name", "name"]).join(lineage[0].unionByName(lineage[1]), ["table_name", "bucket"]).join(met, "bucket", "left")
    whole = F.when(F.col("n_rows") == F.col("planned"), F.col("n_rows")).otherwise(F.raise_error(F.concat(F.lit("rows are missing in "), "path")).cast("long"))
    return report.select("table_name", "path", "columns", "ids_sha256", "lineage", F.col("bucket").cast("long").alias("bucket"), whole.alias("n_rows"), F.coalesce("n_joined", F.lit(0)).cast("long").alias("n_joined"), "rewritten")


def op11_contingency_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/pair-{uuid.uuid4().hex}"
    sales, lines = table(spark, sf_dir, "sales"), table(spark, sf_dir, "sale_lines")
    bucket = raw_bucket(F.col("sale_id"))
    first = started(sales, "sales", folder, "sale_id", F.when(bucket % 5 == 1, bucket - 1).otherwise(bucket), BUCKETS + 2)
    second = started(lines, "sale_lines", folder, "sale_id", F.coalesce(crc(F.col("item_id")) % BUCKETS, F.lit(0)).cast("int"), BUCKETS)
    report = rebucketed(first, second)
    return report.withColumn("lineage_sha256", F.sha2(F.col("lineage").cast("binary"), 256)).drop("lineage")


QUERIES = {"op11_contingency_pair": op11_contingency_pair}
ORACLES: dict[str, str] = {}
