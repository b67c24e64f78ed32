from __future__ import annotations

import datetime as dt
import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq

from quarry.llm import graph, pairs

SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"
LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz"


def plain(path: str) -> str:
    return "/" + path.removeprefix("file:").lstrip("/")


def in_order(rows: list[tuple]) -> list[tuple]:
    """Key descending, then ascending, nulls first, strings by bytes."""
    rest = lambda v: (v is not None, v.encode() if isinstance(v, str) else v if v is not None else 0)
    return sorted(rows, key=lambda r: ((r[0] is not None, -r[0] if r[0] is not None else 0), [rest(v) for v in r[1:]]))


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def expected(sales: list[tuple], lines: list[tuple]) -> dict[tuple[str, int], tuple]:
    """(table, bucket) -> rows in order, digests, rows that meet, whether it is rewritten."""
    known, met = Counter(r[0] for r in sales if r[0] is not None), Counter()
    bucket = lambda k, one: 151 if k is None else 150 if one and k not in known else zlib.crc32(f"pair{k}".encode()) % 150
    for r in lines:
        if known[r[0]]:
            met[bucket(r[0], False)] += known[r[0]]
    out = {}
    for name, rows in (("sales", sales), ("sale_lines", lines)):
        final, start = defaultdict(list), defaultdict(list)
        for r in rows:
            b = bucket(r[0], name == "sale_lines")
            s = (b - 1 if b % 5 == 1 else b) if name == "sales" else 0 if r[2] is None else zlib.crc32(str(r[2]).encode()) % 150
            final[b].append(r)
            start[s].append((b, r))
        for b, held in final.items():
            count = Counter(s for s, there in start.items() for x, _ in there if x == b)
            lineage = ",".join(f"{s}:{n}" for s, n in sorted(count.items()))
            stays = len(count) == 1 and len(start[next(iter(count))]) == len(held)
            rows_in_order = in_order(held)
            out[name, b] = (rows_in_order, sha(",".join("" if r[0] is None else str(r[0]) for r in rows_in_order)), sha(lineage), met[b], not stays)
    return out


def verify(spark, folder: str, sales: list[tuple], lines: list[tuple]) -> list:
    found = pairs.op11_contingency_pair(spark, folder).collect()
    want = expected(sales, lines)
    assert {(r.table_name, r.bucket) for r in found} == set(want) and len(found) == len(want)
    for r in found:
        rows, ids, lineage, met, new = want[r.table_name, r.bucket]
        assert (r.n_rows, r.ids_sha256, r.lineage_sha256, r.n_joined, r.rewritten) == (len(rows), ids, lineage, met, new)
        data = pq.ParquetFile(plain(r.path)).read()
        assert r.columns == ",".join(data.column_names)
        assert list(zip(*(c.to_pylist() for c in data.columns), strict=True))[: len(rows)] == rows and data.num_rows == len(rows)
    if found:
        top = os.path.dirname(os.path.dirname(plain(found[0].path)))
        left = {os.path.join(d, f) for d, _, names in os.walk(top) for f in names if f.endswith(".parquet")}
        assert left == {plain(r.path) for r in found}
    return found


def odd_tables() -> tuple[list[tuple], list[tuple]]:
    """Nulls, repeated sales and lines, keys without a sale, ties, negative keys, and a sale of a third of all lines."""
    rng = random.Random(4)
    at = lambda: rng.choice([None, dt.datetime(2024, 1, rng.randint(1, 28), 3, 4, 5, 678901)])
    sales = [(k, rng.choice([None, 1, 2]), rng.choice([None, "", "done", "Zürich", "zz", "�", "😀"]), rng.choice([None, -1.5, 2.0]), at(), at(), rng.choice([None, 3])) for k in [*range(-40, 300), *range(0, 40), None, None]]
    sales += sales[:5] + sales[-1:]
    lines = [(rng.choice([7, rng.randint(-60, 330), rng.randint(-60, 330), None] if i % 9 == 0 else [7, rng.randint(-60, 330), rng.randint(-60, 330)]), rng.choice([None, 1, 2]), rng.choice([None, rng.randint(-5, 400)]), None, i % 3, 1.0, None, rng.choice(["kept", None]), at()) for i in range(4_000)]
    return sales, lines + lines[:50]


def write(spark, folder: str, sales: list[tuple], lines: list[tuple]) -> str:
    spark.createDataFrame(sales, SALES).repartition(3).write.parquet(f"{folder}/sales.parquet")
    spark.createDataFrame(lines, LINES).repartition(3).write.parquet(f"{folder}/sale_lines.parquet")
    return folder


def test_given_tables(spark, small):
    read = lambda t: [tuple(r) for r in spark.read.parquet(f"{small}/{t}.parquet").collect()]
    found = verify(spark, small, read("sales"), read("sale_lines"))
    assert any(not r.rewritten for r in found) and any(r.rewritten for r in found)


def test_odd_tables_with_a_hot_sale(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(graph, "FLOOR", 50)
    sales, lines = odd_tables()
    assert verify(spark, write(spark, str(tmp_path), sales, lines), sales, lines)


def test_files_of_any_number_stay(spark, tmp_path):
    """Lines of one item and one bucket stay in their item's file; sales without an id in file 150."""
    item = next(i for i in range(10_000) if zlib.crc32(str(i).encode()) % 150 == 149)
    other = next(i for i in range(10_000) if zlib.crc32(str(i).encode()) % 150 == 3)
    sales = [(5, None, "a", 1.0, None, None, 1), (None, 1, "b", 1.0, None, None, 1)]
    lines = [(5, 1, item, 1, 1, 1.0, 0.0, "x", None)] * 3 + [(6, 1, other, 1, 1, 1.0, 0.0, "x", None), (None, 1, None, 1, 1, 1.0, 0.0, "x", None)]
    found = verify(spark, write(spark, str(tmp_path), sales, lines), sales, lines)
    assert not any(r.rewritten for r in found) and len(found) == 5


def test_extra_columns_and_empty_tables(spark, tmp_path):
    sales, lines = odd_tables()
    for name, schema, rows in (("sales", SALES, sales[:50]), ("sale_lines", LINES, [])):
        df = spark.createDataFrame(rows, schema)
        for c in ("number", "row", "key", "bucket", "_hot", "_salt", "_metadata", "name", "n", "path", "lines"):
            df = df.withColumn(c, df["sale_id"])
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    found = pairs.op11_contingency_pair(spark, str(tmp_path)).collect()
    assert sum(r.n_rows for r in found) == 50 and {r.table_name for r in found} == {"sales"} and all(r.columns.endswith("path,lines") for r in found)
    empty = write(spark, f"{tmp_path}/empty", [], [])
    assert pairs.op11_contingency_pair(spark, empty).collect() == []
