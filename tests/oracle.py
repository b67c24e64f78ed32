"""Holds a query against its SQL, as rows without order."""

from __future__ import annotations

import glob
import os

import duckdb


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([plain(r[i]) for i in order]) for r in found)


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def check(spark, sf_dir: str, query, sql: str) -> None:
    df = query(spark, sf_dir)
    result = database(sf_dir).execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, result.fetchall())
