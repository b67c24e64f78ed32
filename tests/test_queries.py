from __future__ import annotations

import pytest

from quarry.plans import registry
from tests.oracle import check

ORACLES = registry.oracle_sql()
QUERIES = registry.queries()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, small, name):
    check(spark, small, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_lock_fold_is_the_same_in_batch_and_as_a_stream(spark, small):
    from quarry.plans import state_queries as q

    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(q.lock_fold(spark, small)) == rows(q.stream_locks(spark, small))


def test_stream_of_several_batches_deals_ends_of_sessions(spark, tmp_path):
    """Three batches: an end in a later batch frees what the session claimed before."""
    import datetime as dt

    from quarry.streaming import changes, locks

    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(at(1), "claim", "x", "a"), (at(2), "claim", "y", "a"), (at(3), "claim", "x", "b")], [(at(5), "done", None, "a"), (at(6), "claim", "x", "b")], [(at(7), "release", "x", "a"), (at(9000), "claim", "y", "c"), (at(9001), "claim", "x", "c")]
    schema = "ts timestamp, op string, path string, block_key string"
    for i, batch in enumerate(rows):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    every = spark.createDataFrame([r for b in rows for r in b], schema)
    keep = locks.maintain(every, f"{tmp_path}/out")
    for i in range(3):
        # a repeated batch gives the same
        for _ in range(2):
            keep(spark.read.parquet(f"{tmp_path}/in/{i}"), i)
    names = ["path", "ts", "op", "block_key", "result", "held_by"]
    rows_of = lambda df: sorted(map(repr, df.select(*names).collect()))
    assert rows_of(spark.read.parquet(f"{tmp_path}/out/results-*")) == rows_of(locks.folded(every))
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/v3/leases").select("path", "holder").collect()} == {("x", "c"), ("y", "c")}
    assert changes.latest(every.selectExpr("'r' AS repo", "path", "op", "ts", "block_key AS content")).count() == 3
