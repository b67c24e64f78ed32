from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quarry.plans import state_queries as q
from quarry.streaming import changes, leases
from tests.oracle import check

@pytest.mark.parametrize("name", ["lease_timeline", "stream_lease_timeline"])
def test_matches_sql_with_several_batches(spark, small, name):
    check(spark, small.replace("sf0.001", "sf0.01"), q.QUERIES[name], q.ORACLES[name])


def at(s: float) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def rows(df) -> list[str]:
    return sorted(repr(tuple(r)) for r in df.collect())


def slow_timeline(events: list[tuple], ttl: float) -> list[tuple]:
    """One moment after the other, in milliseconds, for all paths; events: (s, op, path, who, seconds)."""
    claimed = {(p, w) for _, op, p, w, _ in events if op == "claim"}
    dealt = [e for e in events if e[1] != "done"] + [(s, "end", p, w, None) for s, op, _, w, _ in events if op == "done" for p, v in claimed if v == w]
    last, held, waits, out = max(e[0] for e in events), {}, [], []
    moments = sorted({e[0] for e in dealt} | {e[0] + ttl for e in dealt} | {e[0] + e[4] for e in dealt if e[4] is not None})

    def free(t, path):
        held.pop(path)
        for w in [w for w in waits if w[1] == path]:
            waits.remove(w)
            out.append((path, at(t), "wait", w[2], "ready", None))

    for t in (m for m in moments if m <= last):
        for path, (who, until) in list(held.items()):
            if until <= t:
                out.append((path, at(until), "expire", who, "expired", None))
                free(t, path)
        for _, op, path, who, seconds in sorted((e for e in dealt if e[0] == t), key=lambda e: (e[1], e[3])):
            now = held.get(path, (None, 0))[0]
            if op == "claim":
                ok = now in (None, who)
                if ok:
                    held[path] = (who, t + ttl)
                out.append((path, at(t), op, who, "ok" if ok else "held", held[path][0]))
            elif op == "wait":
                if now is None or now == who:
                    out.append((path, at(t), op, who, "ready" if now is None else "deadlock", now))
                else:
                    waits.append((t + seconds, path, who))
            elif now == who:
                out.append((path, at(t), op, who, "ok", None))
                free(t, path)
            elif op == "release":
                out.append((path, at(t), op, who, "none" if now is None else "held", now))
        for w in [w for w in waits if w[0] <= t]:
            waits.remove(w)
            out.append((w[1], at(w[0]), "wait", w[2], "timeout", held[w[1]][0]))
    return sorted(map(repr, out))


@pytest.mark.parametrize("seed", [1, 2])
def test_timelines_against_moments(spark, seed):
    """Ties of time, waits that end as a lease goes, ends of sessions in other batches than their claims."""
    rng = random.Random(seed)
    events = []
    for _ in range(250):
        op = rng.choice(["claim", "claim", "release", "wait", "done"])
        events.append((rng.randint(0, 120), op, None if op == "done" else rng.choice("xyz"), rng.choice("abc"), float(rng.choice([0, 2, 5])) if op == "wait" else None))
    events = list(dict.fromkeys(events))
    df = spark.createDataFrame([(at(s), *r) for s, *r in events], leases.EVENTS)
    want = slow_timeline(events, 4)
    assert rows(leases.timeline(df, 4)) == want
    out = changes.ran(leases.streamed(changes.in_batches(df, "ts", 5), 4), "t", conf=leases.ROCKSDB)
    assert rows(spark.read.schema(leases.ROWS).parquet(out)) == want


def test_expiry_without_a_further_event_of_its_path(spark):
    """A lease expires and its waiter is told while only another path has events; late events are dropped."""
    batches = [[(at(0), "claim", "x", "a", None), (at(1), "wait", "x", "b", 100.0), (at(1), "wait", "x", "c", 3.0)], [(at(5), "claim", "y", "a", None)], [(at(30), "claim", "y", "b", None)], [(at(2), "release", "x", "a", None), (at(31), "release", "y", "b", None)]]
    folder = f"{changes.shared_dir(spark)}/expiry-{random.random()}"
    for b in batches:
        spark.createDataFrame(b, leases.EVENTS).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(leases.EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
    out = changes.ran(leases.streamed(stream, 10), "t", conf=leases.ROCKSDB)
    found = {tuple(r) for r in spark.read.schema(leases.ROWS).parquet(out).collect()}
    assert found == {("x", at(0), "claim", "a", "ok", "a"), ("x", at(4), "wait", "c", "timeout", "a"), ("y", at(5), "claim", "a", "ok", "a"), ("x", at(10), "expire", "a", "expired", None), ("x", at(10), "wait", "b", "ready", None), ("y", at(15), "expire", "a", "expired", None), ("y", at(30), "claim", "b", "ok", "b"), ("y", at(31), "release", "b", "ok", None)}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != leases.ROCKSDB["spark.sql.streaming.stateStore.providerClass"]


def test_no_events(spark):
    assert leases.timeline(spark.createDataFrame([], leases.EVENTS)).count() == 0


def test_ends_go_only_to_paths_that_a_claim_may_hold():
    """Sessions share calls of the state store, and an end isn't dealt to paths whose lease is over by its ttl (before: to all that were ever claimed)."""
    import json
    from types import SimpleNamespace as Fake

    import pandas as pd

    class Value:
        kept = None
        get = lambda self: self.kept
        exists = lambda self: self.kept is not None

        def update(self, value):
            self.kept = value

        def clear(self):
            self.kept = None

    def frame(*events):
        return pd.DataFrame([(at(s), op, path, who, None) for s, op, path, who in events], columns=["ts", "op", "path", "block_key", "seconds"])

    def ends(found):
        return sorted((r.path, r.block_key, (r.ts - at(0)).total_seconds()) for part in found for r in part.itertuples() if r.op == "end")

    state = Value()
    dealer = leases.Dealer(4)
    dealer.init(Fake(getValueState=lambda name, schema: state))
    call = lambda passed, *events: ends(dealer.handleInputRows((1,), iter([frame(*events)]), Fake(getCurrentWatermarkInMs=lambda: int((at(passed) - dt.datetime(1970, 1, 1)).total_seconds() * 1000))))
    assert call(0, (1, "claim", "x", "a"), (20, "claim", "y", "a"), (22, "done", None, "a"), (22, "done", None, "b")) == [("y", "a", 22)]
    # an end that the watermark hasn't passed reaches a path that is claimed in a later batch
    assert call(10, (19, "claim", "z", "a"), (21, "claim", "z", "b")) == [("z", "a", 22), ("z", "b", 22)]
    assert [who for who, _, _ in json.loads(state.kept[0])] == ["a", "b"]
    assert call(30, (31, "done", None, "a")) == []
    assert "x" not in state.kept[0] and "22" not in state.kept[0]


def test_batches_of_several_files(spark, monkeypatch):
    """A batch that is large is written by several tasks, and each batch is still taken whole and in order, an empty one too."""
    monkeypatch.setattr(changes, "FILE_ROWS", 20, raising=False)
    df = spark.range(100).selectExpr("CASE WHEN id < 98 THEN id ELSE 1000 * id END AS id")
    seen = []
    changes.ran(changes.in_batches(df, F.col("id"), 3), "files", keep=lambda b, n: seen.append((sorted(r.id for r in b.collect()), b.rdd.getNumPartitions())))
    assert [x for x, _ in seen if x] == [list(range(98)), [98000, 99000]]
    assert max(n for _, n in seen) > 1
