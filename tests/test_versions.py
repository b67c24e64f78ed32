from __future__ import annotations

import datetime as dt
import os
import random

import pytest

from quarry.operators import extract
from quarry.plans import source_queries, state_queries
from quarry.streaming import changes, versions
from tests.oracle import check


def size(folder: str, part: str = "") -> int:
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet") and part in d)


def batches(n: int, files: int, each: int) -> list[list[tuple]]:
    """The first batch has all files; deletes, repeats within a batch, files that come back."""
    rng = random.Random(n)
    at = dt.datetime(2024, 1, 1)
    out = [[("r", f"p{i}.py", "upsert", at, f"def f_{i}():\n    pass\n") for i in range(files)]]
    for b in range(1, n):
        out.append([(rng.choice("rq"), f"p{rng.randrange(files)}.py", rng.choice(["upsert", "upsert", "delete"]), at + dt.timedelta(seconds=b * 100 + k // 2), f"def g_{b}_{k}():\n    pass\ndef h():\n    pass\n") for k in range(each)])
    return out


def expected(done: list[list[tuple]]) -> dict:
    live: dict = {}
    for b in done:
        last: dict = {}
        for repo, path, op, ts, content in b:
            last[repo, path] = max(last.get((repo, path), (dt.datetime.min, "", "")), (ts, op, content))
        for key, (_, op, content) in last.items():
            live.pop(key, None)
            if op != "delete":
                live[key] = content
    return live


@pytest.mark.parametrize(("least", "share"), [(1_000, 0.5), (0, 0.5), (2, 0.0), (5, 3.0)])
def test_versions_against_a_dictionary(spark, tmp_path, least, share):
    """Without compaction, with it after each batch, for some buckets, seldom; every batch is repeated."""
    kept = versions.Versions(spark, f"{tmp_path}/v", {"symbols": extract.symbols}, buckets=4, least=least, share=share)
    made = batches(5, 30, 12)
    for n, rows in enumerate(made):
        df = spark.createDataFrame(rows, changes.CHANGES)
        for _ in range(2):
            kept.keep(df, n)
        want = expected(made[: n + 1])
        assert {(r.repo, r.path): r.content for r in kept.read("files", n + 1).collect()} == want
        names = sorted((r.repo, r.path, r.name) for r in kept.read("symbols", n + 1).collect())
        assert names == sorted((*k, line[4:-3]) for k, c in want.items() for line in c.split("\n") if line.startswith("def "))
    # the version before is still there
    assert {(r.repo, r.path): r.content for r in kept.read("files", 4).collect()} == expected(made[:4])


def test_bytes_follow_the_batch(spark, tmp_path):
    """A batch of ten changes of a large table writes a small part of its bytes; parts that no version names go."""
    kept = versions.Versions(spark, f"{tmp_path}/v", {"symbols": extract.symbols}, buckets=8, least=100)
    made = batches(6, 20_000, 10)
    before = 0
    for n, rows in enumerate(made):
        kept.keep(spark.createDataFrame(rows, changes.CHANGES).coalesce(1), n)
        if not n:
            before = size(f"{tmp_path}/v")
        else:
            assert size(f"{tmp_path}/v", f"delta-{n}") < before / 10 and size(f"{tmp_path}/v", f"base-{n}") == 0
    assert kept.read("files", 6).count() == len(expected(made))
    assert not os.path.exists(f"{tmp_path}/v/files/delta-0") and os.path.exists(f"{tmp_path}/v/files/base-0")


@pytest.mark.parametrize(("name", "of"), [("stream_upserts", state_queries), ("stream_index", source_queries)])
def test_streams_match_sql(spark, small, name, of):
    check(spark, small, of.QUERIES[name], of.ORACLES[name])
