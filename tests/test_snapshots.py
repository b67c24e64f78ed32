from __future__ import annotations

import random

import pytest

from quarry.plans import snapshot_queries as q
from quarry.streaming import loops, snapshots
from tests.oracle import check

FILES = "repo string, path string, content string"


def wanted(before: list[tuple], after: list[tuple]) -> set[tuple]:
    old, new = ({(r, p): c for r, p, c in rows} for rows in (before, after))
    return {(*k, "upsert", c) for k, c in new.items() if k not in old or old[k] != c} | {(*k, "delete", None) for k in old if k not in new}


def found(spark, folder: str, before: list[tuple], after: list[tuple]) -> tuple[set[tuple], list[int]]:
    later = spark.createDataFrame(after, FILES)
    made = snapshots.compared(snapshots.written(spark.createDataFrame(before, FILES), f"{folder}/before"), snapshots.written(later, f"{folder}/after"))
    rows = snapshots.as_changes(made, later, "2024-01-01").collect()
    assert len(rows) == len({(r.repo, r.path) for r in rows})
    return {(r.repo, r.path, r.op, r.content) for r in rows}, made.looked


ODD = [("r", None, "x"), ("r", "", "x"), ("r", "/", "x"), ("r", "a", "x"), ("r", "a/b", None), ("r", "a/b/", ""), (None, "a/b", "x"), (None, None, None), ("r", "a//b", "x"), ("r", "ü/é", "x")]


@pytest.mark.parametrize("seed", range(3))
def test_as_a_full_comparison(spark, tmp_path, seed):
    """Deep and flat paths, files that are folders too, nulls in every column, folders that come and go."""
    rng = random.Random(seed)
    name = lambda: "/".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
    rows = {(rng.choice(["r", "s", None]), name()): rng.choice(["x", "y", None, ""]) for _ in range(60)}
    before = [(*k, c) for k, c in rows.items()] + [o for o in ODD if (o[0], o[1]) not in rows and rng.random() < 0.7]
    after = [(r, p, c if rng.random() < 0.9 else f"{c}2") for r, p, c in before if rng.random() < 0.9]
    after += [o for o in ODD if (o[0], o[1]) not in {(r, p) for r, p, _ in before}]
    assert found(spark, f"{tmp_path}/s", before, after)[0] == wanted(before, after)


def test_equal_folders_are_not_looked_at(spark, tmp_path):
    before = [("r", f"d{i // 100}/e{i // 10}/f{i}", str(i)) for i in range(2000)]
    after = [(r, p, "new" if p.endswith("/f777") else c) for r, p, c in before]
    changed, looked = found(spark, f"{tmp_path}/s", before, after)
    assert changed == {("r", "d7/e77/f777", "upsert", "new")}
    # the root, 20 folders, ten folders, ten files
    assert looked == [1, 20, 10, 10]
    assert found(spark, f"{tmp_path}/t", before, before)[1] == [1]


def test_empty_and_repeated(spark, tmp_path):
    some = [("r", "a/b", "x")]
    assert found(spark, f"{tmp_path}/a", [], some)[0] == {("r", "a/b", "upsert", "x")}
    assert found(spark, f"{tmp_path}/b", some, [])[0] == {("r", "a/b", "delete", None)}
    assert found(spark, f"{tmp_path}/c", [], [])[0] == set()
    assert found(spark, f"{tmp_path}/d", some * 3, some * 2)[0] == set()
    # the content of the greatest hash counts, in whatever order the rows come
    two = [("r", "a/b", "x"), ("r", "a/b", "y")]
    assert found(spark, f"{tmp_path}/e", two, two[::-1])[0] == set()


def test_sessions(spark):
    rows = [
        ("a", 0, 0, "tick", None, None), ("a", 1, 1, "begin", "g", ["/r/x", "./y", "/r/x"]), ("a", 2, 2, "tick", None, None), ("a", 2, 3, "record", None, ["y", "z", None]),
        ("a", 3, 4, "begin", "other", ["q"]), ("a", 4, 5, "end", None, None), ("a", 5, 6, "tick", None, None), ("a", 6, 7, "record", None, ["late"]), ("a", 7, 8, "end", None, None),
        ("b", 1, 0, "end", None, None), ("b", 2, 1, "begin", None, []), ("b", 3, 2, "tick", None, None), ("c", 1, 0, "tick", None, None),
    ]
    e = spark.createDataFrame(rows, "session string, at int, seq int, op string, goal string, files array<string>")
    assert {tuple(r) for r in loops.sessions(e).select("session", "goal", "iterations", "touched", "closed", "rejected").collect()} == {("a", "g", 1, 2, True, 3), ("b", None, 1, 0, False, 0)}
    assert {tuple(r) for r in loops.session_files(e, "/r/").collect()} == {("a", "x", False, True), ("a", "y", True, False), ("a", "z", True, False)}


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_matches_sql_at_another_size(spark, small, name):
    check(spark, small.replace("sf0.001", "sf0.01"), q.QUERIES[name], q.ORACLES[name])
