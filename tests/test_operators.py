from __future__ import annotations

import datetime as dt
import json
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from quarry.functions import paths, scores, text
from quarry.operators import docs, extract, graph, intel, packages, search, security
from quarry.plans.catalog import Catalog
from quarry.plans.fixtures import files
from quarry.sources import config, repos, sinks
from quarry.streaming import locks, loops


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("word", "expected"),
    [("userLogin", ["user", "Login"]), ("user_login", ["user", "login"]), ("HTTPServer", ["HTTP", "Server"]), ("a1b", ["a1", "b"]), ("src/auth-x.rs", ["src", "auth", "x", "rs"]), ("__", ["__"]), ("", [])],
)
def test_parts(spark, word, expected):
    assert one(spark, text.parts, word) == expected


@pytest.mark.parametrize(("word", "expected"), [("authentication", "authentic"), ("houses", "hous"), ("cat", "cat"), ("bees", "bee"), ("quickly", "quick"), ("darkness", "darknes")])
def test_stem(spark, word, expected):
    assert one(spark, text.stem, word) == expected


def test_tokens_repeat_prefixes(spark):
    assert sorted(one(spark, text.tokens, "the login to çay x ç")) == sorted(["logi", "login", "çay", "ç"])


@pytest.mark.parametrize(("value", "expected"), [("a\r\nb\n", ["a", "b"]), ("a\n\n", ["a", ""]), ("", []), ("a", ["a"])])
def test_lines(spark, value, expected):
    assert one(spark, text.lines, value) == expected


@pytest.mark.parametrize(("value", "expected"), [("a/../b/./c", "b/c"), ("../x", "x"), ("a//b", "a/b")])
def test_normalised(spark, value, expected):
    assert one(spark, paths.normalised, value) == expected


def test_with_extension_replaces_the_last_one(spark):
    assert one(spark, lambda c: paths.with_extension(c, "ts"), "x/a.b") == "x/a.ts"
    assert one(spark, lambda c: paths.with_extension(c, "ts"), "x/a") == "x/a.ts"


def test_hop_scores(spark):
    edges = spark.createDataFrame([("auth", "db"), ("db", "pool"), ("auth", "jwt"), ("unrelated", "other")], "src string, dst string")
    found = {r["node"]: r["score"] for r in graph.hop_scores(edges, ["auth"]).collect()}
    assert found == {"auth": 1.0, "db": 0.5, "jwt": 0.5, "pool": 0.25, "unrelated": 0.1, "other": 0.1}
    assert {r["node"]: r["score"] for r in graph.hop_scores(edges, ["db"], True).collect()}["auth"] == 0.5


def test_shortest_path(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("a", "b2"), ("b2", "c")], "src string, dst string")
    assert [r["node"] for r in graph.shortest_path(edges, "a", "c").orderBy("place").collect()] == ["a", "b", "c"]
    assert graph.shortest_path(edges, "a", "y").count() == 0
    assert graph.shortest_path(edges, "a", "c", 1).count() == 0


def test_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "f")], "src string, dst string")
    assert {r["node"] for r in graph.cycle_members(edges).collect()} == {"a", "b", "c", "f"}
    assert graph.cycle_members(edges.where("src = 'a'")).count() == 0


def test_callers_reach_by_fewest_steps(spark):
    calls = spark.createDataFrame([("f", "login", "g", "find"), ("f", "main", "f", "login"), ("g", "find", "f", "main")], "caller_file string, caller_sym string, callee_file string, callee_name string")
    assert [(r["symbol"], r["hop"]) for r in graph.call_neighbours(calls, "find", True, 2).collect()] == [("login", 1), ("main", 2)]


def test_bm25_soft_match_counts_prefixes(spark):
    rows = spark.createDataFrame([(1, "login page"), (2, "logins and logs"), (3, "nothing")], "doc_id long, text string")
    index = search.build(rows)
    assert {r["doc_id"] for r in search.bm25(index, "login").collect()} == {1, 2}
    assert search.bm25(index, "zebra").count() == 0


def test_bm25_of_empty_documents(spark):
    index = search.build(spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string"))
    assert search.bm25(index, "login").count() == 0


def test_python_methods_are_no_symbols(spark):
    names = [r["name"] for r in extract.symbols(files(spark, "kitchen")).collect()]
    assert "open" not in names and "Jar" in names


def test_impact_tiers(spark):
    rows = [(11, 0, 0, False), (0, 0, 0, True), (4, 0, 0, False), (1, 0, 0, False), (1, 11, 0, False)]
    df = spark.createDataFrame(rows, "r int, f int, d int, h boolean")
    assert [r["t"] for r in df.select(intel.impact_tier(F.col("r"), F.col("f"), F.col("d"), F.col("h")).alias("t")).collect()] == ["high", "high", "medium", "low", "high"]


def test_risk_grows_with_features(spark):
    df = spark.createDataFrame([(1.0, 0.0), (20.0, 1.0)], "a double, b double")
    p = [r["p"] for r in df.select(scores.risk_probability(F.col("a"), F.col("a"), F.col("a"), F.col("b"), F.col("a"), F.col("b")).alias("p")).collect()]
    assert p[0] < p[1]


def test_layers(spark):
    edges = spark.createDataFrame([("src/domain/a.rs", "src/infra/b.rs"), ("src/infra/b.rs", "src/domain/a.rs")], "src string, dst string")
    layers = [("domain", ["src/domain/**"]), ("infra", ["src/infra/**"])]
    assert [r["src"] for r in intel.violations(edges, layers, [("domain", "infra")]).collect()] == ["src/domain/a.rs"]
    allowed = intel.violations(edges, layers, [], [("infra", "domain")]).collect()
    assert [(r["src"], r["reason"]) for r in allowed] == [("src/domain/a.rs", "not allowed")]


@pytest.mark.parametrize(("name", "expected"), [("test_login", ["test_login", "login", "_login"]), ("should_work", ["should_work", "work"]), ("login_test", ["login_test", "login"]), ("it_x", ["it_x"])])
def test_target_names(spark, name, expected):
    assert one(spark, intel.target_names, name) == expected


@pytest.mark.parametrize(
    ("ref", "expected"),
    [("a.md", ("a.md", "whole", None, None, None)), ("a.rs::login", ("a.rs", "symbol", "login", None, None)), ("a.md::## Auth", ("a.md", "heading", "## Auth", None, None)), ("a.rs#12-80", ("a.rs", "lines", None, 12, 80)), ("a.rs#1-2::x", ("a.rs#1-2", "symbol", "x", None, None)), ("a.rs#8-2", ("a.rs#8-2", "whole", None, None, None))],
)
def test_references(spark, ref, expected):
    assert tuple(one(spark, docs.reference, ref)) == expected


@pytest.mark.parametrize(("mode", "block", "expected"), [("balanced", False, ["block", "allow", "warn", "warn"]), ("strict", False, ["block", "allow", "block", "warn"]), ("permissive", False, ["block", "allow", "warn", "allow"]), ("balanced", True, ["block", "allow", "block", "warn"])])
def test_policy(spark, mode, block, expected):
    df = spark.createDataFrame([("proven_vulnerable",), ("proven_safe",), ("unknown",), ("pattern_only",)], "s string")
    assert [r["a"] for r in df.select(security.action(F.col("s"), mode, block).alias("a")).collect()] == expected


def test_overflow_closed_form():
    bits = 10
    for c in range(1, 1 << bits):
        overflows = any((n * c) % (1 << bits) < n for n in range(1, 1 << bits))
        assert overflows == (c != 1)


def test_lease():
    a = locks.Lease()
    assert a.step(0, "claim", "x") == ("ok", "x")
    assert a.step(1, "claim", "y") == ("held", "x")
    assert a.step(2, "claim", "x") == ("ok", "x")
    assert a.step(3, "release", "y") == ("held", "x")
    assert a.step(602, "claim", "y") == ("ok", "y")
    assert a.step(603, "release", "x") == ("held", "y")
    assert a.step(604, "done", "y") == ("ok", None)
    assert a.step(605, "release", "y") == ("none", None)


def test_session_end_drops_claims(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    events = spark.createDataFrame([(t(0), "claim", "a", "x"), (t(1), "claim", "b", "x"), (t(2), "done", None, "x"), (t(3), "claim", "a", "y")], "ts timestamp, op string, path string, block_key string")
    found = locks.folded(events)
    assert {(r["path"], r["op"], r["result"]) for r in found.collect()} == {("a", "claim", "ok"), ("b", "claim", "ok"), ("a", "done", "ok"), ("b", "done", "ok")}
    held = locks.holders(found, "2024-01-01 00:00:04")
    assert [(r["path"], r["block_key"]) for r in held.collect()] == [("a", "y")]


@pytest.mark.parametrize(("path", "expected"), [("../x", None), ("a/./b", "a/b"), ("", None), ("a\\b", "a/b")])
def test_lock_paths(path, expected):
    assert locks.normalised(path) == expected


def test_two_party_deadlock(spark):
    waits = spark.createDataFrame([("x", "b"), ("y", "a"), ("z", "a")], "waiter string, path string")
    held = spark.createDataFrame([("a", "x"), ("b", "y")], "path string, block_key string")
    assert {r["node"] for r in locks.deadlocked(waits, held).collect()} == {"x", "y"}


@pytest.mark.parametrize(("policy", "expected"), [("never", [False] * 3), ("if_stale", [True, False, True]), ("every_n", [False, False, True]), ("always", [True] * 3)])
def test_reindex_policy(spark, policy, expected):
    ticks = spark.createDataFrame([("s", 1, 6), ("s", 2, 0), ("s", 3, 1)], "session string, at int, stale_count int")
    found = loops.signals(ticks, policy).orderBy("iteration").collect()
    assert [r["reindexed"] for r in found] == expected
    assert found[0]["pause"] == (not expected[0])


def test_scan_prunes_and_reads(spark, tmp_path):
    for path, content in {"src/a.py": b"def a(): pass\n", "node_modules/b.py": b"x", "keep/c.rs": b"fn c() {}\n", "bad.py": b"\xff\xfe", "gen/d.py": b"y", "e.txt": b"z"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(content)
    assert {r["path"] for r in repos.scan(spark, str(tmp_path), globs=["gen/**"]).collect()} == {"src/a.py", "keep/c.rs"}
    assert {r["path"] for r in repos.scan(spark, str(tmp_path), languages=["RUST"]).collect()} == {"keep/c.rs"}
    assert {r["path"] for r in repos.scan(spark, str(tmp_path), ignore_file="*.py\n!src/\n!src/a.py\ngen/\n").collect()} == {"src/a.py", "keep/c.rs"}


def test_git_facts(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@localhost", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.py").write_text("x = 1\n")
    run("add", ".")
    run("commit", "-qm", "fix crash")
    (tmp_path / "a.py").write_text("x = 1\ny = 2\n")
    (tmp_path / "b.py").write_text("")
    assert {(r["path"], r["state"]) for r in repos.git_status(spark, str(tmp_path)).collect()} == {("a.py", "modified"), ("b.py", "untracked")}
    log = repos.git_commits(spark, str(tmp_path))
    assert [(r["path"], r["subject"]) for r in log.collect()] == [("a.py", "fix crash")]
    assert [tuple(r) for r in repos.bugfix_ratio(log).collect()] == [("a.py", 1.0)]
    assert [tuple(r) for r in repos.churn(log).collect()] == [("a.py", 1)]
    hunks = repos.diff_hunks(spark.createDataFrame([(1, repos.git_diff(str(tmp_path)))], "diff_id int, content string"))
    assert [(r["file"], r["start"], r["end"]) for r in hunks.collect()] == [("a.py", 2, 2)]
    assert repos.discover_repos(str(tmp_path)) == [str(tmp_path)]


def test_config(tmp_path):
    (tmp_path / "c.toml").write_text('[risk]\nbias = -1.0\n[security]\ncwes = ["78"]\n[other]\nx = 1\n')
    made = config.load(str(tmp_path / "c.toml"))
    assert made.risk.bias == -1.0 and made.risk.w_churn == 0.1 and made.security.cwes == ["78"] and made.loop.max_iterations == 50
    assert config.load(str(tmp_path / "none.toml")) == config.Config()
    assert [config.seconds(x) for x in ("90", "30s", "5m", "2h")] == [90, 30, 300, 7200]


def test_paths_stay_inside(tmp_path):
    assert repos.inside(str(tmp_path), "a/b") and repos.inside(str(tmp_path), "../x") is None


def test_catalog_round_trip(spark, tmp_path):
    made = Catalog(files(spark, "harbour"))
    made.write(str(tmp_path / "index"))
    again = Catalog.read(spark, str(tmp_path / "index"))
    assert sorted(map(repr, made.symbols.collect())) == sorted(map(repr, again.symbols.collect()))
    assert again.edges.count() == 6
    assert [r["node"] for r in again.focus("src/berth.rs", 1).select("node").collect()] == ["src/berth.rs", "src/crane/mod.rs", "src/lib.rs", "src/tide.rs"]
    assert "| 1 | `src/berth.rs` | 2 |" in again.report("harbour")
    assert sinks.mermaid(again.edges).count("-->") == 6
    assert again.drill("harbour/src").count() == 3
    assert packages.encoded_symbols(again.symbols).count() == 17
    task = packages.encoded_task("crane hook", *intel.task_context(again.index(), again.edges, again.symbols, "crane hook"))
    found = json.loads(task.first()["json"])
    assert found["q"] == "crane hook" and found["m"] and found["drill"]["sy"]


def test_a_missing_table_of_an_index_is_empty(spark, tmp_path):
    made = Catalog(files(spark, "harbour"))
    made.write(str(tmp_path / "index"))
    sinks.remove(spark, str(tmp_path / "index" / "calls"))
    again = Catalog.read(spark, str(tmp_path / "index"))
    assert again.calls.count() == 0 and again.calls.columns == made.calls.columns and again.symbols.count() == 17


def test_cycles_and_paths_against_brute_force(spark):
    rng = random.Random(3)
    for _ in range(6):
        n = rng.randint(3, 9)
        pairs = sorted({(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(rng.randint(2, 2 * n))})
        after = {a: {y for x, y in pairs if x == a} for a, _ in pairs}
        reach = {a: set(after[a]) for a in after}
        for _ in range(n):
            for a in reach:
                reach[a] |= {z for y in set(reach[a]) for z in after.get(y, ())}
        edges = spark.createDataFrame(pairs, "src string, dst string")
        expected = {a for a in reach if a in reach[a]}
        assert {r["node"] for r in graph.cycle_members(edges).collect()} == expected
        cycle = [r["node"] for r in graph.cycle_path(edges).orderBy("place").collect()]
        if expected:
            assert cycle[0] == cycle[-1] == min(expected) and all(y in after[x] for x, y in zip(cycle, cycle[1:], strict=False))
        else:
            assert cycle == []


def test_names_that_hold_each_other(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 7)))
    names, targets = {word() for _ in range(60)}, {word() for _ in range(6)}
    found = intel.covered(spark.createDataFrame([(x,) for x in names], "_low string"), spark.createDataFrame([(x,) for x in targets], "target string"))
    assert {r["_low"] for r in found.collect()} == {x for x in names if any(t in x or x in t for t in targets)}


def test_commit_diff_and_blame(tmp_path):
    def git(*args: str) -> str:
        return subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@example.org", *args], check=True, capture_output=True, text=True).stdout

    git("init", "-q")
    for text_, subject in (("one\n", "begin"), ("one\ntwo\n", "more")):
        (tmp_path / "a.txt").write_text(text_)
        git("add", ".")
        git("commit", "-qm", subject)
    assert "+two" in repos.git_show(str(tmp_path), "HEAD") and "+one" not in repos.git_show(str(tmp_path), "HEAD")
    assert repos.git_blame(str(tmp_path), "a.txt", 1).endswith(" begin") and repos.git_blame(str(tmp_path), "a.txt", 2).endswith(" more")


def test_loop_sessions_are_kept_and_deleted(spark, tmp_path):
    folder = str(tmp_path / "loops")
    for i in (1, 2):
        sinks.write_iterations(spark.createDataFrame([("a", i, "x"), ("b", i, "y")], "session string, iteration int, goal string"), folder)
    assert sinks.read_session(spark, folder, "a").count() == 2
    sinks.delete_session(spark, folder, "a")
    assert sinks.read_session(spark, folder, "a").count() == 0 and sinks.read_session(spark, folder, "b").count() == 2


def test_index_is_written_from_one_reading_of_its_files(spark, tmp_path):
    """What the files come from runs once (before: once for each table), and purposes list no package's names whole."""

    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    names = ["e", "b", "d", "b", "a", "c"]
    rows = [("r", f"p/{i}.py", f"def {n}():\n    {n}x(1)\nimport p.{i}\n") for i, n in enumerate(names)]
    files = spark.createDataFrame(rows, "repo string, path string, content string").mapInArrow(counted, "repo string, path string, content string")
    Catalog(files).write(str(tmp_path / "index"))
    assert runs.value == len(rows)
    made = Catalog.read(spark, str(tmp_path / "index"))
    assert made.symbols.count() == len(rows)
    purposes = packages.purposes(made.symbols, made.conventions)
    assert [r.purpose.split(": ")[1] for r in purposes.collect()] == ["a, b, c"]
    assert "collect_set" not in purposes._jdf.queryExecution().executedPlan().toString()
