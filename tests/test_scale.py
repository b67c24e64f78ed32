from __future__ import annotations

import re
import time

from quarry.operators import extract, resolve, security
from quarry.sources import sinks

FILES = "repo string, path string, content string"


def test_imports_of_long_typescript_take_linear_time(spark):
    """F1, F4, F8, F9, F17: each import was searched from the start of its file, with a copy of the file in each row."""

    def took(n: int) -> float:
        code = "\n".join(f"export const v{i} = 1; // \u00e9 {'x' * 60}\nimport {{\n a }} from './m{i}'; import './s{i}'" for i in range(n))
        begun = time.monotonic()
        rows = extract.imports(spark.createDataFrame([("r", "a.ts", code)], FILES)).collect()
        assert len(rows) == 2 * n
        last = {r["text"]: (r["line"], r["character"]) for r in rows}
        assert last["./m0"] == (3, 11) and last[f"./m{n - 1}"] == (3 * n, 11)
        assert last[f"./s{n - 1}"] == (3 * n, 11 + len(f"./m{n - 1}'; import '"))
        return time.monotonic() - begun

    took(10)
    assert took(4000) < 20


def test_imports_of_a_repo_are_joined_by_file_and_once(spark):
    """No join deals out a repo's imports by the repo alone, and repeated imports are one."""
    files = spark.createDataFrame([("r", "go.mod", "module mod\n"), ("r", "p1/a.go", 'import (\n\t"mod/p2"\n)\nimport "mod/p2"\n"mod/p9"\n'), ("r", "p2/b.go", "")], FILES)
    found = resolve.resolve_imports(extract.imports(files), files)
    assert [tuple(r) for r in found.collect()] == [("r", "p1/a.go", "p2/b.go")]
    assert not re.search(r"SortMergeJoin \[repo#\d+\]", found._jdf.queryExecution().executedPlan().toString())


def test_findings_read_the_files_once(spark):
    """each check read and split all files anew and ran its patterns on lines without its fixed parts."""
    code = 'p = malloc(n * 4);\nmemcpy(a, b, n * sizeof(int));\np = malloc(a * b << 3);\nq = malloc(n - 2);\npassword = "long_secret"\nf = n + \'../x\'; open(n)\nprintf(n);\np = malloc(2 * 3);'
    found = security.findings(spark.createDataFrame([("r", "a.c", code)], FILES), security.ALL_CWES, prove=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Scan ", plan)) == 1
    want = [(1, "CWE-190", "proven_vulnerable"), (2, "CWE-680", "proven_vulnerable"), (3, "CWE-190", "pattern_only"), (4, "CWE-191", "proven_vulnerable"), (5, "CWE-798", "pattern_only")]
    want += [(6, "CWE-22", "pattern_only"), (6, "CWE-22", "pattern_only"), (7, "CWE-134", "pattern_only")]
    assert sorted(tuple(r) for r in found.select("line", "cwe", "status").collect()) == want


def test_the_log_of_loops_has_no_file_for_each_session(spark, tmp_path):
    """each session had a folder and a file of its own."""
    folder = str(tmp_path / "loops")
    ticks = spark.range(3000).selectExpr("cast(id % 1000 AS string) AS session", "cast(id AS int) AS iteration", "'x' AS goal").coalesce(1)
    sinks.write_iterations(ticks, folder)
    assert len(list((tmp_path / "loops").rglob("*.parquet"))) <= sinks.BUCKETS
    assert sorted(r["iteration"] for r in sinks.read_session(spark, folder, "7").collect()) == [7, 1007, 2007]
    sinks.delete_session(spark, folder, "7")
    sinks.delete_session(spark, folder, "none")
    assert sinks.read_session(spark, folder, "7").count() == 0 and spark.read.parquet(folder).count() == 2997


def test_licences_that_are_found_are_digested_once(spark):
    """a filter on what was found made the digest of every text a second time, without sharing its parts."""
    from quarry.llm import license_scan
    from quarry.llm.license_texts import KNOWN

    known = license_scan.known_digests(spark, KNOWN[:1], ())
    docs = spark.createDataFrame([(1, KNOWN[0][1]), (2, "x"), (3, None)], "doc_id long, text string")
    given = spark.createDataFrame(known.collect(), "digest string, license_id string")
    found = license_scan.license_scan(docs, given).where("license_id IS NOT NULL").select("doc_id", "license_id")
    assert [tuple(r) for r in found.collect()] == [(1, KNOWN[0][0])]
    assert "isnotnull(sha2" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert license_scan.license_scan(docs, given).count() == 3


def test_lines_without_a_symbol_meet_no_rule(spark):
    """F16: every line went through the rules of its language; the first rule that fits still names the symbol."""
    code = {"a.py": "\n x\ndef f(): class\nclass C:\nclassy\nasync  def g\ndef \n", "a.rs": "\u2003pub fn a() // struct B\nfn\nstruct  B;\n", "a.go": "type T struct\ntype I interface\ntype X int struct\nfunc (t T) m()\n"}
    found = extract.symbols(spark.createDataFrame([("r", p, c) for p, c in code.items()], FILES))
    want = [("a.go", 1, "T", "Struct"), ("a.go", 2, "I", "Trait"), ("a.go", 3, "X", "Other"), ("a.go", 4, "m", "Function"), ("a.py", 3, "f", "Function"), ("a.py", 4, "C", "Struct"), ("a.py", 6, "g", "Function"), ("a.rs", 1, "a", "Function"), ("a.rs", 3, "B", "Struct")]
    assert sorted(tuple(r) for r in found.select("path", "line", "name", "kind").collect()) == want
    assert re.search(r"Filter .*RLIKE\(\w+#\d+, def\|class\)", found._jdf.queryExecution().optimizedPlan().toString())


def test_calls_read_the_files_once_beside_their_symbols(spark, small):
    """the files were made and split four times, the symbols of them three times; comments and definitions are told as before."""
    from quarry.plans import generated_queries

    plan = generated_queries.calls_generated(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode(CASE WHEN") == 1
    code = "fn a() {\n\u2003// b()\n\u00a0# c()\n  * d()\n\tdef e()\n  f() fn \n g() fn x\n h() function\u2003\n function i()\n j() // k()\nundefine(l())\n}"
    files = spark.createDataFrame([("r", "a.rs", code)], FILES)
    assert sorted(r["callee_name"] for r in extract.calls(files, extract.symbols(files)).collect()) == ["f", "h", "j", "k", "l", "undefine"]


def test_rings_of_asked_files_meet_no_other_edge(spark, small):
    """the rings of all files were made, by each batch of a stream anew."""
    from quarry.plans import state_queries
    from quarry.plans.tables import supply_edges
    from quarry.streaming import loops

    edges = supply_edges(spark, small)
    of = spark.createDataFrame([("p1",), ("p2",), ("p2",), ("s3",), ("none",), (None,)], "file string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    ring = loops.rings(edges, of)
    assert rows(ring) == rows(loops.rings(edges).where("file IN ('p1', 'p2', 's3')"))
    loop = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "c")], "src string, dst string")
    assert rows(loops.rings(loop, loop.selectExpr("src AS file"))) == rows(loops.rings(loop)) == [("a", "b"), ("a", "c"), ("b", "a"), ("b", "c")]
    # what a batch reads is the kept ring, not the edges
    plan = state_queries.loop_prefetch(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_partkey" not in plan and "l_partkey" not in ring._jdf.queryExecution().optimizedPlan().toString()


def test_batches_of_staleness_read_kept_links(spark, small, monkeypatch):
    """each batch made the sections and links anew from all events."""
    from quarry.plans import state_queries

    plans, run = [], state_queries.changes.ran

    def ran(stream, *args, **more):
        plans.append(stream._jdf.queryExecution().analyzed().toString())
        return run(stream, *args, **more)

    monkeypatch.setattr(state_queries.changes, "ran", ran)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(state_queries.stream_staleness(spark, small)) == rows(state_queries.section_staleness(spark, small))
    assert len(plans) == 1 and "event_type" not in plans[0]


def test_code_is_made_once_and_imports_stay_in_their_files_row(spark, small):
    """each part of typescript_generated made the code anew, all imports were shuffled, and each one copied the list of those before it."""
    from quarry.plans import language_queries

    plan = language_queries.QUERIES["typescript_generated"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "[a-z]{3,12}" not in plan and "MapInArrow" not in plan
    files = spark.createDataFrame([("r", "a.ts", "import './b'; export { b } from './b';"), ("r", "a.ts", "import './b'")], FILES)
    found = extract.imports(files.where("path = 'a.ts'"))
    # what is told apart is a file's own imports, so that a repeated file has them again
    assert sorted(tuple(r) for r in found.select("text", "line", "character").collect()) == [("./b", 1, 8), ("./b", 1, 33)]
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    # the rules read the lines as they are; only a signature that is asked for is stripped
    assert "trim(" in extract.symbols(files)._jdf.queryExecution().optimizedPlan().toString()
    assert " trim(" not in extract.symbols(files).select("name", "kind")._jdf.queryExecution().optimizedPlan().toString()


def test_imports_between_others_and_over_lines():
    """what comes before `from` and the names are sought one after the other, in places that are counted on."""
    from quarry.functions import modules

    code = "from './no';\nexport x\n from 'react'; a from\N{EM SPACE}\n'../\N{LATIN SMALL LETTER E WITH ACUTE}\n1'; import'./no'; import\N{NO-BREAK SPACE}'./s\" import './t' from './u';import\x1c'./no'\n\nimport './t'; import y from './t'; import z from './t"
    assert modules.places(code) == {("../\N{LATIN SMALL LETTER E WITH ACUTE}\n1", 4): 1, ("./u", 5): 50, ("./t", 7): 29, ("./s", 5): 26, ("./t", 5): 39}
    assert modules.places("") == {} and modules.places("import a from './a'") == {("./a", 1): 15}


def test_imports_of_one_long_line_take_linear_time(spark):
    """a list of imports was copied for each that was added."""
    n = 150_000
    code = " ".join(f"import './s{i}';" for i in range(n))
    begun = time.monotonic()
    rows = extract.imports(spark.createDataFrame([("r", "a.ts", code)], FILES)).collect()
    assert len(rows) == n and max(r["character"] for r in rows) == code.rindex("'./s") + 1
    assert time.monotonic() - begun < 25
