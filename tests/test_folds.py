from __future__ import annotations

import difflib
import random

import pytest

from quarry.plans import state_queries as q
from quarry.sources import blame
from tests.oracle import check


@pytest.mark.parametrize("name", ["stream_debounced", "section_staleness", "stream_staleness", "loop_prefetch", "stream_prefetch", "blame_generated"])
def test_matches_sql(spark, small, name):
    check(spark, small, q.QUERIES[name], q.ORACLES[name])


def test_blame_against_lines_that_are_carried(spark):
    """Random histories: each version's lines carry their commit; hunks come from a diff of the versions."""
    rng = random.Random(9)
    rows, expected = [], set()
    for f in range(25):
        now: list[tuple[str, str]] = []
        for k in range(rng.randint(1, 7)):
            new = [x for x in now if rng.random() > 0.2]
            for _ in range(rng.randint(0, 4)):
                new.insert(rng.randint(0, len(new)), (f"{k}-{rng.random()}", f"c{k}"))
            ops = difflib.SequenceMatcher(None, [t for t, _ in now], [t for t, _ in new], autojunk=False).get_opcodes()
            # as diffs without context name them: an empty side names the line before
            rows += [(f"f{f}", k, f"c{k}", a + (b > a), b - a, c + (d > c), d - c) for kind, a, b, c, d in ops if kind != "equal"]
            now = new
        expected |= {(f"f{f}", i, c) for i, (_, c) in enumerate(now, 1)}
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "path string, seq int, commit string, old_start long, old_count long, new_start long, new_count long")
    assert {tuple(r) for r in blame.lines(blame.blamed(df)).collect()} == expected
    assert blame.blamed(df.limit(0)).count() == 0
