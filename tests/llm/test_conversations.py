from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from quarry.llm import conversations as c

COST = {"K": 0, "R": 2, "D": 3, "I": 2}
FORM = re.compile(r"(s?(ua)+)?\Z")


def slow_repair(rows: list[tuple[str, str]]) -> tuple:
    """rows: (role, text). All sequences of edits, cheapest first, as a search over (turns done, roles so far)."""
    faults, seen = [], set()
    for role, text in rows:
        body = text.rstrip(c.SPACE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    best = None
    # by cost: all (audit, turns done, result), as strings
    layers = defaultdict(set)
    layers[0].add(("", 0, ()))
    for cost in range(0, 3 * len(rows) + 1):
        todo = list(layers[cost])
        done = set()
        while todo:
            state = todo.pop()
            if state in done:
                continue
            done.add(state)
            audit, i, out = state
            initials = "".join(r[0][:1] for r in out)
            if i == len(rows) and FORM.match(initials) and (best is None or audit < best[0]):
                best = (audit, out)
            steps = [("I", i, (*out, (n, ""))) for n in ("user", "assistant")] if len(out) < 2 * len(rows) + 2 else []
            if i < len(rows):
                role, text = rows[i]
                steps.append(("D", i + 1, out))
                if faults[i] not in ("blank", "duplicate"):
                    steps += [("R", i + 1, (*out, (n, text))) for n in ("user", "assistant")]
                    steps += [("K", i + 1, (*out, (role, text)))] if role else []
            for letter, j, new in steps:
                if not re.match(r"(s?(ua)*u?)?\Z", "".join(r[0][:1] for r in new)):
                    continue
                more = cost + COST[letter] + (letter in "KR" and faults[i] == "truncated")
                if more == cost:
                    todo.append((audit + letter, j, new))
                else:
                    layers[more].add((audit + letter, j, new))
        if best is not None:
            break
    return faults, cost, best[0], best[1]


def expected(rows: list[tuple]) -> list[tuple]:
    """The query's rows for (conv_id, turn, role, text)."""
    by = defaultdict(list)
    for conv_id, turn, role, text in rows:
        spell = lambda v: " " if v is None else str(v)
        role, text, kind = spell(role), spell(text), zlib.crc32(f"{spell(conv_id)}:{spell(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        by[conv_id] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv_id, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        faults, cost, audit, result = slow_repair([t[1:] for t in turns])
        known = [t[0] for t in turns if t[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        pairs = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        text = "\n".join(f"{r}:{t}" for r, t in result)
        out.append((conv_id, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), pairs, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_every_short_conversation_against_all_edits():
    rng = random.Random(5)
    for _ in range(1500):
        rows = [(rng.choice(["system", "user", "assistant", "tool", " "]), rng.choice(["a.", "b", " ", f"{i}!", "c?"])) for i in range(rng.randint(0, 5))]
        faults, cost, audit, _ = slow_repair(rows)
        prices = [(r[:1], f in ("blank", "duplicate"), f == "truncated") for (r, _), f in zip(rows, faults, strict=True)]
        assert c.cheapest(c.solved(prices)) == (cost, audit)


@pytest.mark.parametrize("block", [1, 2, 7])
def test_blocks_give_the_same(monkeypatch, block):
    monkeypatch.setattr(c, "BLOCK", block)
    rng = random.Random(6)
    for _ in range(400):
        turns = [(rng.choice("suat"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 25))]
        assert c.cheapest(c.stretched(turns)) == c.cheapest(c.solved(turns))


def conversations() -> list[tuple]:
    """Nulls, equal turns, repeated rows, empty and long texts, roles of any name; conversations of up to five turns and longer quiet ones."""
    rng = random.Random(7)
    roles = ["system", "user", "assistant", "tool", None]
    rows = [(None, 1, "user", "who?"), (None, None, "assistant", None), (1, None, None, None), (2, 3, "user", "a."), (2, 3, "user", "a."), (2, 3, "assistant", "b."), (3, 1, "user", "word " * 30_000), (3, 2, "assistant", " "), (4, -2, "user", ""), (4, 2**40, "assistant", "x!\n")]
    for conv_id in range(10, 120):
        rows += [(conv_id, rng.choice([t, t, t + 1, None]), rng.choice(roles), rng.choice(["yes.", "no", f"{t}?", "\t", None, "a b!"])) for t in range(rng.randint(1, 4))]
    for conv_id in range(200, 205):
        rows += [(conv_id, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(9)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("long", [c.LONG, 0, 2])
def test_query_against_all_edits(spark, tmp_path, monkeypatch, long):
    """Also if all conversations, or those of over two turns, are dealt by ranges of turns."""
    monkeypatch.setattr(c, "LONG", long)
    monkeypatch.setattr(c, "PART", 40)
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA)
    for x in ("part", "position", "edit", "fault", "blank", "key", "place", "copy", "n"):
        df = df.withColumn(x, df["turn"])
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    found = c.op12_retained_subsequence(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=str) == expected(rows)


def test_given_conversations(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, c.op12_retained_subsequence(spark, small).collect()), key=str) == expected(rows)


def test_one_conversation_in_many_parts(spark, monkeypatch):
    """A conversation of 3,000 turns, dealt to over ten tasks, has the same edits as in one task."""
    rng = random.Random(8)
    rows = [(1, t // 2, rng.choice(["user", "assistant", "system"]), rng.choice([f"{t}.", "same.", f"{t}", " "])) for t in range(3_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = sorted(map(tuple, c.repaired(df, digest=True).collect()))
    monkeypatch.setattr(c, "LONG", 100)
    monkeypatch.setattr(c, "PART", 250)
    edits = c.repaired(df)
    assert edits.select("part").distinct().count() > 10
    assert sorted(map(tuple, c.repaired(df, digest=True).collect())) == whole


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert c.op12_retained_subsequence(spark, str(tmp_path)).count() == 0
    assert c.repaired(spark.createDataFrame([], SCHEMA)).count() == 0
