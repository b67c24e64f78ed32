"""Conversation structure repair by a dynamic programme over retained subsequences.

A conversation is well formed if the initials of its roles spell `(s?(ua)+)?`. Each turn
is kept, reroled to user or assistant, or deleted, and empty turns may be inserted. Only
retained (kept or reroled) turns are chosen: between two of them every turn is deleted,
which prefix sums price, and the pair of their roles determines the inserts. So the
programme carries one running minimum for each role of the last retained turn, and a
turn looks at these alone, not at all earlier turns. Equal prices are decided by the
audit, the initials of the edits: two audits of the same turns and one price are never
a prefix of each other, so the smaller one stays smaller whatever follows, and within a
gap deletions come before inserts.

Conversations of up to LONG turns are dealt by id and solved in one task, one after the
other. Longer ones are dealt by ranges of turns, so that one conversation may fill many
tasks: each task solves its part from every state it may begin in, the parts' results
are composed in order (prices add up, audits are joined), and each part then applies its
piece of the cheapest audit. Their repeated turns are found by an aggregation whose hot
keys are split. Only what is one value by nature, a conversation's audit and the digest of
its repaired text, passes through one task, as a stream.

Nulls in id, turn, role and text: a null id is a conversation of its own, a null turn comes
first, a null role or text counts as one space. Roles other than system, user and assistant
(told by their first letter) can't be kept; an empty role has no initial and can't either.
Equal turn numbers go by role and text, then copies follow one another. A very long text
stays whole. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import cut, map_arrow, table
from quarry.llm.graph import matched

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLED, DELETED, INSERTED, TRUNCATED = 2, 3, 2, 1
NAMES = {"s": "system", "u": "user", "a": "assistant"}
#: Before anything is retained, the last retained role is empty. Inserts needed between two retained roles; other pairs can't follow one another.
INSERTS = {("", "s"): 0, ("", "u"): 0, ("", "a"): 1, ("s", "u"): 0, ("s", "a"): 1, ("u", "a"): 0, ("u", "u"): 1, ("a", "u"): 0, ("a", "a"): 1}
#: Inserts after the last retained turn.
ENDS = {"": 0, "s": 2, "u": 1, "a": 0}
STATES = tuple(ENDS)
LEGAL = ("su", "ua", "au")
SPACE = " \t\n\x0b\x0c\r"

#: Turns of a conversation that one task solves at once; longer ones are dealt by ranges of about PART turns.
LONG, PART = 10_000, 100_000
#: Turns after which audits are joined, which bounds the copying of strings.
BLOCK = 1_000
#: Ids of long conversations up to which they are broadcast.
FEW_IDS = 500_000
#: Edits and characters of an Arrow batch.
ROWS, CHARS = 4_096, 8 << 20

EDITS = "conv_id long, part long, position long, edit string, turn long, was string, role string, text string, fault string"

Ends = dict[str, tuple[int, str]]


def solved(turns: list[tuple[str, bool, bool]], begin: str = "") -> Ends:
    """Cheapest (cost, audit) by role of the last retained turn, for turns (initial, must go, truncated) after the role `begin`."""
    # best: price (cost less the deletion of all turns so far), audit, and the number of turns that the audit covers
    best: dict[str, tuple[int, str, int]] = {begin: (0, "", 0)}

    def audit(found: tuple[int, str, int], until: int) -> str:
        return found[1] + DELETE * (until - found[2])

    for i, (initial, gone, truncated) in enumerate(turns):
        if gone:
            continue
        here: dict[str, tuple[int, str, int]] = {}
        for role in "sua":
            if role != initial and role == "s":
                continue
            own, letter = (0, KEEP) if role == initial else (REROLED, REROLE)
            for before, found in best.items():
                if (k := INSERTS.get((before, role))) is None:
                    continue
                price = found[0] + own + TRUNCATED * truncated + INSERTED * k - DELETED
                if role not in here or price <= here[role][0]:
                    new = (price, audit(found, i) + INSERT * k + letter, i + 1)
                    here[role] = min(here[role], new) if role in here else new
        for role, new in here.items():
            if role not in best or new[0] < best[role][0] or new[0] == best[role][0] and new[1] < audit(best[role], i + 1):
                best[role] = new
    n = len(turns)
    return {role: (found[0] + DELETED * n, audit(found, n)) for role, found in best.items()}


def joined(first: Ends, second: dict[str, Ends]) -> Ends:
    """The ends of two stretches of turns: `second` has its ends by the state it begins in."""
    out: Ends = {}
    for between, (cost, audit) in first.items():
        for end, (more, rest) in second[between].items():
            total = cost + more
            if end not in out or total <= out[end][0]:
                new = (total, audit + rest)
                out[end] = min(out[end], new) if end in out else new
    return out


def stretched(turns: list[tuple[str, bool, bool]], begin: str = "") -> Ends:
    """As solved, for any number of turns: blocks are solved from every state and joined."""
    ends = solved(turns[:BLOCK], begin)
    for i in range(BLOCK, len(turns), BLOCK):
        ends = joined(ends, {s: solved(turns[i : i + BLOCK], s) for s in ends})
    return ends


def cheapest(ends: Ends) -> tuple[int, str]:
    return min((cost + INSERTED * ENDS[role], audit + INSERT * ENDS[role]) for role, (cost, audit) in ends.items())


def roles(letters: str, initials: list[str], before: str = "") -> Iterator[str]:
    """The role (initial) of each edit, empty for a deletion. Roles alternate; only a kept system turn is one."""
    i = 0
    for letter in letters:
        initial = ""
        if letter != INSERT:
            initial = initials[i]
            i += 1
        if letter == DELETE:
            yield ""
            continue
        before = initial if letter == KEEP else "a" if before == "u" else "u"
        yield before


def _turns(batches: Iterable[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in columns), strict=True)


def _grouped(rows: Iterable[tuple], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows whose first `width` values are equal."""
    key, group = None, []
    for row in rows:
        if group and row[:width] != key:
            yield key, group
            group = []
        key = row[:width]
        group.append(row)
    if group:
        yield key, group


def _batches(rows: Iterable[tuple], schema: pa.Schema, text: int | None = None) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    chars = 0
    for row in rows:
        out.append(row)
        chars += len(row[text] or "") if text is not None else 0
        if len(out) >= ROWS or chars >= CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
            out, chars = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)


_EDITS = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("was", pa.string()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.string())])


def _edits(conv_id: int | None, part: int, letters: str, turns: list[tuple], before: str = "") -> Iterator[tuple]:
    """turns: (turn, role, text, fault)."""
    i = 0
    for position, (letter, initial) in enumerate(zip(letters, roles(letters, [t[1][:1] for t in turns], before), strict=True)):
        if letter == INSERT:
            yield conv_id, part, position, letter, None, None, NAMES[initial], "", None
            continue
        turn, role, text, fault = turns[i]
        i += 1
        after = None if letter == DELETE else role if letter == KEEP else NAMES[initial]
        yield conv_id, part, position, letter, turn, role, after, text if after else None, fault


def _short(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of whole conversations, which come sorted; finds repeated turns itself."""

    def rows() -> Iterator[tuple]:
        for (conv_id,), group in _grouped(_turns(batches, ("conv_id", "turn", "role", "text", "blank", "truncated")), 1):
            seen: set[tuple[str, str]] = set()
            turns, prices = [], []
            for _, turn, role, text, blank, truncated in group:
                repeated = (role, text) in seen
                seen.add((role, text))
                fault = "blank" if blank else "duplicate" if repeated else "truncated" if truncated else None
                turns.append((turn, role, text, fault))
                prices.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
            yield from _edits(conv_id, 0, cheapest(stretched(prices))[1], turns)

    return _batches(rows(), _EDITS, 7)


def marked(turns: DataFrame) -> DataFrame:
    """turns with nulls of role and text as one space, the fault of each by itself, and the values its order needs."""
    spelled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    out = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), spelled("role").alias("role"), spelled("text").alias("text"))
    end = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    return out.withColumns({"blank": end == "", "truncated": (end != "") & ~end.isin(".", "!", "?")})


#: Ascending, nulls first.
ORDER = ("turn", "role", "text")


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each part of a long conversation: cost and audit from every state to every state."""

    def rows() -> Iterator[tuple]:
        for (part, conv_id), group in _grouped(_turns(batches, ("part", "conv_id", "initial", "gone", "truncated")), 2):
            prices = [r[2:] for r in group]
            for begin in STATES:
                for end, (cost, audit) in stretched(prices, begin).items():
                    yield conv_id, part, begin, end, cost, audit

    return _batches(rows(), pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("begin", pa.string()), ("end", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]), 5)


def _composed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each part's piece of the cheapest audit of its conversation and the role it begins after. Parts come in order."""

    def rows() -> Iterator[tuple]:
        rows = _grouped(_turns(batches, ("conv_id", "part", "begin", "end", "cost", "audit")), 2)
        for (conv_id,), parts in _grouped(((key[0], key[1], group) for key, group in rows), 1):
            ends: Ends = {"": (0, "")}
            ways: list[dict[str, tuple[str, str]]] = []
            for _, _, group in parts:
                table: dict[str, Ends] = {s: {} for s in STATES}
                for _, _, begin, end, cost, audit in group:
                    table[begin][end] = (cost, audit)
                after = joined(ends, table)
                # how each end was reached: the state before and the piece
                ways.append({end: next((s, table[s][end][1]) for s, (c, a) in ends.items() if end in table[s] and (c + table[s][end][0], a + table[s][end][1]) == found) for end, found in after.items()})
                ends = after
            state = min(ends, key=lambda s: (ends[s][0] + INSERTED * ENDS[s], ends[s][1] + INSERT * ENDS[s]))
            more, out = INSERT * ENDS[state], []
            for (_, part, _), way in zip(reversed(parts), reversed(ways), strict=True):
                before, piece = way[state]
                out.append((conv_id, part, before, piece + more))
                state, more = before, ""
            yield from out

    return _batches(rows(), pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("before", pa.string()), ("piece", pa.string())]), 3)


def _applied(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of parts: a part's piece comes first, then its turns in order."""

    def rows() -> Iterator[tuple]:
        for (part, conv_id), group in _grouped(_turns(batches, ("part", "conv_id", "before", "piece", "turn", "role", "text", "fault")), 2):
            _, _, before, piece, *_ = group[0]
            yield from _edits(conv_id, part, piece, [r[4:] for r in group[1:]], before)

    return _batches(rows(), _EDITS, 7)


def _long(turns: DataFrame) -> DataFrame:
    """Edits of long conversations, dealt by ranges of turns."""
    rows = turns.withColumns({"key": F.sha2(F.to_json(F.struct("conv_id", "role", "text")), 256), "id": F.monotonically_increasing_id()})
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), F.col("id"))
    rows = cut(rows.withColumn("place", place))
    total = rows.count()
    first = cut(rows.groupBy("key").agg(F.min("place").alias("first"), F.count("*").alias("n")))
    rows = matched(rows, first, "key", "n", total)
    fault = F.when(F.col("blank"), "blank").when(F.col("place") > F.col("first"), "duplicate").when(F.col("truncated"), "truncated")
    rows = rows.select("conv_id", "turn", "role", "text", "id", fault.alias("fault"))
    dealt = rows.repartitionByRange(total // PART + 1, "conv_id", *ORDER, F.col("id"))
    dealt = cut(dealt.withColumn("part", F.spark_partition_id().cast("long")))
    slim = dealt.select("part", "conv_id", "turn", "role", "text", "id", F.substring("role", 1, 1).alias("initial"), F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)).alias("gone"), F.coalesce(F.col("fault") == "truncated", F.lit(False)).alias("truncated"))
    by_turn = ("part", "conv_id", *ORDER, "id")
    pieces = map_arrow(slim.repartition("part").sortWithinPartitions(*by_turn), _pieces, "conv_id long, part long, begin string, end string, cost long, audit string")
    pieces = map_arrow(pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part"), _composed, "conv_id long, part long, before string, piece string")
    first = pieces.select("part", "conv_id", "before", "piece", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("fault"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("id"))
    then = dealt.select("part", "conv_id", F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("piece"), "turn", "role", "text", "fault", F.lit(1).alias("kind"), "id")
    both = first.unionByName(then).repartition("part").sortWithinPartitions("part", "conv_id", "kind", *ORDER, "id")
    return map_arrow(both, _applied, EDITS)


def _sizes(turns: DataFrame) -> DataFrame:
    """Ids of conversations of over LONG turns."""
    return cut(turns.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > LONG).select(F.col("conv_id").alias("_long"), F.lit(True).alias("_is_long")))


def repaired(turns: DataFrame, digest: bool = False) -> DataFrame:
    """Edits (EDITS) of every conversation of turns (conv_id, turn, role, text), in order of part and position.

    was and role are the roles before and after; inserted turns have no turn number, deleted ones no role
    and text. With digest, one row for each conversation instead, as `digested` makes them.
    """
    rows = marked(turns)
    ids = _sizes(turns.select(F.col("conv_id").cast("long").alias("conv_id")))
    n = ids.count()
    if n:
        tagged = rows.join(F.broadcast(ids) if n <= FEW_IDS else ids, F.col("conv_id").eqNullSafe(F.col("_long")), "left")
        rows, long = tagged.where("_is_long IS NULL").drop("_long", "_is_long"), tagged.where("_is_long").drop("_long", "_is_long")
    short = map_arrow(rows.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER), _short, EDITS)
    out = digested(short) if digest else short
    if not n:
        return out
    edits = _long(long)
    if not digest:
        return out.unionByName(edits)
    return out.unionByName(digested(edits.repartition("conv_id").sortWithinPartitions("conv_id", "part", "position")))


DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation whose edits come one after the other. Holds counts, the audit and the state of the hash."""
    columns = ("conv_id", "edit", "turn", "was", "role", "text", "fault")

    def rows() -> Iterator[tuple]:
        begun, now = False, None
        for conv_id, edit, turn, was, role, text, fault in _turns(batches, columns):
            if not begun or conv_id != now:
                if begun:
                    yield done()
                begun, now = True, conv_id
                faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
                low = high = last = None
                distinct = illegal = cost = 0
                before, audit, sha, some = None, [], hashlib.sha256(), False

                def done() -> tuple:
                    gaps = 0 if low is None else high - low + 1 - distinct
                    return now, gaps, *faults.values(), illegal, cost, "".join(audit), sha.hexdigest()

            audit.append(edit)
            cost += {KEEP: 0, REROLE: REROLED, DELETE: DELETED, INSERT: INSERTED}[edit] + TRUNCATED * (fault == "truncated" and edit != DELETE)
            if edit != INSERT:
                if fault:
                    faults[fault] += 1
                if turn is not None:
                    # turns come in order
                    low, high = turn if low is None else low, turn
                    distinct += turn != last
                    last = turn
                illegal += before is not None and before + was[:1] not in LEGAL
                before = was[:1]
            if role is not None:
                sha.update(f"{'\n' * some}{role}:{text}".encode())
                some = True
        if begun:
            yield done()

    types = [pa.int64()] * 7 + [pa.string()] * 2
    return _batches(rows(), pa.schema(list(zip((f.split()[0] for f in DIGEST.split(", ")), types, strict=True))), 7)


def digested(edits: DataFrame) -> DataFrame:
    """Counts, cost, audit and digest of each conversation whose edits lie in one partition in order."""
    return map_arrow(edits, _digests, DIGEST)


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults by a hash of id and turn: one in twenty each goes, loses its text or its stops, is repeated, or is the user's."""
    spelled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault: Column = F.crc32(F.concat_ws(":", spelled("conv_id"), spelled("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(spelled("text"), ".!?", "")).otherwise(spelled("text"))
    role = F.when(fault == 4, "user").otherwise(spelled("role"))
    copies = F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return turns.where(fault != 0).select(F.col("conv_id"), F.col("turn"), role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def op12_retained_subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    found = repaired(damaged(turns), digest=True)
    every = turns.select(F.col("conv_id").cast("long").alias("_every")).distinct()
    zeros = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    out = every.join(found, F.col("_every").eqNullSafe(F.col("conv_id")), "left")
    return out.select(F.col("_every").alias("conv_id"), *zeros.values(), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


QUERIES = {"op12_retained_subsequence": op12_retained_subsequence}
ORACLES: dict[str, str] = {}
