"""Leases, waits and ends of sessions as a timeline: in batch, and as a stream that keeps state by key.

Events are (ts, op, path, block_key, seconds) with op claim, release, wait (for `seconds` at most) or done (of a whole
session, without a path). Beside the results of events a timeline has what happens without one: a lease that nobody renews
expires, and a wait becomes ready when the lease that it waits for goes, or times out. At one moment expiries come first, then
events by op and block, then timeouts; so a wait whose lease goes at its last moment is ready. A wait for one's own
lease is a deadlock. The end of a session gives a row only where it frees a path. What is due after the last event isn't out yet.

The stream has two stages of `transformWithState`. The first has SESSIONS buckets of sessions, as a call for each session costs more
than its events: it remembers when a session's claims may hold each path and deals an end to the paths that it may free, no others.
The second is keyed by path: it keeps events until the watermark has passed them, so that their
order doesn't hang on batches, and one timer for whatever is due next. State is a lease, its waits and the events of
the watermark's delay for each path; leases that don't change aren't touched by a batch. Late events are dropped. Small state
is one value, as each call to the state store costs more than its bytes; events are kept by chunks.
"""

from __future__ import annotations

import heapq
import json
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from quarry.sources.package import send_package
from quarry.streaming.locks import TTL, by_path

EVENTS = "ts timestamp, op string, path string, block_key string, seconds double"
ROWS = "path string, ts timestamp, op string, block_key string, result string, held_by string"
SECOND = 1_000_000
#: Buckets of sessions, and events of a path that are one value of its state.
SESSIONS, CHUNK = 512, 1_000
#: What transformWithState needs.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@dataclass
class Timeline:
    """One path. Times are microseconds; rows are (ts, op, block_key, result, held_by)."""

    ttl: float = TTL
    holder: str | None = None
    expires: int = 0
    #: (deadline, since, waiter), a heap
    waits: list[tuple[int, int, str]] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)

    def _free(self, at: int) -> None:
        self.holder = None
        self.rows += [(at, "wait", who, "ready", None) for _, _, who in sorted(self.waits, key=lambda w: w[1:])]
        self.waits = []

    def until(self, at: int, events_follow: bool = False) -> None:
        """What is due up to a moment; if events of that moment follow, its timeouts aren't."""
        while True:
            late = self.waits[0][0] if self.waits else None
            if late is not None and (late > at or late == at and events_follow):
                late = None
            if self.holder is not None and self.expires <= at and (late is None or self.expires <= late):
                self.rows.append((self.expires, "expire", self.holder, "expired", None))
                self._free(self.expires)
            elif late is not None:
                self.rows.append((late, "wait", heapq.heappop(self.waits)[2], "timeout", self.holder))
            else:
                return

    def event(self, at: int, op: str, who: str, seconds: float | None) -> None:
        self.until(at, True)
        own = self.holder == who
        if op == "claim":
            if self.holder is None or own:
                self.holder, self.expires = who, at + _lease(self.ttl)
                self.rows.append((at, op, who, "ok", who))
            else:
                self.rows.append((at, op, who, "held", self.holder))
        elif op == "wait":
            if self.holder is None or own:
                self.rows.append((at, op, who, "deadlock" if own else "ready", self.holder))
            else:
                heapq.heappush(self.waits, (at + int((seconds or 0.0) * SECOND), at, who))
        elif self.holder is not None and own:
            self.rows.append((at, op, who, "ok", None))
            self._free(at)
        elif op == "release":
            self.rows.append((at, op, who, "held" if self.holder is not None else "none", self.holder))

    def due(self) -> list[int]:
        """The moments of which the first is due next."""
        return ([self.expires] if self.holder is not None else []) + [w[0] for w in self.waits[:1]]

    def taken(self) -> list[tuple]:
        out, self.rows = self.rows, []
        return out


def _micros(ts: pd.Series) -> list[int]:
    return ts.to_numpy("datetime64[us]").astype("int64").tolist()


def _lease(ttl: float) -> int:
    return int(max(1.0, ttl) * SECOND)


def _frame(path: str | None, rows: Iterable[tuple]) -> pd.DataFrame:
    out = pd.DataFrame([(path, *r) for r in rows], columns=[c.split()[0] for c in ROWS.split(", ")])
    return out.assign(ts=pd.to_datetime(out["ts"], unit="us"))


ORDER = ["ts", "op", "block_key"]


def timeline(events: DataFrame, ttl: float = TTL) -> DataFrame:
    """ROWS of all events, and of all that happens up to the last of them. The events of a path are one task's, as each row hangs on those before."""
    last = events.agg(F.max("ts").alias("ts")).first()["ts"]
    upto = None if last is None else _micros(pd.Series([last]))[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begun, path, now = False, None, Timeline(ttl)
        for batch in batches:
            for at, ts, op, who, seconds in zip(batch["path"].array, _micros(batch["ts"]), *(batch[c].array for c in (*ORDER[1:], "seconds")), strict=True):
                if not begun or at != path:
                    if begun:
                        now.until(upto)
                        yield _frame(path, now.taken())
                    begun, path, now = True, at, Timeline(ttl)
                now.event(ts, op, who, seconds)
            if now.rows:
                yield _frame(path, now.taken())
        if begun:
            now.until(upto)
            yield _frame(path, now.taken())

    send_package(events.sparkSession)
    rows = by_path(events).withColumn("op", F.when(F.col("op") == "done", "end").otherwise(F.col("op")))
    return rows.select("path", *ORDER, "seconds").repartition("path").sortWithinPartitions("path", *ORDER).mapInPandas(run, ROWS)


def joined(spans: list[list[int]], new: Iterable[int], length: int) -> list[list[int]]:
    """Ordered spans [from, to] that don't meet, together with one of this length from each new moment."""
    out: list[list[int]] = []
    for begin, end in sorted([*spans, *([c, c + length] for c in new)]):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return out


def within(spans: list[list[int]], moments: list[int]) -> set[int]:
    """Those of the ordered moments that lie in a span."""
    return {m for begin, end in spans for m in moments[bisect_left(moments, begin) : bisect_right(moments, end)]}


class Dealer(StatefulProcessor):
    """Passes the events of a bucket of sessions on, and a session's ends once for each path that one of its claims may hold then: a lease lasts no
    longer than its ttl from a claim, so all other ends give no row."""

    def __init__(self, ttl: float = TTL) -> None:
        self.length = _lease(ttl)

    def init(self, handle) -> None:
        #: [[session, [[path, spans in which its claims may hold it]], [end]]], of what the watermark hasn't passed
        self.state = handle.getValueState("state", "json string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        columns = ["ts", "op", "path", "block_key", "seconds"]
        kept = self.state.get()
        sessions = {who: (dict(spans), ends) for who, spans, ends in json.loads(kept[0])} if kept else {}
        claims: dict[str | None, dict[str | None, set[int]]] = {}
        fresh: dict[str | None, set[int]] = {}
        for part in rows:
            done = part["op"] == "done"
            yield part.loc[~done, columns]
            for at, op, path, who in zip(_micros(part["ts"]), part["op"], part["path"], part["block_key"], strict=True):
                if op == "done":
                    fresh.setdefault(who, set()).add(at)
                elif op == "claim":
                    claims.setdefault(who, {}).setdefault(path, set()).add(at)
        dealt = []
        for who in {**claims, **fresh}:
            spans, ends = sessions.get(who, ({}, []))
            new = sorted(fresh.get(who, ()))
            for path in {**spans, **claims.get(who, {})}:
                before = spans.get(path, [])
                spans[path] = now = joined(before, claims.get(who, {}).get(path, ()), self.length)
                # new ends reach all paths, earlier ones those that they haven't reached
                dealt += [(e, path, who) for e in sorted(within(now, new) | within(now, ends) - within(before, ends))]
            sessions[who] = (spans, sorted({*ends, *new}))
        if dealt:
            at, paths, who = zip(*dealt, strict=True)
            yield pd.DataFrame({"ts": pd.to_datetime(pd.Series(at), unit="us"), "op": "end", "path": paths, "block_key": who, "seconds": None}, columns=columns)
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rest = []
        for who, (spans, ends) in sessions.items():
            left = [[path, found] for path, each in spans.items() if (found := [x for x in each if x[1] >= passed])], [e for e in ends if e > passed]
            if any(left):
                rest.append([who, *left])
        if rest:
            self.state.update((json.dumps(rest),))
        elif kept:
            self.state.clear()

    def close(self) -> None:
        pass


class Holder(StatefulProcessor):
    """The timeline of a path: what the watermark has passed is out, the rest is state with one timer."""

    def __init__(self, ttl: float = TTL) -> None:
        self.ttl = ttl

    def init(self, handle) -> None:
        self.handle = handle
        #: {"lease": [holder, expires], "waits": [[deadline, since, waiter]], "timer": at or null, "pending": whether there are events}
        self.state = handle.getValueState("state", "json string")
        #: Events (ts, op, who, seconds) in order, CHUNK a value.
        self.pending = handle.getListState("pending", "json string")

    def _run(self, key, new: list[tuple], passed_ms: int, fired: int | None = None) -> pd.DataFrame:
        passed = passed_ms * 1000
        kept = self.state.get()
        before = json.loads(kept[0]) if kept else {"lease": [None, 0], "waits": [], "timer": None, "pending": False}
        stored = [tuple(e) for chunk in self.pending.get() for e in json.loads(chunk[0])] if before["pending"] else []
        now = Timeline(self.ttl, *before["lease"], [tuple(w) for w in before["waits"]])
        rest = []
        for e in sorted([*stored, *new], key=lambda e: (e[0], e[1], e[2] or "")):
            if e[0] <= passed:
                now.event(*e)
            else:
                rest.append(e)
        now.until(passed)
        if len(rest) != len(stored) or new:
            self.pending.put([(json.dumps(rest[i : i + CHUNK]),) for i in range(0, len(rest), CHUNK)]) if rest else self.pending.clear()
        due = min([*now.due(), *(e[0] for e in rest[:1])], default=None)
        at, old = None if due is None else -(-due // 1000), before["timer"] if before["timer"] != fired else None
        if at != old:
            if old is not None and old > passed_ms:
                self.handle.deleteTimer(old)
            if at is not None:
                self.handle.registerTimer(at)
        after = {"lease": [now.holder, now.expires], "waits": [list(w) for w in now.waits], "timer": at, "pending": bool(rest)}
        if after != before:
            self.state.update((json.dumps(after),))
        return _frame(key[0], now.taken())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [e for part in rows for e in zip(_micros(part["ts"]), part["op"], part["block_key"], part["seconds"], strict=True)]
        yield self._run(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._run(key, [], timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def streamed(events: DataFrame, ttl: float = TTL, late: str = "0 seconds") -> DataFrame:
    """ROWS from a stream of EVENTS, which need the state store of ROCKSDB: each is out when the watermark has passed it."""
    send_package(events.sparkSession)
    marked = events.withWatermark("ts", late).withColumn("bucket", F.pmod(F.xxhash64("block_key"), F.lit(SESSIONS)))
    dealt = marked.groupBy("bucket").transformWithStateInPandas(Dealer(ttl), EVENTS, "append", "eventTime", eventTimeColumnName="ts")
    return dealt.groupBy("path").transformWithStateInPandas(Holder(ttl), ROWS, "append", "eventTime")
