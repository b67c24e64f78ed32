"""Benchmark decontamination with a generalised suffix automaton.

Words: A-Z lower-cased, then runs of a-z, 0-9 and characters beyond ASCII. A window is
`window` consecutive words of an item; an item of fewer words, but not none, is one
window. The automaton holds every run of words of every item. A document's words are
streamed through it: at each word it knows the longest run of item words that ends
there, so every run of `window` words or more, and every whole short item, is found.
Words that are in no item, and pairs of words that follow each other in no item, end
every match; they are skipped by numpy, and only the runs between them are streamed.

The automaton is built on the driver from at most `limit` benchmark words and sent to
the executors; it is kept in arrays, in about 200 bytes a word. Larger benchmarks are
dealt to several automata of that size, applied one after the other.

Nulls: null texts have no words; a null item id is the text `null`. Empty tables give
empty results or no hit. Repeated rows return repeated rows, repeated items count once,
and items that share a window are all found. Texts are scanned whole, however long.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import added, cut, free, id_text, map_arrow, table

WINDOW = 10
#: Benchmark words that one automaton holds at most (one item may exceed it alone).
LIMIT = 1_000_000
#: Most bits of the number of a word pair.
PAIR_BITS = 24
MIN_SPAN, MAX_COVERAGE = 10, 0.5

_KEPT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    """The words in UTF-8: every byte outside them counts as a space."""
    return (text or "").encode().translate(_KEPT).split()


class Automaton:
    """A generalised suffix automaton over word numbers; state 0 is the empty run. Most states have one following word, so that
    stands in arrays (first, to) and only further ones in dictionaries (more)."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.first, self.to, self.link, self.length = array("i", [0]), array("i", [0]), array("i", [-1]), array("i", [0])
        self.more: dict[int, dict[int, int]] = {}
        self.vocabulary: dict[bytes, int] = {}
        self.bits = min(PAIR_BITS, max(12, (8 * sum(len(item) for _, item in items)).bit_length()))
        self.pairs = np.zeros(1 << self.bits, bool)
        self.shortest = window
        self.names: list[str] = []
        coded = []
        for name, item in items:
            if item:
                numbers = array("i", (self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in item))
                self.names.append(name)
                coded.append(numbers)
                self.shortest = min(self.shortest, len(numbers))
                state = 0
                for c in numbers:
                    state = self._extend(state, c)
                if len(numbers) > 1:
                    self.pairs[self._pair(np.array(numbers[:-1]), np.array(numbers[1:]))] = True
        #: by state: (words, item) of short items that end there
        self.short: dict[int, list[tuple[int, int]]] = {}
        marks = array("q")
        for item, numbers in enumerate(coded):
            self._mark(item, numbers, marks)
        pairs = np.unique(np.frombuffer(marks, np.int64)) if marks else np.zeros(0, np.int64)
        #: items by window state: those of state s are held[start[s] : start[s + 1]]
        self.start = array("i", np.searchsorted(pairs >> 32, np.arange(len(self.length) + 1)).astype(np.int32).tobytes())
        self.held = array("i", (pairs & 0xFFFFFFFF).astype(np.int32).tobytes())
        #: by state: the state of the window that ends there; the longest state with short items that ends there, and its next shorter one
        self.at, self.ends = array("i", bytes(4 * len(self.length))), array("i", [-1]) * len(self.length)
        for s in np.argsort(np.frombuffer(self.length, np.int32), kind="stable")[1:].tolist():
            up = self.link[s]
            if self.length[s] >= window:
                self.at[s] = s if self.length[up] < window else self.at[up]
            self.ends[s] = s if s in self.short else self.ends[up]

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.int64) * 1_000_003 + b) & ((1 << self.bits) - 1)

    def _new(self, length: int, link: int) -> int:
        self.first.append(0)
        self.to.append(0)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _next(self, state: int, c: int) -> int:
        """The state after state and c, -1 if none."""
        if self.first[state] == c:
            return self.to[state]
        further = self.more.get(state)
        return further.get(c, -1) if further else -1

    def _set(self, state: int, c: int, to: int) -> None:
        if self.first[state] in (0, c):
            self.first[state], self.to[state] = c, to
        else:
            self.more.setdefault(state, {})[c] = to

    def _split(self, p: int, c: int) -> int:
        """The state of p's run followed by c, which exists, as one whose longest run is that."""
        q = self._next(p, c)
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._new(self.length[p] + 1, self.link[q])
        self.first[twin], self.to[twin] = self.first[q], self.to[q]
        if q in self.more:
            self.more[twin] = dict(self.more[q])
        self.link[q] = twin
        while p >= 0 and self._next(p, c) == q:
            self._set(p, c, twin)
            p = self.link[p]
        return twin

    def _extend(self, last: int, c: int) -> int:
        if self._next(last, c) >= 0:
            return self._split(last, c)
        state, p = self._new(self.length[last] + 1, 0), last
        while p >= 0 and self._next(p, c) < 0:
            self._set(p, c, state)
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, c)
        return state

    def _mark(self, item: int, numbers: array, marks: array) -> None:
        state, n, least = 0, len(numbers), min(self.window, len(numbers))
        for i, c in enumerate(numbers):
            state = self._next(state, c)
            if i + 1 >= least:
                up = state
                while self.length[self.link[up]] >= least:
                    up = self.link[up]
                if n < self.window:
                    self.short.setdefault(up, []).append((n, item))
                else:
                    marks.append(up << 32 | item)

    def stream(self, numbers: list[int], offset: int, spans: list[list[int]], found: set[str]) -> None:
        """Adds the hit spans [first, past) of a run of words, and the items."""
        state = matched = 0
        link, length, window, step = self.link, self.length, self.window, self._next
        for i, c in enumerate(numbers, offset):
            while (after := step(state, c)) < 0 and state:
                state = link[state]
                matched = length[state]
            if after >= 0:
                state = after
                matched += 1
            reach = 0
            if matched >= window:
                reach = matched
                s = self.at[state]
                found.update(self.names[k] for k in self.held[self.start[s] : self.start[s + 1]])
            s = self.ends[state]
            while s > 0:
                for n, item in self.short[s]:
                    if n <= matched:
                        reach = max(reach, n)
                        found.add(self.names[item])
                s = self.ends[link[s]]
            if reach:
                first = i + 1 - reach
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append([first, i + 1])

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, list[list[int]], set[str]]]:
        """For each text: its number of words, the hit spans in words, the items."""
        split = [words(t) for t in texts]
        sizes = [len(w) for w in split]
        # a 0 after each text ends its last run
        numbers = np.zeros(sum(sizes) + len(split), np.int64)
        starts, at = [], 0
        for w in split:
            starts.append(at)
            numbers[at : at + len(w)] = np.fromiter(map(self.vocabulary.get, w, repeat(0)), np.int64, len(w))
            at += len(w) + 1
        hits: list[tuple[list[list[int]], set[str]]] = [([], set()) for _ in split]
        if self.vocabulary and len(numbers):
            known = numbers > 0
            linked = np.zeros(len(numbers) + 1, bool)
            linked[1:-1] = known[:-1] & known[1:] & self.pairs[self._pair(numbers[:-1], numbers[1:])]
            first = np.nonzero(known & ~linked[:-1])[0]
            past = np.nonzero(known & ~linked[1:])[0] + 1
            for k in np.nonzero(past - first >= self.shortest)[0]:
                doc = int(np.searchsorted(starts, first[k], "right")) - 1
                self.stream(numbers[first[k] : past[k]].tolist(), int(first[k]) - starts[doc], *hits[doc])
        for size, (spans, found) in zip(sizes, hits, strict=True):
            yield size, spans, found


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for first, past in sorted(spans):
        if out and out[-1][1] >= first:
            out[-1][1] = max(out[-1][1], past)
        else:
            out.append([first, past])
    return out


def automata(benchmark: DataFrame, window: int = WINDOW, limit: int = LIMIT) -> Iterator[Automaton]:
    """Automata of at most `limit` words that hold all items of benchmark (item_id, text); each part is read by itself."""
    # a repeated row has nothing new
    items = cut(benchmark.where(F.col("text").isNotNull()).select(id_text("item_id").alias("item"), F.col("text")).distinct())
    # a word takes a byte and a separator at least; parts are many enough to be small against an automaton
    words_ = items.agg(F.coalesce(F.sum(F.octet_length("text") / 2 + 1), F.lit(0.0))).first()[0]
    parts = 4096 * (1 + int(words_ / (256 * limit)))
    part_of = F.pmod(F.xxhash64("item", "text"), F.lit(parts))
    sized = items.groupBy(part_of.alias("part")).agg(F.sum(F.octet_length("text") / 2 + 1).alias("n"))
    groups: list[list[int]] = []
    room = 0.0
    for part, n in sorted(map(tuple, sized.collect())):
        if not groups or n > room:
            groups.append([])
            room = float(limit)
        groups[-1].append(part)
        room -= n
    for group in groups or [[]]:
        rows = items.where(part_of.isin(group)).collect() if group else []
        yield Automaton([(r["item"], words(r["text"])) for r in rows], window)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = LIMIT, names: tuple[str, str, str] = ("_n_words", "_spans", "_items"), finish: Callable[[list, list, list], tuple[list, list]] | None = None) -> DataFrame:
    """docs (with a column text) and three new columns: the number of words, the hit runs of words as [first, past), the items' ids in order.

    With `finish`, which gets texts, numbers of words and runs and returns new texts and whether to keep each row, the
    result has the columns of docs, made in the same pass.
    """
    spark = docs.sparkSession
    width, at = len(docs.columns), docs.columns.index("text")
    schema = added(docs, *zip(names, (T.LongType(), T.ArrayType(T.ArrayType(T.LongType())), T.ArrayType(T.StringType())), strict=True))

    def scanner(shared: Broadcast, first: bool, end: Callable | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in range(0, batch.num_rows, 500):
                    rows = batch.slice(part, 500)
                    texts = rows.column(at).to_pylist()
                    n, spans, items = (list(x) for x in zip(*shared.value.scan(texts), strict=True))
                    if not first:
                        spans = [merged(a + b) for a, b in zip(rows.column(width + 1).to_pylist(), spans, strict=True)]
                        items = [a | set(b) for a, b in zip(items, rows.column(width + 2).to_pylist(), strict=True)]
                    own, own_names = rows.columns[:width], rows.schema.names[:width]
                    if end:
                        texts, kept = end(texts, n, spans)
                        own[at] = pa.array(texts, pa.string())
                        yield pa.RecordBatch.from_arrays(own, names=own_names).filter(pa.array(kept, pa.bool_()))
                    else:
                        new = [pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
                        yield pa.RecordBatch.from_arrays([*own, *new], names=[*own_names, *names])

        return run

    out, waiting, k = docs, None, 0
    for automaton in automata(benchmark, window, limit):
        if waiting:
            # each further automaton works in a job of its own
            out, k = cut(map_arrow(out, scanner(waiting, k == 0, None), schema)), k + 1
        waiting = spark.sparkContext.broadcast(automaton)
    return map_arrow(out, scanner(waiting, k == 0, finish), added(docs) if finish else schema)


def spans_hit(spans: str = "_spans") -> Column:
    """The number of words in runs."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])


def cut_spans(text: str, spans: list[list[int]]) -> str:
    """The text without the given runs of words, which are numbered as by words()."""
    raw = text.encode()
    places = [m.span() for m in _WORD.finditer(raw)]
    kept, at = [], 0
    for first, past in spans:
        kept.append(raw[at : places[first][0]])
        at = places[past - 1][1]
    return b"".join([*kept, raw[at:]]).decode()


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_span: int = MIN_SPAN, max_coverage: float = MAX_COVERAGE, limit: int = LIMIT) -> DataFrame:
    """docs without benchmark passages: hit runs of `min_span` words or more are cut out of text, and documents of whose words
    more than max_coverage lie in any hit runs go. In those that stay, shorter runs (whole items of a few words) stay too;
    a min_span of 1 cuts them all."""
    names = tuple(free(docs, c) for c in ("_n_words", "_spans", "_items"))

    def finish(texts: list, n: list, spans: list) -> tuple[list, list]:
        long = [[s for s in found if s[1] - s[0] >= min_span] for found in spans]
        kept = [sum(b - a for a, b in found) <= max_coverage * k for found, k in zip(spans, n, strict=True)]
        return [cut_spans(t, found) if found else t for t, found in zip(texts, long, strict=True)], kept

    return scan(docs, benchmark, window, limit, names, finish)


def op9_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = scan(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        spans_hit().alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (F.size("_spans") > 0).alias("contaminated"),
    )


ORACLE = rf"""
WITH w AS (SELECT id, kind, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM (SELECT coalesce(item_id::VARCHAR, 'null') AS id, 'b' AS kind, text FROM benchmark UNION ALL SELECT (row_number() OVER ())::VARCHAR, 'd', text FROM documents)),
i AS (SELECT id AS item, ws, least(len(ws), {WINDOW}) AS n FROM w WHERE kind = 'b' AND len(ws) > 0),
win AS (SELECT DISTINCT item, n, md5(array_to_string(list_slice(ws, p, p + n - 1), ' ')) AS h FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS p FROM i)),
lens AS (SELECT DISTINCT n FROM i),
dw AS (SELECT w.id, n, p, md5(array_to_string(list_slice(ws, p, p + n - 1), ' ')) AS h FROM (SELECT w.id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM w, lens WHERE kind = 'd' AND len(ws) >= n) w),
hit AS (SELECT dw.id, dw.p, dw.n, win.item FROM dw JOIN win USING (n, h)),
pos AS (SELECT id, count(DISTINCT q) AS n_hit FROM (SELECT id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY id),
its AS (SELECT id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM hit GROUP BY id),
d AS (SELECT (row_number() OVER ())::VARCHAR AS id, doc_id FROM documents)
SELECT d.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d JOIN w ON w.id = d.id AND w.kind = 'd' LEFT JOIN pos ON pos.id = d.id LEFT JOIN its ON its.id = d.id
"""

QUERIES = {"op9_suffix_automaton": op9_suffix_automaton}
ORACLES = {"op9_suffix_automaton": ORACLE}
