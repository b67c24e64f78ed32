"""Language identification: script ranges, per-word scores and Viterbi over words.

Words are runs of letters. A word's script (by code point ranges of its letters)
narrows the candidate languages to those that use the script. Its score in a language
is the log-probability of its character trigrams there. A Viterbi path over the words,
with a penalty for each switch, labels spans of mixed-language texts; the language
with the most letters is the text's, its share of the letters the score.

A path that never switches is optimal unless some run of words prefers other languages
by more than the penalty of entering it; that is checked for whole batches at once
(largest sum of a run of consecutive gains), and only texts that fail the check are
decoded word by word.

Letters are the code points of category L; marks (M) belong to the word whose letter they
follow, so that vowel signs don't split words. Number characters and anything else don't.

Trigrams are counted in a sample of about TRAIN_TEXTS texts of each language, chosen
by a hash of the id, whole texts each. Every language is learned and every trigram of the
sample counts. A model has CELLS numbers at most: CELLS / languages columns, of which the
first half belongs to one trigram each, the commonest first, and the rest is shared by all
other trigrams by their hash, if there are any. More than MOST_LANGS languages raise an
error. Scores of words are kept up to CACHE bytes, and texts are scored in pieces of CHUNK
bytes, the longest too, so that memory doesn't grow with languages or length.

Null languages are not learned from. A text that is null or has no letter is `und` with score
0, and so is every text if nothing was learned. Ties go to the first language in code
point order. Repeated rows give repeated rows and equal texts equal values. Very long
texts are labelled whole. Ids are integers or null. Empty tables give empty results.
Extra columns are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import cut, held_out, map_arrow, table

TRAIN_TEXTS = 1500
#: Numbers of a model, own columns at most, and languages at most (each then has 64 columns).
CELLS, OWN, MOST_LANGS = 1 << 24, 500_000, 1 << 18
#: Bytes of kept word scores, and of the scores of the words that are decoded at once.
CACHE, CHUNK = 128 << 20, 32 << 20
MODULUS, REMAINDER = 4, 2
SWITCH = 12.0
#: A language uses a script if this share of its words is written in it.
SCRIPT_SHARE = 0.01
#: Score of a language that doesn't use a word's script; finite, so that a path through it exists.
FOREIGN = -60.0
SMOOTHING = 0.5
#: First code points of script ranges and their names; letters before the first and between named ones are "other".
RANGES = (
    (0x0041, "latin"), (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"),
    (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
)
_FIRST = [a for a, _ in RANGES]


def _class(of: str, past: int = sys.maxunicode + 1) -> str:
    """The characters below `past` of the categories `of`, as ranges for a pattern."""
    points = [i for i in range(128, past) if unicodedata.category(chr(i)) in of.split()]
    edges = [k for k, i in enumerate(points) if not k or i != points[k - 1] + 1]
    return "".join(f"{chr(points[a])}-{chr(points[b - 1])}" for a, b in zip(edges, [*edges[1:], len(points)], strict=True))


#: Word characters that are neither letters nor decimal digits, and marks.
_NUMBERS, _MARKS = _class("Nl No"), _class("Mn Mc Me")
_WORD = re.compile(rf"[^\W\d_{_NUMBERS}]+")
_MARK = re.compile(f"[{_MARKS}]")
_MARKED_WORD = re.compile(rf"[^\W\d_{_NUMBERS}](?:[^\W\d_{_NUMBERS}]|[{_MARKS}])*")


#: The same below the first mark, where few characters are excluded.
_FIRST_MARK = "\u0300"
_EARLY_WORD = re.compile(rf"[^\W\d_{_class('No', 0x300)}]+")


def words(text: str | None) -> list[str]:
    low = (text or "").lower()
    if not low or max(low) < _FIRST_MARK:
        return _EARLY_WORD.findall(low)
    return (_MARKED_WORD if _MARK.search(low) else _WORD).findall(low)


def script(word: str) -> str:
    """The script of most letters, the first one of equals."""
    if max(word) < "\u0250":
        return "latin"
    return Counter(RANGES[k][1] if (k := bisect_right(_FIRST, ord(c)) - 1) >= 0 else "other" for c in word).most_common(1)[0][0]


def trigrams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


class Grams(dict):
    """Columns of trigrams; those without a column of their own share the `shared` columns after the own ones."""

    shared = 0

    def get(self, gram: str, unseen: int) -> int:
        at = dict.get(self, gram)
        if at is not None:
            return at
        return len(self) + zlib.crc32(gram.encode()) % self.shared if self.shared else unseen


@dataclass
class Model:
    langs: list[str]
    grams: dict[str, int]
    #: log-probabilities, languages x columns; the last column is of unseen trigrams
    logp: np.ndarray
    #: by script: whether a language uses it
    uses: dict[str, np.ndarray]
    switch: float = SWITCH

    def word_scores(self, found: list[str]) -> np.ndarray:
        """Words x languages."""
        if (most := max(1, CHUNK // (64 * max(1, len(self.langs))))) < len(found):
            return np.concatenate([self.word_scores(found[i : i + most]) for i in range(0, len(found), most)])
        unseen, get = self.logp.shape[1] - 1, self.grams.get
        each = [trigrams(w) for w in found]
        ids = np.fromiter((get(g, unseen) for gs in each for g in gs), np.int64)
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        out = np.add.reduceat(self.logp.T[ids].astype(np.float64), np.cumsum(sizes) - sizes)
        for i, name in enumerate(map(script, found)):
            uses = self.uses.get(name)
            if uses is not None and uses.any() and not uses.all():
                out[i] = np.where(uses, out[i], FOREIGN + np.minimum(0, out[i]))
        return out

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """The Viterbi path: language by word. Lists are faster than arrays for a few languages."""
        rows = scores.tolist()
        best, switch = rows[0], self.switch
        trail, floors = [], []
        for row in rows[1:]:
            floor = max(best) - switch
            trail.append(best)
            floors.append(floor)
            best = [(b if b >= floor else floor) + s for b, s in zip(best, row, strict=True)]
        path = np.empty(len(rows), np.int64)
        at = best.index(max(best))
        path[-1] = at
        for t in range(len(trail) - 1, -1, -1):
            if trail[t][at] < floors[t]:
                at = trail[t].index(max(trail[t]))
            path[t] = at
        return path


class Tagger:
    """Labels batches of texts with a model; keeps the scores of words seen before."""

    def __init__(self, model: Model) -> None:
        self.model = model
        width = 8 * max(1, len(model.langs))
        self.most, self.at_once = max(1024, CACHE // width), max(16, CHUNK // width)
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.scores = np.zeros((1024, max(1, len(self.model.langs))))

    def numbers(self, found: list[str]) -> np.ndarray:
        row = self.row
        new = [w for w in dict.fromkeys(found) if w not in row]
        if new:
            first = len(row)
            row.update(zip(new, range(first, first + len(new)), strict=True))
            while len(row) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.scores[first : len(row)] = self.model.word_scores(new)
        return np.fromiter(map(row.__getitem__, found), np.int64, len(found))

    def long_path(self, found: list[str]) -> np.ndarray:
        """As Model.decode, by pieces of at_once words: of each step only whether a path stays in its language, and the best one, are kept."""
        best, stays, bests = None, [], []
        for first in range(0, len(found), self.at_once):
            if len(self.row) > self.most:
                self.clear()
            for row in self.scores[self.numbers(found[first : first + self.at_once])]:
                if best is None:
                    best = row.copy()
                    continue
                floor = best.max() - self.model.switch
                stays.append(np.packbits(best >= floor))
                bests.append(int(best.argmax()))
                best = np.maximum(best, floor) + row
        at = int(best.argmax())
        path = np.empty(len(found), np.int64)
        path[-1] = at
        for t in range(len(bests) - 1, -1, -1):
            if not stays[t][at >> 3] >> (7 - (at & 7)) & 1:
                at = bests[t]
            path[t] = at
        return path

    def paths(self, texts: list[list[str]]) -> list[np.ndarray]:
        """For each list of words the language by word."""
        if not self.model.langs:
            return [np.zeros(0, np.int64)] * len(texts)
        out, group, held = [], [], 0
        for t in texts:
            if group and held + len(t) > self.at_once:
                out += self.group_paths(group)
                group, held = [], 0
            if len(t) > self.at_once:
                out.append(self.long_path(t))
            else:
                group.append(t)
                held += len(t)
        return out + self.group_paths(group)

    def group_paths(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.row) > self.most:
            self.clear()
        sizes = np.array([len(t) for t in texts], np.int64)
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
        full = np.nonzero(sizes)[0]
        if not len(full):
            return out
        rows = self.numbers([w for i in full for w in texts[i]])
        scores = self.scores[rows]
        sizes = sizes[full]
        starts = np.cumsum(sizes) - sizes
        doc = np.repeat(np.arange(len(full)), sizes)
        single = np.add.reduceat(scores, starts).argmax(1)
        # gains of the best other language over the one that fits the whole text best
        gain = scores.max(1) - scores[np.arange(len(doc)), single[doc]]
        other = scores.copy()
        other[np.arange(len(doc)), single[doc]] = -np.inf
        gain = np.where(gain > 0, gain, other.max(1) - scores[np.arange(len(doc)), single[doc]]) if scores.shape[1] > 1 else gain - 1
        upto = np.cumsum(np.maximum(gain, -1e4))
        before = upto - np.maximum(gain, -1e4)
        # running minimum of the sums before each word, from the text's first word on
        shift = doc * (np.abs(upto).max() * 2 + 1.0)
        largest = np.maximum.reduceat(upto - (np.minimum.accumulate(before - shift) + shift), starts)
        for k, i in enumerate(full):
            a, b = starts[k], starts[k] + sizes[k]
            out[i] = np.full(sizes[k], single[k]) if largest[k] < self.model.switch - 1e-3 else self.model.decode(scores[a:b])
        return out

    def tag(self, texts: list[str | None]) -> Iterator[tuple[str, float, list[tuple[str, int, int]]]]:
        """For each text: language, score, spans (language, first word, words past)."""
        found = [words(t) for t in texts]
        langs = self.model.langs
        for ws, path in zip(found, self.paths(found), strict=True):
            if not len(path):
                yield "und", 0.0, []
                continue
            letters = np.bincount(path, np.fromiter(map(len, ws), np.int64, len(ws)), len(langs))
            best = int(letters.argmax())
            edges = [0, *(np.nonzero(np.diff(path))[0] + 1).tolist(), len(path)]
            yield langs[best], float(letters[best] / letters.sum()), [(langs[path[a]], a, b) for a, b in zip(edges, edges[1:], strict=False)]


_taggers: dict[int, Tagger] = {}


def train(docs: DataFrame, modulus: int = MODULUS, remainder: int = REMAINDER, texts: int = TRAIN_TEXTS) -> Model:
    """A model from docs (doc_id, text, lang). The driver gets trigram counts of about `texts` texts a language."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder))
    n = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGS + 1).collect()}
    if not n:
        return Model([], {}, np.zeros((0, 1)), {})
    if len(n) > MOST_LANGS:
        raise ValueError(f"there are more than {MOST_LANGS} languages: a model of CELLS numbers has too few for each")
    # a hash bound keeps each language's share of the rows near `texts`, without sorting
    bounds = docs.sparkSession.createDataFrame([(lang, min(1.0, texts / k)) for lang, k in n.items()], "lang string, bound double")
    draw = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 20)) / float(1 << 20)
    # a row for each language, MOST_LANGS at most
    sample = known.join(F.broadcast(bounds), "lang").where(draw < F.col("bound")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[tuple[str, str, str]] = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w, k in Counter(words(text)).items():
                    counts[lang, "script", script(w)] += k
                    for g in trigrams(w):
                        counts[lang, "gram", g] += k
            if counts:
                lang, kind, what = (list(x) for x in zip(*counts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(kind), pa.array(what), pa.array(list(counts.values()), pa.int64())], names=["lang", "kind", "what", "n"])

    counted = map_arrow(sample, count, "lang string, kind string, what string, n long").groupBy("lang", "kind", "what").agg(F.sum("n").alias("n"))
    counted = cut(counted)
    langs = sorted(n, key=lambda x: x.encode())
    at = {lang: i for i, lang in enumerate(langs)}
    columns = CELLS // len(langs)
    totals = counted.where("kind = 'gram'").groupBy("what").agg(F.sum("n").alias("n"))
    own = [r["what"] for r in totals.orderBy(F.desc("n"), "what").limit(min(OWN, columns // 2)).select("what").collect()]
    grams = Grams((g, i) for i, g in enumerate(sorted(own)))
    # columns that trigrams without one of their own share
    grams.shared = columns // 2 if totals.count() > len(grams) else 0
    # no more rows than own columns
    places = docs.sparkSession.createDataFrame(list(grams.items()) or [("", 0)], "what string, place int")
    shared = F.lit(len(grams)) + F.crc32(F.col("what").cast("binary")) % max(1, grams.shared)
    cells = counted.where("kind = 'gram'").join(F.broadcast(places), "what", "left").groupBy("lang", F.coalesce("place", shared).cast("int").alias("place")).agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(grams) + grams.shared + 1, len(langs)), np.float32).T
    lang_at = np.array([at[x] for x in cells["lang"].to_pylist()], np.int64)
    counts[lang_at, cells["place"].to_numpy()] = cells["n"].to_numpy()
    scripts: dict[str, np.ndarray] = {}
    for lang, what, k in counted.where("kind = 'script'").select("lang", "what", "n").collect():
        scripts.setdefault(what, np.zeros(len(langs)))[at[lang]] = k
    sums = counts.sum(1, keepdims=True, dtype=np.float64)
    logp = counts
    for i in range(len(langs)):
        logp[i] = np.log((counts[i].astype(np.float64) + SMOOTHING) / (sums[i] + SMOOTHING * counts.shape[1]))
    total = np.maximum(1, sum(scripts.values(), np.zeros(len(langs))))
    return Model(langs, grams, logp, {s: k / total >= SCRIPT_SHARE for s, k in scripts.items()})


def tagged(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score), with `spans` also the labelled spans in words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = hash((id(model), model.logp.tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _taggers:
            _taggers.clear()
            _taggers[key] = Tagger(shared.value)
        tagger = _taggers[key]
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                rows = batch.slice(part, 500)
                lang, score, found = (list(x) for x in zip(*tagger.tag(rows.column(1).to_pylist()), strict=True))
                out = [rows.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())]
                if spans:
                    kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("past", pa.int64())]))
                    out.append(pa.array([[{"lang": x, "first": a, "past": b} for x, a, b in s] for s in found], kind))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "lang_pred", "score", "spans"][: len(out)])

    schema = "doc_id long, lang_pred string, score double" + ", spans array<struct<lang: string, first: long, past: long>>" * spans
    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema)


def op7_viterbi_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    out = tagged(table(spark, sf_dir, "documents", "doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id"), MODULUS, REMAINDER).alias("held_out"), "lang_pred", "score")


QUERIES = {"op7_viterbi_langid": op7_viterbi_langid}
ORACLES: dict[str, str] = {}
