"""Toxicity: a logistic classifier with a counterfactual penalty.

Features of a text are the words it holds and the first 4, 5 and 6 characters of its
longer words; of those commoner in label 1, the ones that best tell the labels apart
are kept (log-likelihood ratio), besides all identity terms.

Counterfactuals swap identity terms in labelled texts for others of their kind, in the
kinds of the text's language (that of most function words). A text that names a group
is paired with its swap. As few texts do, every labelled text is also paired with
itself in another way: a neutral sentence that mentions a group is set into it, once
with one term and once with the next; the first of the two is trained on with the
text's label, so that terms have rows on any corpus. Training adds `strength` times the
mean squared difference of the two scores of a pair, so that naming a group doesn't
raise the score.

The model is fitted on at most TRAIN_ROWS labelled rows (chosen by a hash of the id).
Scores are of whole texts, however long. Nulls: a null or empty text has no feature and
the score of the bias. Ties: of features that tell equally well the first in code point
order are kept. Repeated rows count as often as they occur among the labelled rows, and
get equal scores. With no labelled row of either kind the score is the share of label 1
(0 without labels). Empty tables give empty results. Extra columns are kept by `score`.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import added, free, held_out, map_arrow, table
from quarry.llm.labelled import log_likelihood_ratio, training_rows

TRAIN_ROWS = 8000
FEATURES = 1500
#: A feature counts if this many training texts have it.
LEAST = 4
THRESHOLD = 0.3
MODULUS, REMAINDER = 4, 2
STRENGTH = 16.0
EPOCHS, RATE, DECAY = 300, 0.3, 1e-4

#: Kinds of identity terms: language, a neutral sentence that mentions one, the terms. A swap stays inside a kind.
IDENTITY: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("en", "the {} were here", ("women", "men")),
    ("en", "a {} was here", ("woman", "man")),
    ("en", "the {} were here", ("girls", "boys")),
    ("en", "a {} was here", ("girl", "boy")),
    ("en", "a {} person was here", ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist")),
    ("en", "the {} were here", ("christians", "muslims", "jews", "hindus", "buddhists", "atheists")),
    ("en", "a {} person was here", ("black", "white", "asian", "latino", "african", "european")),
    ("en", "a {} person was here", ("gay", "straight", "lesbian", "bisexual", "transgender")),
    ("en", "an {} was here", ("immigrant", "native", "refugee", "foreigner")),
    ("en", "the {} were here", ("immigrants", "natives", "refugees", "foreigners")),
    ("en", "an {} person was here", ("old", "young")),
    ("en", "a {} person was here", ("disabled", "blind", "deaf")),
    ("fr", "une personne comme {} est venue", ("femme", "homme")),
    ("fr", "les {} sont ici", ("femmes", "hommes")),
    ("fr", "il est {}", ("juif", "musulman", "chrétien")),
    ("de", "hier war ein Mensch, {}", ("frau", "mann")),
    ("de", "die {} waren hier", ("frauen", "männer")),
    ("de", "er ist {}", ("jude", "muslim", "christ")),
    ("es", "aquí estaba la persona, {}", ("mujer", "hombre")),
    ("es", "las personas, {}", ("mujeres", "hombres")),
    ("es", "es {}", ("judío", "musulmán", "cristiano")),
)
#: Function words that tell the languages of IDENTITY apart; without any a text counts as the first language.
FUNCTION = {
    "en": frozenset("the of and to in is was that for with".split()),
    "fr": frozenset("le la les et des est une du dans pour".split()),
    "de": frozenset("der die und das ist nicht den ein mit auf".split()),
    "es": frozenset("el los las y que del por una para con".split()),
}

_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    return [f"={word}", *(f"^{word[:k]}" for k in (4, 5, 6) if len(word) > k)]


def features(words: set[str]) -> set[str]:
    return {f for w in words for f in word_features(w)}


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


class Swaps:
    """Counterfactuals of sets of words."""

    def __init__(self, identity: Sequence[tuple[str, str, Sequence[str]]] = IDENTITY) -> None:
        self.kinds: dict[str, list[tuple[frozenset[str], Sequence[str]]]] = {}
        self.next: dict[str, dict[str, str]] = {}
        for lang, mention, terms in identity:
            self.kinds.setdefault(lang, []).append((frozenset(words(mention.format(" "))), terms))
            self.next.setdefault(lang, {}).update((t, terms[(i + 1) % len(terms)]) for i, t in enumerate(terms))
        self.terms = sorted({t for own in self.next.values() for t in own})

    def language(self, ws: set[str]) -> str:
        return max(self.kinds, key=lambda lang: len(ws & FUNCTION.get(lang, frozenset())))

    def swapped(self, ws: set[str]) -> set[str] | None:
        """ws with each identity term swapped for the next of its kind; None without one."""
        own = self.next[self.language(ws)]
        return None if ws.isdisjoint(own) else {own.get(w, w) for w in ws}

    def mentions(self, ws: set[str], draw: int) -> tuple[set[str], set[str]]:
        """The words of a neutral mention and of the same one with the next term; draw chooses both."""
        kinds = self.kinds[self.language(ws)]
        mention, terms = kinds[draw % len(kinds)]
        at = draw // len(kinds) % len(terms)
        return mention | {terms[at]}, mention | {terms[(at + 1) % len(terms)]}


@dataclass
class Model:
    bias: float
    weights: dict[str, float] = field(default_factory=dict)

    def scores(self, texts: list[str | None], seen: dict[str, tuple[str, ...]]) -> np.ndarray:
        """seen keeps the features of words from call to call."""
        z = np.empty(len(texts))
        weights = self.weights
        for i, text in enumerate(texts):
            found: set[str] = set()
            for w in words(text):
                hits = seen.get(w)
                if hits is None:
                    if len(seen) > 150_000:
                        seen.clear()
                    hits = seen[w] = tuple(f for f in word_features(w) if f in weights)
                if hits:
                    found.update(hits)
            # in a fixed order, so that reruns agree to the last bit
            z[i] = self.bias + sum(weights[f] for f in sorted(found))
        return sigmoid(z)


@dataclass
class Example:
    """A labelled text: its features, what a neutral mention adds and what the next one does instead, and what a swap of its own terms adds and takes."""

    label: int
    x: list[int]
    mention: list[int] = field(default_factory=list)
    other: list[int] = field(default_factory=list)
    gains: list[int] | None = None
    loses: list[int] | None = None


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(rows: list[Example], size: int, strength: float = STRENGTH) -> tuple[float, np.ndarray]:
    """Bias and weights. Variants of a text are kept as what they add to it and take from it."""
    n = len(rows)
    at = np.repeat(np.arange(n), [len(r.x) for r in rows])
    col = np.array([c for r in rows for c in r.x], np.int64)
    # variants: the text, features added (1.0) and taken (-1.0)
    variants: list[tuple[int, list[int], list[int]]] = []
    pairs: list[tuple[int, int]] = []
    trained = [True] * n
    for i, r in enumerate(rows):
        if r.mention or r.other:
            pairs.append((n + len(variants), n + len(variants) + 1))
            variants += [(i, r.mention, []), (i, r.other, [])]
            trained += [True, False]
        if r.gains is not None:
            pairs.append((i, n + len(variants)))
            variants.append((i, r.gains, r.loses or []))
            trained.append(False)
    base = np.array([v[0] for v in variants], np.int64)
    d_at = np.repeat(np.arange(len(variants)), [len(a) + len(b) for _, a, b in variants])
    d_col = np.array([c for _, a, b in variants for c in (*a, *b)], np.int64)
    d_sign = np.array([x for _, a, b in variants for x in ([1.0] * len(a) + [-1.0] * len(b))])
    one, two = np.array(pairs, np.int64).reshape(-1, 2).T
    label = np.array([r.label for r in rows], float)
    y, counts = np.concatenate([label, label[base]]), np.array(trained, float)
    counts /= counts.sum()
    share = float(np.clip(label.mean(), 1e-6, 1 - 1e-6))
    bias, w = float(np.log(share / (1 - share))), np.zeros(size)
    squares, bias_squares = np.full(size, 1e-8), 1e-8
    for _ in range(EPOCHS):
        z = bias + np.bincount(at, w[col], n)
        p = sigmoid(np.concatenate([z, z[base] + np.bincount(d_at, d_sign * w[d_col], len(base))]))
        slope = counts * (p - y)
        if pairs:
            pull = 2 * strength / len(pairs) * (p[one] - p[two])
            steep = p * (1 - p)
            slope += np.bincount(one, pull * steep[one], len(p)) - np.bincount(two, pull * steep[two], len(p))
        of_row = slope[:n] + np.bincount(base, slope[n:], n)
        g = np.bincount(col, of_row[at], size) + np.bincount(d_col, d_sign * slope[n:][d_at], size) + DECAY * w
        squares += g * g
        w -= RATE * g / np.sqrt(squares)
        bias_g = float(slope.sum())
        bias_squares += bias_g * bias_g
        bias -= RATE * bias_g / bias_squares**0.5
    return bias, w


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = MODULUS, remainder: int = REMAINDER, rows: int = TRAIN_ROWS, size: int = FEATURES, identity: Sequence[tuple[str, str, Sequence[str]]] = IDENTITY, strength: float = STRENGTH) -> Model:
    """A model from docs (doc_id, text) and labels. The driver gets `size` features and their numbers in `rows` texts."""
    sample = training_rows(docs.select("doc_id", F.col("text").cast("string").alias("text")), labels, label, modulus, remainder, rows)
    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        share = 1.0 if n.get(1) else 0.0
        return Model(35.0 * (2 * share - 1))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(features(words(text)))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([y] * len(found), pa.int32())], names=["feature", "label"])

    counted = map_arrow(sample.select("text", "label"), spell, "feature string, label int").groupBy("feature").agg(F.sum("label").cast("double").alias("pos"), F.sum(1 - F.col("label")).cast("double").alias("neg"))
    telling = (F.col("pos") + F.col("neg") >= LEAST) & (F.col("pos") * n[0] > F.col("neg") * n[1])
    best = counted.where(telling).withColumn("llr", log_likelihood_ratio(F.col("pos"), F.col("neg"), n[1], n[0])).orderBy(F.desc("llr"), "feature").limit(size)
    chosen = {r["feature"]: None for r in best.select("feature").collect()}
    swaps = Swaps(identity)
    chosen |= {f"={t}": None for t in swaps.terms}
    number = {f: i for i, f in enumerate(chosen)}

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = lambda ws: {number[f] for f in features(ws) if f in number}
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text in batch.column(0).to_pylist():
                ws = words(text)
                x = coded(ws)
                for kept, added_words in zip(out[1:3], swaps.mentions(ws, zlib.crc32((text or "").encode())), strict=True):
                    kept.append(sorted(coded(added_words) - x))
                swapped = swaps.swapped(ws)
                other = x if swapped is None else coded(swapped)
                out[0].append(sorted(x))
                out[3].append(None if swapped is None else sorted(other - x))
                out[4].append(None if swapped is None else sorted(x - other))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *(pa.array(c, pa.list_(pa.int32())) for c in out)], names=["doc_id", "label", *lists])

    lists = ("x", "mention", "other", "gains", "loses")
    got = map_arrow(sample.select("text", "doc_id", "label"), code, "doc_id long, label int, " + ", ".join(f"{c} array<int>" for c in lists)).collect()
    # rows that are equal in all this are the same to the fit, whatever their order
    examples = [Example(*r[1:]) for r in sorted(map(tuple, got), key=repr)]
    bias, w = fit(examples, len(number), strength)
    return Model(bias, {f: float(w[i]) for f, i in number.items() if w[i]})


def score_changes(model: Model, texts: Sequence[str | None], identity: Sequence[tuple[str, str, Sequence[str]]] = IDENTITY) -> np.ndarray:
    """How much the score of each text changes when a neutral mention in it names another group."""
    swaps = Swaps(identity)
    sides = zip(*(swaps.mentions(words(t), zlib.crc32((t or "").encode())) for t in texts), strict=True)
    one, two = (model.scores([f"{t or ''} {' '.join(sorted(m))}" for t, m in zip(texts, side, strict=True)], {}) for side in sides)
    return np.abs(one - two)


def score(docs: DataFrame, model: Model, column: str = "_score") -> DataFrame:
    """docs (with a column text) and the scores in a new column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                rows = batch.slice(part, 500)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(shared.value.scores(rows.column(at).to_pylist(), seen))], names=[*rows.schema.names, column])

    return map_arrow(docs, run, added(docs, (column, T.DoubleType())))


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold."""
    column = free(docs, "_score")
    return score(docs, model, column).where(F.col(column) < threshold).drop(column)


def op5_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id"), MODULUS, REMAINDER).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op5_counterfactual_toxicity": op5_counterfactual_toxicity}
ORACLES: dict[str, str] = {}
