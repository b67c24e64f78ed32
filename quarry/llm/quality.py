"""Quality: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), where the pairwise sum is
half the sum over factors of (sum v x)^2 - sum v^2 x^2, so scoring takes time linear in
the features. Features: each distinct word of the text, hashed (all words together have
length 1), one of BINS quantile bins for each structure statistic, and bins of the
metadata column (n_chars). Fitted by AdaGrad on at most TRAIN_ROWS labelled rows.

Nulls: a null text is empty; null metadata is the text's own number of characters. With
labels of one kind only, or none, the score is the share of label 1 (0 without labels).
Ties and repeats: labelled rows are taken in an order of all that is learned from, so that
repeated ids give the same machine in every run; repeated rows count as often as they
occur and get equal scores. Very long texts are scored whole. Ids are integers or null.
Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import held_out, map_arrow, table
from quarry.llm.labelled import training_rows

TRAIN_ROWS = 8000
BUCKETS, FACTORS, BINS = 1 << 13, 8, 10
EPOCHS, BATCH, RATE, DECAY = 12, 256, 0.05, 1e-4
THRESHOLD = 0.3
MODULUS, REMAINDER = 5, 0

_WORD = re.compile(r"[^\W\d_]+")
_CLASSES = np.zeros((256, 8))
for _i, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), b"#$%&*@^~=<>\\{}[]_+", b"|", b".,;:!?'\"()-", b"\n", range(128, 256))):
    _CLASSES[list(_bytes), _i] = 1.0


def statistics(text: str, words: list[str], n_chars: float) -> list[float]:
    """Structure statistics and metadata; shares are of the text's bytes, words or lines."""
    raw = text.encode()
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASSES / max(1, len(raw))
    lines = Counter(line for line in text.split("\n") if line)
    n_lines, n_words = sum(lines.values()), len(words)
    tokens = text.split()
    return [
        *shares.tolist(),
        np.log1p(len(raw)),
        np.log1p(n_words),
        sum(map(len, words)) / max(1, n_words),
        len(set(words)) / max(1, n_words),
        1 - len(lines) / max(1, n_lines),
        n_words / max(1, n_lines),
        sum(map(str.isalpha, tokens)) / max(1, len(tokens)),
        sum(map(str.isupper, tokens)) / max(1, len(tokens)),
        np.log1p(n_chars),
        len(text) / max(1.0, n_chars),
    ]


STATISTICS = len(statistics("", [], 0))


class Hashed:
    """Hashed numbers of words, kept for words seen before."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def __call__(self, words: set[str]) -> list[int]:
        seen = self.seen
        if len(seen) > 300_000:
            seen.clear()
        out = []
        for w in words:
            if (n := seen.get(w)) is None:
                n = seen[w] = zlib.crc32(w.encode()) % BUCKETS
            out.append(n)
        return sorted(out)


def raw_features(text: str | None, n_chars: int | None, hashed: Hashed) -> tuple[list[int], list[float]]:
    text = text or ""
    words = _WORD.findall(text.lower())
    # isupper and the like look at the text as it is
    return hashed(set(words)), statistics(text, words, float(len(text) if n_chars is None else max(0, n_chars)))


@dataclass
class Machine:
    """bias, w (features), v (features x factors), edges (statistics x bins - 1). Features: buckets, then bins of each statistic."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    edges: np.ndarray

    def columns(self, hashed: list[list[int]], stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row starts, features, values) of a block; every row has the statistics' features, so none is empty."""
        bins = np.stack([np.searchsorted(e, s, "right") for e, s in zip(self.edges, stats.T, strict=True)], 1) + BUCKETS + BINS * np.arange(STATISTICS)
        sizes = np.array([len(h) + STATISTICS for h in hashed])
        starts = np.cumsum(sizes) - sizes
        col, val = np.empty(sizes.sum(), np.int64), np.ones(sizes.sum())
        for i, h in enumerate(hashed):
            a = starts[i]
            col[a : a + len(h)] = h
            val[a : a + len(h)] = 1 / max(1.0, len(h)) ** 0.5
            col[a + len(h) : a + sizes[i]] = bins[i]
        return starts, col, val

    def margin(self, starts: np.ndarray, col: np.ndarray, val: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid, and the sums v x by row and factor."""
        vx = self.v[col] * val[:, None]
        sums = np.add.reduceat(vx, starts)
        pairs = 0.5 * (sums**2 - np.add.reduceat(vx**2, starts)).sum(1)
        return self.bias + np.add.reduceat(self.w[col] * val, starts) + pairs, sums

    def scores(self, hashed: list[list[int]], stats: np.ndarray) -> np.ndarray:
        z, _ = self.margin(*self.columns(hashed, stats))
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(hashed: list[list[int]], stats: np.ndarray, label: np.ndarray) -> Machine:
    size = BUCKETS + BINS * STATISTICS
    share = float(np.clip(label.mean() if len(label) else 0.0, 1e-6, 1 - 1e-6))
    rng = np.random.default_rng(7)
    edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T if len(stats) else np.zeros((STATISTICS, BINS - 1))
    m = Machine(float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.05, (size, FACTORS)), edges)
    if len(set(label.tolist())) < 2:
        m.v[:] = 0
        return m
    gw, gv = np.full(size, 1e-6), np.full((size, FACTORS), 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(label))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            starts, col, val = m.columns([hashed[i] for i in rows], stats[rows])
            z, sums = m.margin(starts, col, val)
            error = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - label[rows]) / len(rows)
            by = np.repeat(np.arange(len(rows)), np.diff(np.append(starts, len(col))))
            step = error[by] * val
            used, where = np.unique(col, return_inverse=True)
            g = np.bincount(where, step, len(used)) + DECAY * m.w[used]
            gw[used] += g * g
            m.w[used] -= RATE * g / np.sqrt(gw[used])
            per = step[:, None] * (sums[by] - m.v[col] * val[:, None])
            g2 = np.stack([np.bincount(where, per[:, f], len(used)) for f in range(FACTORS)], 1) + DECAY * m.v[used]
            gv[used] += g2 * g2
            m.v[used] -= RATE * g2 / np.sqrt(gv[used])
            m.bias -= RATE * float(error.sum())
    return m


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = MODULUS, remainder: int = REMAINDER, rows: int = TRAIN_ROWS) -> Machine:
    """A machine from docs (doc_id, text, n_chars) and labels. The driver gets hashed words and statistics of `rows` texts, no texts."""
    sample = training_rows(docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("n_chars").cast("long").alias("n_chars")), labels, label, modulus, remainder, rows)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hashed()
        for batch in batches:
            found = [raw_features(t, n, hashed) for t, n in zip(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([f[0] for f in found], pa.list_(pa.int16())), pa.array([f[1] for f in found], pa.list_(pa.float64()))], names=["doc_id", "label", "words", "stats"])

    got = map_arrow(sample.select("doc_id", "label", "text", "n_chars"), code, "doc_id long, label int, words array<smallint>, stats array<double>").toArrow()
    # a total order, as repeated ids may have different texts
    learned = sorted(got.to_pylist(), key=repr)
    stats = np.array([r["stats"] for r in learned]).reshape(-1, STATISTICS)
    return fit([r["words"] for r in learned], stats, np.array([r["label"] for r in learned], float))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, _score) for docs (doc_id, text, n_chars)."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hashed()
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                rows = batch.slice(part, 500)
                found = [raw_features(t, n, hashed) for t, n in zip(rows.column("text").to_pylist(), rows.column("n_chars").to_pylist(), strict=True)]
                scores = shared.value.scores([f[0] for f in found], np.array([f[1] for f in found]))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(scores)], names=["doc_id", "_score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("n_chars").cast("long").alias("n_chars"))
    return map_arrow(rows, run, "doc_id long, _score double")


def op6_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "n_chars")
    out = score(docs, train(docs, table(spark, sf_dir, "labels", "doc_id", "quality")))
    return out.select("doc_id", held_out(F.col("doc_id"), MODULUS, REMAINDER).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op6_factorisation_machine": op6_factorisation_machine}
ORACLES: dict[str, str] = {}
