"""Bounded labelled samples for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, held_out


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, rows: int) -> DataFrame:
    """docs with a column `label` (0/1): at most `rows` labelled documents, chosen by a hash of doc_id, none of them held out.

    The chosen ids are bounded by `rows`, so they are broadcast. Null ids and null labels are left out; the
    largest of several labels of a document counts.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder))
    chosen = known.groupBy(F.col("doc_id").alias("_id")).agg((F.max(label) > 0).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    return cut(docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).drop("_id"))


def log_likelihood_ratio(pos: Column, neg: Column, n_pos: int, n_neg: int) -> Column:
    """How much better two rates explain pos of n_pos and neg of n_neg than one rate does."""

    def part(k: Column, n: float, p: Column) -> Column:
        p = F.greatest(F.lit(1e-9), F.least(p, F.lit(1 - 1e-9)))
        return k * F.log(p) + (F.lit(float(n)) - k) * F.log(1 - p)

    both = (pos + neg) / float(n_pos + n_neg)
    return 2 * (part(pos, n_pos, pos / max(1.0, float(n_pos))) + part(neg, n_neg, neg / max(1.0, float(n_neg))) - part(pos, n_pos, both) - part(neg, n_neg, both))
