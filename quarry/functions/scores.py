"""Scoring formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Term saturation and length normalisation.
K1, B = 1.2, 0.75
# Weights of the risk features, and the bias.
RISK_WEIGHTS = {"dependents": 0.15, "fan_in": 0.2, "churn": 0.1, "bugfix": 0.25, "complexity": 0.05, "test_gap": 0.2}
RISK_BIAS = -2.0


def idf(n_docs: Column, df: Column) -> Column:
    df = F.greatest(df, F.lit(1))
    return F.log((n_docs - df + 0.5) / (df + 0.5) + 1)


def saturation(tf: Column, dl: Column, avg_dl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * dl / avg_dl))


def hop_score(hop: Column) -> Column:
    """1, 1/2 and 1/4 for the seeds and two hops, 1/10 beyond."""
    return F.when(hop == 0, 1.0).when(hop == 1, 0.5).when(hop == 2, 0.25).otherwise(0.1)


def risk_probability(dependents: Column, fan_in: Column, churn: Column, bugfix: Column, complexity: Column, test_gap: Column, weights: dict[str, float] = RISK_WEIGHTS, bias: float = RISK_BIAS) -> Column:
    """Logistic over counts, ratios and flags; complexity is given as a logarithm."""
    w = weights
    z = w["dependents"] * dependents + w["fan_in"] * fan_in + w["churn"] * churn + w["bugfix"] * bugfix + w["complexity"] * complexity + w["test_gap"] * test_gap + bias
    return 1 / (1 + F.exp(-z))


def risk_tier(p: Column) -> Column:
    return F.when(p >= 0.7, "high").when(p >= 0.4, "medium").otherwise("low")


def fragility(dependents: Column, churn: Column) -> Column:
    return dependents * (1 + 0.1 * churn)
