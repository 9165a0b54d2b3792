"""Numeric expressions shared by the scorers, models and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numeric guards of the models.
SIGMOID_CLIP = 30.0
PROBABILITY_FLOOR = 1e-6
RANK_DIGITS = 9


def stable(score: Column) -> Column:
    """Score as used for ordering: float noise below 1e-9 must not decide a tie."""
    return F.round(score, RANK_DIGITS)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient with the denominator kept at one or more."""
    return numerator / F.greatest(F.lit(1), denominator)


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """Quotient, 0 when the denominator is 0."""
    return F.when(denominator != 0, numerator / denominator).otherwise(F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return safe_divide(2.0 * precision * recall, precision + recall)


def minmax(value: Column, low: Column, high: Column) -> Column:
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.0))


def sigmoid(value: Column) -> Column:
    clipped = F.greatest(F.lit(-SIGMOID_CLIP), F.least(F.lit(SIGMOID_CLIP), value))
    return 1.0 / (1.0 + F.exp(-clipped))


def clip_probability(value: Column, floor: float = PROBABILITY_FLOOR) -> Column:
    return F.greatest(F.lit(floor), F.least(F.lit(1.0 - floor), value))


def log_loss_term(probability: Column, label: Column) -> Column:
    p = clip_probability(probability)
    return -(label * F.ln(p) + (1.0 - label) * F.ln(1.0 - p))


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")),
        F.lit(0.0),
        lambda total, term: total + term,
    )


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def cosine(left: Column, right: Column) -> Column:
    return safe_divide(dot(left, right), norm(left) * norm(right))


def linear(values: Sequence[Column], weights: Sequence[float], bias: float) -> Column:
    total = F.lit(float(bias))
    for value, weight in zip(values, weights):
        total = total + value * F.lit(float(weight))
    return total
