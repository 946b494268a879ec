"""Count rates and beta posteriors as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(numerator: Column, denominator: Column) -> Column:
    """NULL when nothing was observed."""
    return F.when(denominator > 0, numerator / denominator)


def posterior(numerator: Column, denominator: Column, alpha: Column, beta: Column) -> dict[str, Column]:
    a = alpha + numerator
    b = beta + denominator - numerator
    total = a + b
    return {
        "posterior_alpha": a, "posterior_beta": b, "posterior_mean": a / total,
        "posterior_sd": F.sqrt(a * b / (total * total * (total + 1.0))),
        "data_weight": denominator / (denominator + alpha + beta),
    }


def smoothed(count: Column, total: Column, prior: Column, strength: float) -> Column:
    return (count + F.lit(float(strength)) * prior) / (total + F.lit(float(strength)))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(value, F.lit(float(high))), F.lit(float(low)))
