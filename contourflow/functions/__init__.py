"""Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a.cast("double") / F.when(b == 0, 1).otherwise(b))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def leaky_relu(x: Column, slope: float = 0.2) -> Column:
    return F.when(x >= 0, x).otherwise(x * slope)


def bce_with_logits(x: Column, y: Column) -> Column:
    """Binary cross entropy of a logit, stable for large ones."""
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def focal(x: Column, y: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """Focal loss of a logit: alpha_t * (1 - p_t) ** gamma times cross entropy."""
    p = sigmoid(x)
    p_t = p * y + (1 - p) * (1 - y)
    a_t = alpha * y + (1 - alpha) * (1 - y)
    return a_t * F.pow(1 - p_t, F.lit(gamma)) * bce_with_logits(x, y)


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))
