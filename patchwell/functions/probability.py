"""Three-class probabilities from logits, and losses on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLASSES = 3


def softmax(logits: Column, temperature: float | Column = 1.0) -> Column:
    t = F.lit(float(temperature)) if isinstance(temperature, (int, float)) else temperature
    top = F.array_max(logits)
    weights = F.transform(logits, lambda z: F.exp((z - top) / t))
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    return F.transform(weights, lambda w: w / total)


def argmax(values: Column) -> Column:
    """Index of the largest element; the lowest class wins a tie."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def log_sum_exp(logits: Column, temperature: float = 1.0) -> Column:
    top = F.array_max(logits) / temperature
    total = F.aggregate(logits, F.lit(0.0), lambda a, z: a + F.exp(z / temperature - top))
    return top + F.log(total)


def cross_entropy(logits: Column, target: Column, temperature: float = 1.0) -> Column:
    """Negative log-likelihood of the target class; NULL for an ignored pixel."""
    return log_sum_exp(logits, temperature) - F.element_at(logits, target.cast("int") + 1) / temperature


def focal(loss: Column, gamma: float) -> Column:
    if gamma < 0:
        raise ValueError("Negative focal gamma")
    return loss * F.pow(1 - F.exp(-loss), F.lit(float(gamma)))


def is_normalized(probabilities: Column, tolerance: float = 1e-5) -> Column:
    """Three finite, non-negative values that sum to one."""
    total = F.aggregate(probabilities, F.lit(0.0), lambda a, p: a + p)
    bad = F.exists(probabilities, lambda p: p.isNull() | F.isnan(p) | (p < 0))
    return F.coalesce((F.size(probabilities) == CLASSES) & ~bad & (F.abs(total - 1) <= tolerance), F.lit(False))


def clip(p: Column, eps: float = 1e-12) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
