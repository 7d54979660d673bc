"""Expressions over arrays of class scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from relvec.schema import FLOAT32_EPS


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def softmax(logits: str | Column) -> Column:
    logits = _col(logits)
    top = F.array_max(logits)
    shifted = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(shifted, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(shifted, lambda x: x / total)


def top_class(probs: str | Column) -> Column:
    """Index of the first maximum."""
    probs = _col(probs)
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def confidence(probs: str | Column) -> Column:
    return F.array_max(_col(probs))


def two_class(positive: str | Column) -> Column:
    """Probability of the positive class, widened to both classes."""
    positive = _col(positive)
    return F.array(F.lit(1.0) - positive, positive)


def nll(probs: str | Column, label_id: str | Column, eps: float = FLOAT32_EPS) -> Column:
    """Negative log of the clipped probability of the true class."""
    p = F.get(_col(probs), _col(label_id).cast("int"))
    return -F.ln(F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), p)))
