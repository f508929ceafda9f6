"""Array arithmetic on model outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_total(values: Column) -> Column:
    """Sum of an array of numbers."""
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def softmax(logits: Column) -> Column:
    """Softmax, shifted by the maximum for numerical safety."""
    doubles = logits.cast("array<double>")
    shifted = F.transform(doubles, lambda x: F.exp(x - F.array_max(doubles)))
    return F.transform(shifted, lambda x: x / array_total(shifted))


def argmax(values: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def sigmoid(x: Column) -> Column:
    """Logistic function."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def zeros(n: int, kind: str = "float") -> Column:
    """Array of ``n`` zeros."""
    return F.array_repeat(F.lit(0).cast(kind), n)


def fit_length(values: Column, n: int) -> Column:
    """The array if it has exactly ``n`` elements, otherwise ``n`` zeros."""
    return F.when(F.size(values) == n, values).otherwise(zeros(n))


def pad_to(values: Column, n: int, kind: str = "double") -> Column:
    """First ``n`` elements, zero-filled at the end."""
    return F.slice(F.concat(values, zeros(n, kind)), 1, n)
