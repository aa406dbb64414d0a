"""Null semantics of the engine: NULL is no data, never NaN. greatest/least skip NULL, so clips are guarded here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x where it is a finite number, else NULL."""
    return F.when(x.isNotNull() & ~F.isnan(x) & ~x.isin(float("inf"), float("-inf")), x)


def clip01(x: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def rounded(x: Column, digits: int = 6) -> Column:
    """x rounded for output; -0.0 becomes 0.0."""
    return F.round(x, digits) + F.lit(0.0)


def positive(name: str, value: float) -> float:
    if not (value > 0 and value != float("inf")):
        raise ValueError(f"{name} must be positive and finite, got {value!r}")
    return float(value)
