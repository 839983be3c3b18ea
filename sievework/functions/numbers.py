"""Numeric functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """x within low and high; null stays null (greatest and least alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def sigmoid(x: Column, bound: float = 30.0) -> Column:
    return 1 / (1 + F.exp(-clamp(x, -bound, bound)))


def softmax(xs: list[Column]) -> list[Column]:
    top = F.greatest(*xs)
    total = sum((F.exp(x - top) for x in xs), F.lit(0.0))
    return [F.exp(x - top) / total for x in xs]


def ramp_up(x: Column, low: float, high: float) -> Column:
    """0 at low, 1 at high, linear between."""
    return clamp((x - low) / (high - low), 0.0, 1.0)


def ramp_down(x: Column, low: float, high: float) -> Column:
    return 1 - ramp_up(x, low, high)


def log_score(x: Column, low: float, high: float) -> Column:
    """0 to 100 on a log1p scale between low and high."""
    return clamp((F.log1p(x) - F.log1p(F.lit(low))) / (F.log1p(F.lit(high)) - F.log1p(F.lit(low))) * 100)


def safe_ratio(n: Column, d: Column, places: int = 4) -> Column:
    """n / d rounded half to even; 0 for a zero or null denominator."""
    return F.coalesce(F.bround(F.try_divide(n.cast("double"), d.cast("double")), places), F.lit(0.0))


def finite(x: Column) -> Column:
    """x as a double, null where it isn't a finite number."""
    v = x.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def metric(metrics: Column, *names: str, default: float = 0.0) -> Column:
    """The first of names that the map holds, else the default."""
    return F.coalesce(*[F.element_at(metrics, n) for n in names], F.lit(default))


def looked_up(metrics: Column, names: Sequence[str]) -> Column:
    """An array of the named metrics, in order, null where the map lacks one.

    One expression over the names: lookups written out one a name make code that the JVM leaves uncompiled. metrics has
    to be a column that is there already; an expression would be evaluated once a name.
    """
    return F.transform(F.array(*map(F.lit, names)), lambda k: metrics[k])


def temporal_similarity(seconds: Column, sequence: Column) -> Column:
    """exp(-|s| / 18) by time, else exp(-|n| / 6) by sequence, else 0.45."""
    return F.coalesce(F.exp(-F.abs(seconds) / 18), F.exp(-F.abs(sequence) / 6), F.lit(0.45))


def round_half_even(x: Column) -> Column:
    return F.bround(x, 0).cast("long")
