"""Numeric expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low=0.0, high=1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ramp(x: Column, floor: float, full: float) -> Column:
    """0 up to floor, 1 from full, linear between; a step where there is no room between."""
    return clamp((x - floor) / (full - floor)) if full > floor else (x >= full).cast("double")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-clamp(x, -40.0, 40.0)))


def finite_or_zero(x: Column) -> Column:
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def ratio(part: Column, whole: Column) -> Column:
    """Null where there is nothing to divide by."""
    return F.when(whole != 0, part / whole)


def linear(intercept: float, terms: Sequence[tuple[float, Column]]) -> Column:
    """intercept + sum of weight * value, added up in the given order."""
    total = F.lit(0.0)
    for weight, value in terms:
        total = total + F.lit(weight) * value
    return F.lit(intercept) + total


def interpolate(x: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Piecewise-linear through the knots, constant beyond them; at a jump the higher value; x without knots."""
    if not knots:
        return x
    out = F.when(x <= knots[0][0], F.lit(float(knots[0][1]))).when(x >= knots[-1][0], F.lit(float(knots[-1][1])))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        inside = F.lit(float(max(y0, y1))) if x0 == x1 else F.lit(float(y0)) + (x - x0) / (x1 - x0) * (y1 - y0)
        out = out.when((x >= x0) & (x <= x1), inside)
    return out.otherwise(F.lit(float(knots[-1][1])))


def log_loss(truth: Column, p: Column) -> Column:
    q = clamp(p, 1e-15, 1 - 1e-15)
    return -(truth * F.log(q) + (1 - truth) * F.log(1 - q))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is missing or zero or the lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def weighted_mean(parts: Sequence[tuple[float, Column]]) -> Column:
    """Over the parts that are not null; missing evidence shrinks the denominator."""
    top, bottom = F.lit(0.0), F.lit(0.0)
    for weight, value in parts:
        top = top + F.when(value.isNotNull(), F.lit(weight) * value).otherwise(0.0)
        bottom = bottom + F.when(value.isNotNull(), F.lit(weight)).otherwise(0.0)
    return ratio(top, bottom)
