"""Column functions over array<double> vectors and over uniform grids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def distance(a: Column, b: Column) -> Column:
    return norm(minus(a, b))


def weighted(v: Column, weights: list[float] | None) -> Column:
    return v if weights is None else F.zip_with(v, F.array(*map(F.lit, weights)), lambda x, w: x * w)


def rounded(v: Column, digits: int = 6) -> Column:
    """Rounded, without negative zeros; for results that are compared between engines."""
    return F.round(v, digits) + F.lit(0.0)


def blend(a: Column, b: Column, u: Column) -> Column:
    """Linear interpolation between two vectors."""
    return F.zip_with(a, b, lambda x, y: x + (y - x) * u)


def hermite(p0: Column, p1: Column, m0: Column, m1: Column, u: Column, h: Column | float = 1.0) -> Column:
    """Cubic Hermite value at u in [0, 1]; tangents per interval, or per unit of an interval h long, multiplied last."""
    return (2 * u * u * u - 3 * u * u + 1) * p0 + (u * u * u - 2 * u * u + u) * m0 * h + (3 * u * u - 2 * u * u * u) * p1 + (u * u * u - u * u) * m1 * h


def hermite_velocity(p0: Column, p1: Column, m0: Column, m1: Column, u: Column, h: Column | float = 1.0) -> Column:
    return (6 * u * u - 6 * u) * p0 + (3 * u * u - 4 * u + 1) * m0 * h + (6 * u - 6 * u * u) * p1 + (3 * u * u - 2 * u) * m1 * h


def smoothstep(x: Column) -> Column:
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return 3 * x * x - 2 * x * x * x


def harmonic_slope(a: Column, b: Column) -> Column:
    """Shape-preserving tangent between two slopes of a uniform grid: their harmonic mean, 0 where they disagree."""
    return F.when(a * b > 0, 2 * a * b / (a + b)).otherwise(0.0)


def end_slope(near: Column, far: Column) -> Column:
    """Shape-preserving three-point tangent at an end of a uniform grid."""
    d = (3 * near - far) / 2
    return F.when(d * near <= 0, 0.0).when((near * far < 0) & (F.abs(d) > 3 * F.abs(near)), 3 * near).otherwise(d)
