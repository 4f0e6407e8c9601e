"""Cubic B-spline basis on uniform knots, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

KNOTS = 6
DEGREE = 3
BASIS = KNOTS + DEGREE - 2      # the last of KNOTS + DEGREE - 1 functions is dropped


def basis(x: Column, low: float, high: float, knots: int = KNOTS) -> Column:
    """Array of basis values of x; outside [low, high] the value at the nearer end is used."""
    size = knots + DEGREE - 2
    step = (high - low) / (knots - 1)
    if step <= 0:
        return F.array_repeat(F.lit(0.0), size)
    at = (F.greatest(F.least(x, F.lit(float(high))), F.lit(float(low))) - F.lit(float(low))) / F.lit(step)
    starts = F.array(*[F.lit(float(i - DEGREE)) for i in range(size)])
    return F.transform(starts, lambda t: bump(at - t))


def bump(u: Column) -> Column:
    """The cubic B-spline with knots 0, 1, 2, 3, 4, which is symmetric about 2."""
    d = F.abs(u - 2.0)
    near = (F.lit(4.0) - 6.0 * d * d + 3.0 * d * d * d) / 6.0
    far = (F.lit(2.0) - d) * (F.lit(2.0) - d) * (F.lit(2.0) - d) / 6.0
    return F.when(d < 1.0, near).when(d < 2.0, far).otherwise(F.lit(0.0))
