"""Rounding that Spark and other SQL engines compute alike on doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 4) -> Column:
    """Half-up rounding of a non-negative double by floor, the same on every engine."""
    scale = F.lit(float(10**digits))
    return F.floor(x.cast("double") * scale + F.lit(0.5)) / scale


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole, rounded; 0 where the whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(half_up(part.cast("double") / whole.cast("double"), digits))


def mean(x: Column | str, digits: int = 4) -> Column:
    """Rounded mean, null without values; the sum is rounded first, so that its order of addition doesn't matter."""
    c = F.col(x) if isinstance(x, str) else x
    return half_up(half_up(F.sum(c), 6) / F.count(c), digits)
