"""Small numeric helpers on columns."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float | Column, high: float | Column) -> Column:
    """x within [low, high]; null stays null, which bare ``greatest`` would lose."""
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def half_up(x: Column) -> Column:
    """Nearest whole number, halves towards plus infinity."""
    return F.floor(x + 0.5)


def angle_delta(a: Column, b: Column) -> Column:
    """b - a in radians, within (-pi, pi]."""
    d = b - a
    return d - F.lit(2 * math.pi) * F.ceil((d - math.pi) / (2 * math.pi))


def angle_difference(a: Column, b: Column) -> Column:
    """How far two bearings in radians are apart, 0 to pi."""
    return F.abs(angle_delta(a, b))


def lerp(a: Column, b: Column, share: Column) -> Column:
    """The value ``share`` of the way from a to b; where one is null, the other."""
    return F.coalesce(a + (b - a) * share, a, b)


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), where x is evaluated once however often f uses it, within lambdas too."""
    return F.get(F.transform(F.array(x), f), 0)
