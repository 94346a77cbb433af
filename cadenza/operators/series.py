"""Windows over ordered series: smoothing, derivatives, slopes, fills, trailing power means.

``Series`` names the columns that part a table into series and order each. All
operators of one series share its partitioning, so a chain of them costs one
shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cadenza.functions.scalars import angle_delta

FIRST, LAST = Window.unboundedPreceding, Window.unboundedFollowing


@dataclass(frozen=True)
class Series:
    keys: tuple[str, ...]
    order: tuple[str, ...]

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    @property
    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    def rows(self, first: int, last: int) -> WindowSpec:
        return self.window.rowsBetween(first, last)

    @property
    def so_far(self) -> WindowSpec:
        return self.rows(FIRST, 0)

    @property
    def place(self) -> Column:
        """0, 1, 2 … along the series."""
        return (F.row_number().over(self.window) - 1).cast("long")

    def shifted(self, x: Column, by: int) -> Column:
        """x that many rows on (back if negative), or at the series' end where it has fewer."""
        move = F.lead if by > 0 else F.lag
        return F.coalesce(*(move(x, k).over(self.window) for k in range(abs(by), 0, -1)), x)


RIDE = Series(("ride_id",), ("i",))


def _known(x: Column) -> Column:
    return F.coalesce(F.when(~F.isnan(x.cast("double")), x), F.lit(0.0))


def frame_mean(x: Column, s: Series, first: int, last: int) -> Column:
    """Mean of a row frame in which undefined values count as 0, and do count."""
    frame = s.rows(first, last)
    return F.sum(_known(x)).over(frame) / F.count(F.lit(1)).over(frame)


def centred_mean(x: Column, s: Series, width: int) -> Column:
    """Moving mean of ``width // 2`` rows to each side, cut off at the ends."""
    return frame_mean(x, s, -(width // 2), width // 2) if width > 1 else x


def trailing_mean(x: Column, s: Series, width: int) -> Column:
    """Mean of the last ``width`` rows, cut off at the start."""
    return frame_mean(x, s, 1 - width, 0)


def central_derivative(y: Column, x: Column, s: Series) -> Column:
    """dy/dx across both neighbours, one-sided at the ends, 0 where x stands still."""
    rise, run = s.shifted(y, 1) - s.shifted(y, -1), s.shifted(x, 1) - s.shifted(x, -1)
    return F.coalesce(F.try_divide(rise, run), F.lit(0.0))


def last_known(x: Column, s: Series, default: Column | float | None = None) -> Column:
    """x, or the last value before it that is not null."""
    filled = F.last(x, ignorenulls=True).over(s.so_far)
    return filled if default is None else F.coalesce(filled, default if isinstance(default, Column) else F.lit(default))


def running_max(x: Column, s: Series) -> Column:
    return F.max(x).over(s.so_far)


def running_sum(x: Column, s: Series) -> Column:
    return F.sum(x).over(s.so_far)


def gain(x: Column, s: Series) -> Column:
    """How much x rises to this row, 0 where it falls; a sum of these is the total climb."""
    return F.coalesce(F.greatest(x - F.lag(x).over(s.window), F.lit(0.0)), F.lit(0.0))


def trailing_rate(x: Column, s: Series, rows: int) -> Column:
    """Change per row over the last ``rows`` rows, or over those there are."""
    steps = F.least(s.place, F.lit(rows))
    return F.coalesce(F.try_divide(x - s.shifted(x, -rows), steps.cast("double")), F.lit(0.0))


def _edges(x: np.ndarray, half: float, least: int, begin: int = 0, end: int | None = None, reached: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """First and last row of the fit of each row from begin to end: those within ``half``, widened evenly to ``least``. The last row never goes
    back: once a fit has reached further, so do those after it; ``reached`` is what the row before begin has."""
    n, end = len(x), len(x) if end is None else end
    first = np.searchsorted(x, x[begin:end] - half, side="left").tolist()
    last = (np.searchsorted(x, x[begin:end] + half, side="right") - 1).tolist()
    for i in range(end - begin):
        a, b = first[i], max(last[i], reached)
        while b - a + 1 < least and (a > 0 or b < n - 1):
            a, b = a - (a > 0), b + (b < n - 1)
        first[i], last[i], reached = a, b, b
    return np.array(first, np.int64), np.array(last, np.int64)


def reaches(x: np.ndarray, half: float, least: int, begin: int, end: int) -> list[int]:
    """For each state before row begin, the one after row end - 1: by how many rows a fit reaches beyond its own row, 0 to ``least``.

    Beyond ``least`` only rows within ``half`` are reached, which the rows after reach by themselves.
    """
    n = len(x)
    first = np.searchsorted(x, x[begin:end] - half, side="left")
    last = np.searchsorted(x, x[begin:end] + half, side="right") - 1
    reached = np.arange(least + 1) + begin - 1
    for i in range(begin, end):
        if reached[0] == reached[-1]:  # larger states never end up lower, so all are one by now
            ends = _edges(x, half, least, i, end, int(reached[0]))[1]
            reached[:] = ends[-1]
            break
        a, b = int(first[i - begin]), np.maximum(last[i - begin], reached)
        need = np.maximum(least - (b - a + 1), 0)
        step = (need + 1) // 2
        reached = np.minimum(b + np.where(step > a, need - a, step), n - 1)
    return np.clip(reached - (end - 1), 0, least).tolist()


#: Rows of a fit that are summed offset by offset for all rows at once; longer fits are summed each by itself.
NARROW = 64


def slopes(x: np.ndarray, y: np.ndarray, half: float, least: int, limit: float) -> np.ndarray:
    """Least-squares slopes of y on x (not falling) over the rows of ``_edges``, cut to ``±limit``; 0 of fewer than three rows or of one x."""
    return fitted(x, y, half, least, limit, 0, len(x), 0)


def fitted(x: np.ndarray, y: np.ndarray, half: float, least: int, limit: float, begin: int, end: int, state: int) -> np.ndarray:
    """``slopes`` of the rows from begin to end, where the fit of the row before reaches ``state`` rows beyond it."""
    first, last = _edges(x, half, least, begin, end, begin - 1 + state)
    m = last - first + 1
    sums = np.zeros((4, end - begin))

    def add(own: np.ndarray, dx: np.ndarray, v: np.ndarray) -> None:
        sums[:, own] += dx, v, dx * dx, dx * v

    narrow = np.flatnonzero(m <= NARROW)
    for d in range(int(m[narrow].max(initial=0))):
        own = narrow[m[narrow] > d]
        k = first[own] + d
        add(own, x[k] - x[begin + own], y[k])
    for i in np.flatnonzero(m > NARROW).tolist():
        dx, v = x[first[i] : last[i] + 1] - x[begin + i], y[first[i] : last[i] + 1]
        sums[:, i] = dx.sum(), v.sum(), dx @ dx, dx @ v
    sx, sy, sxx, sxy = sums
    spread = m * sxx - sx * sx
    fine = (m >= 3) & (np.abs(spread) > 1e-9)
    slope = np.where(fine, (m * sxy - sx * sy) / np.where(fine, spread, 1.0), 0.0)
    return np.clip(np.where(np.isfinite(slope), slope, 0.0), -limit, limit)


def range_slope(df: DataFrame, s: Series, y: str, x: str, half: float, least: int, limit: float, out: str) -> DataFrame:
    """df with the least-squares slope of y on x over ``x ± half`` in column ``out``.

    Where fewer than ``least`` rows lie so near, the fit is widened evenly to both sides; its far end then stays there for
    the rows after it. x must not fall along the series. One task fits one series, whose rows are bounded (a ride has at
    most ``max_samples``).
    """
    kept = [c for c in df.columns if c != out]
    schema = StructType([*df.select(*kept).schema.fields, StructField(out, DoubleType())])
    order = [(c, "ascending") for c in s.order]

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        at, value = (table.column(c).cast(pa.float64()).to_numpy() for c in (x, y))
        return table.append_column(out, pa.array(slopes(at, value, half, least, limit), pa.float64()))

    return df.select(*kept).groupBy(*s.keys).applyInArrow(fit, schema)


def heading(lat: Column, lon: Column, s: Series) -> Column:
    """Bearing of travel in radians from places two rows back and ahead; kept where nothing moves."""
    up = F.radians(s.shifted(lat, 2) - s.shifted(lat, -2))
    over = F.cos(F.radians(lat)) * F.radians(s.shifted(lon, 2) - s.shifted(lon, -2))
    return last_known(F.when((F.abs(over) >= 1e-12) | (F.abs(up) >= 1e-12), F.atan2(over, up)), s, 0.0)


def curvature(bearing: Column, dist: Column, s: Series) -> Column:
    """Turn per metre, positive to the right, not smoothed; 0 where less than 2 m were covered."""
    run = s.shifted(dist, 2) - s.shifted(dist, -2)
    return F.when(run < 2, 0.0).otherwise(angle_delta(s.shifted(bearing, -2), s.shifted(bearing, 2)) / run)


def power_mean(df: DataFrame, s: Series, value: str, out: str = "np", width: int = 30, power: float = 4.0, extra: list[Column] | None = None) -> DataFrame:
    """One row a series: the ``power`` mean of the trailing mean of ``width``
    rows, from the first full frame on; the plain mean of shorter series."""
    rolled = df.withColumns({"_rolled": trailing_mean(F.col(value), s, width), "_place": s.place})
    full = F.pow(F.avg(F.when(F.col("_place") >= width - 1, F.pow("_rolled", F.lit(power)))), F.lit(1.0 / power))
    plain = F.coalesce(F.avg(F.when(~F.isnan(F.col(value).cast("double")), F.col(value))), F.lit(0.0))
    return rolled.groupBy(*s.keys).agg(F.coalesce(full, plain).alias(out), *(extra or []))


def with_wrapped_edges(df: DataFrame, s: Series, reach: int) -> DataFrame:
    """A closed series with ``reach`` rows of each end repeated beyond the other.

    ``_at`` orders the rows; rows of the series itself have ``_own`` true. The
    series' order column must count from 0.
    """
    at = s.order[0]
    here, n = F.col(at).cast("long"), (F.max(at).over(s.whole) + 1).cast("long")
    df = df.withColumn("_n", n)
    # rows are copied in one pass: a union would run what comes before it once for each part
    copies = F.filter(F.array(here, F.when(here >= F.col("_n") - reach, here - F.col("_n")), F.when(here < reach, here + F.col("_n"))), lambda x: x.isNotNull())
    return df.withColumn("_at", F.explode(copies)).withColumn("_own", F.col("_at") == here).drop("_n")


def circular_mean(df: DataFrame, s: Series, value: str, width: int, out: str) -> DataFrame:
    """df with the moving mean of a closed series."""
    half = width // 2
    wrapped = with_wrapped_edges(df, s, half)
    around = Series(s.keys, ("_at",))
    return wrapped.withColumn(out, F.avg(value).over(around.rows(-half, half))).where("_own").drop("_own", "_at")


TWO_PI = 2 * math.pi
