"""Irregular samples on a uniform grid, without values across recording holes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.scalars import finite
from cadenza.operators.series import Series, last_known


def resample(df: DataFrame, keys: tuple[str, ...], time: str, hold: list[str] = (), zero: list[str] = (), places: list[str] = (), step: float = 1.0, hole: float = 3.0, tie: str | None = None) -> DataFrame:
    """``keys, i, t, gap`` and each channel on the grid ``first time + i * step``.

    Each pair of neighbouring samples is a segment that is exploded into the
    grid points it covers: no range join. A point in a segment longer than
    ``hole`` is a gap: ``hold`` channels and ``places`` keep the last
    reading there, ``zero`` channels are 0. Elsewhere values are interpolated;
    where one neighbour is unknown the other is taken, where both are, the last
    value before. ``places`` also take 0 as unknown. ``t`` counts from 0.
    """
    channels = [*hold, *zero, *places]
    s = Series(keys, (time, tie) if tie else (time,))
    ahead = lambda c, k=1: F.lead(c, k).over(s.window)
    known = {c: finite(F.col(c).cast("double")) if c not in places else F.nullif(finite(F.col(c).cast("double")), F.lit(0.0)) for c in channels}
    rows = df.select(*keys, *s.order, *(known[c].alias(c) for c in channels)).withColumns({"_from": F.min(time).over(s.whole), "_to": ahead(F.col(time)), "_last": ahead(F.col(time), 2).isNull()})
    rows = rows.withColumns({f"_{c}": ahead(F.col(c)) for c in channels}).where(F.col("_to").isNotNull())
    first = F.ceil((F.col(time) - F.col("_from")) / step)
    stop = (F.col("_to") - F.col("_from")) / step
    last = F.when(F.col("_last"), F.floor(stop)).otherwise(F.ceil(stop) - 1)
    rows = rows.withColumns({"_a": first.cast("long"), "_b": last.cast("long"), "_span": F.col("_to") - F.col(time)}).where("_a <= _b")
    grid = rows.withColumn("i", F.explode(F.sequence("_a", "_b"))).withColumn("gap", F.col("_span") > hole)
    share = F.when(F.col("_span") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("_from") + F.col("i") * step - F.col(time)) / F.col("_span")))).otherwise(0.0)

    def value(c: str) -> Column:
        a, b = F.col(c), F.col(f"_{c}")
        between = F.coalesce(a + (b - a) * share, a, b)
        return F.when(F.col("gap"), F.lit(0.0) if c in zero else a).otherwise(between)

    on_grid = Series(keys, ("i",))
    out = grid.select(*keys, "i", (F.col("i") * F.lit(step)).cast("double").alias("t"), "gap", *(value(c).alias(c) for c in channels))
    return out.withColumns({c: last_known(F.col(c), on_grid, 0.0) for c in channels})


def crop(df: DataFrame, keys: tuple[str, ...], time: str, start: Column, end: Column, least: int) -> DataFrame:
    """Rows whose time since the first lies in [start, end]; where fewer than
    ``least`` would be left, or a bound is null, all rows of that key."""
    whole = Window.partitionBy(*keys)
    since = F.col(time) - F.min(time).over(whole)
    inside = F.coalesce((since >= start) & (since <= end), F.lit(True))
    kept = df.withColumn("_in", inside).withColumn("_left", F.sum(F.col("_in").cast("int")).over(whole))
    return kept.where(F.col("_in") | (F.col("_left") < least)).drop("_in", "_left")


def too_short_or_long(df: DataFrame, keys: tuple[str, ...], time: str, least: int, most: int, step: float = 1.0) -> DataFrame:
    """``keys`` and the ``reason`` of each series that can't be analysed."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), (F.floor((F.max(time) - F.min(time)) / step) + 1).alias("_grid"))
    reason = F.when(F.col("_n") < least, "too few samples").when(F.col("_grid") < least, "too short").when(F.col("_grid") > most, "too long")
    return sizes.select(*keys, reason.alias("reason")).where("reason is not null")


def marker_indices(lap_times: Column, cropped: Column, n: Column) -> Column:
    """Distinct grid indices of lap markers with both ends; null if fewer than four."""
    inner = F.filter(F.transform(lap_times, lambda x: F.floor(x - cropped + 0.5).cast("long")), lambda i: (i > 0) & (i < n))
    marks = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), inner, F.array((n - 1).cast("long")))))
    return F.when(F.size(marks) >= 4, marks)
