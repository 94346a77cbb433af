"""Joins by nearness: in time, in an interval, in the plane. All become equality joins on buckets or cells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The first radius of a search is the extent over so many times the spots; how much wider each next one is.
FIRST, WIDER = 64, 4


def interval_join(points: DataFrame, intervals: DataFrame, keys: tuple[str, ...], at: Column, start: str, end: str, width: float, how: str = "inner", right_open: bool = False) -> DataFrame:
    """Rows of points with the intervals of the same key that hold ``at``, both ends included.

    Intervals are exploded into the buckets of ``width`` that they touch, so the
    join is on equality. Columns of intervals must not clash but for the keys.
    """
    bucket = lambda x: F.floor(x / width).cast("long")
    right = intervals.where(F.col(start) <= F.col(end)).withColumn("_bucket", F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end)))))
    right = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    left = points.withColumn("_at", at).withColumn("_cell", bucket(F.col("_at")))
    on = [left[k].eqNullSafe(right[f"_{k}"]) for k in keys] + [left["_cell"] == right["_bucket"], left["_at"] >= right[start], (left["_at"] < right[end]) if right_open else (left["_at"] <= right[end])]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return left.join(right, condition, how).drop("_at", "_cell", "_bucket", *(f"_{k}" for k in keys))


def segments(df: DataFrame, keys: tuple[str, ...], time: str, values: list[str]) -> DataFrame:
    """Each row of a time table with the next one's time and values as ``next_*``."""
    w = Window.partitionBy(*keys).orderBy(time)
    return df.select(*keys, time, *values, *(F.lead(c).over(w).alias(f"next_{c}") for c in (time, *values)))


def asof_join(left: DataFrame, right: DataFrame, keys: tuple[str, ...], left_time: str, right_time: str, values: list[str], tie: tuple[str, ...] = (), bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows of left with the values of the last row of right at or before their time, null if none; of several at one
    time the last by ``tie``. Names in ``values`` must be new to left.

    Both tables are put into one series and the values carried forward: one
    shuffle by key, whatever the sizes. With ``bucket``, a function of time that
    does not decrease (say, its day), a key's buckets are walked apart and only
    the last values of each are carried on, so no task holds a whole key.
    """
    order = F.struct(*(F.col(c) for c in tie)) if tie else F.struct(F.lit(0).alias("none"))
    cell = (bucket or (lambda _: F.lit(0)))(F.col("_time"))
    side = right.select(*keys, F.col(right_time).alias("_time"), F.lit(0).alias("_side"), order.alias("_tie"), F.struct(*values).alias("_values")).withColumn("_cell", cell)
    rows = left.withColumns({"_time": F.col(left_time), "_side": F.lit(1)}).withColumn("_left", F.struct(*(c for c in left.columns))).withColumn("_cell", cell)
    both = rows.select(*keys, "_time", "_side", "_left", "_cell").unionByName(side, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_cell").orderBy("_time", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_values", ignorenulls=True).over(w)).where("_side = 1")
    if bucket:
        # what each bucket ends with, carried over the key's buckets: a row a bucket
        ends = both.groupBy(*keys, "_cell").agg(F.max_by("_values", F.when(F.col("_side") == 0, F.struct("_time", "_tie"))).alias("_end"))
        before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(*(F.col(k).alias(f"_key_{k}") for k in keys), F.col("_cell").alias("_own"), F.last("_end", ignorenulls=True).over(before).alias("_carried"))
        on = found["_cell"].eqNullSafe(ends["_own"])
        for k in keys:
            on = on & found[k].eqNullSafe(ends[f"_key_{k}"])
        found = found.join(ends, on, "left").withColumn("_found", F.coalesce("_found", "_carried"))
    return found.select("_left.*", *(F.col(f"_found.{v}").alias(v) for v in values))


def within_radius(points: DataFrame, places: DataFrame, keys: tuple[str, ...], x: str, y: str, radius: float, distance: str = "distance") -> DataFrame:
    """Pairs of points and places of the same key less than ``radius`` apart.

    The plane is cut into cells of that size; each place stands in its cell and
    the eight around it. ``x`` and ``y`` are columns of both; those of places become ``place_x``, ``place_y``.
    """
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    around = F.array(*(F.struct((cell(x) + i).alias("cx"), (cell(y) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    right = places.withColumn("_cell", F.explode(around)).withColumnsRenamed({x: "place_x", y: "place_y"} | {k: f"_{k}" for k in keys})
    left = points.withColumn("_own", F.struct(cell(x).alias("cx"), cell(y).alias("cy")))
    condition = left["_own"] == right["_cell"]
    for k in keys:
        condition = condition & left[k].eqNullSafe(right[f"_{k}"])
    found = left.join(right, condition).withColumn(distance, F.hypot(F.col(x) - F.col("place_x"), F.col(y) - F.col("place_y")))
    return found.where(F.col(distance) < radius).drop("_own", "_cell", *(f"_{k}" for k in keys))


def nearest_place(points: DataFrame, row_id: str, x: str, y: str, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``row_id, nearest, distance``: the nearest other row of each, of equally near ones the least id.

    Rows at one spot are each other's nearest. The others look among all spots, within a small radius first and then
    within ``WIDER`` times it, those that found nothing. These lie at least the last radius apart, so few of them share
    a cell and the pairs of a round grow with the rows, unless more than a few spots share a cell of the first one.
    Rounds are staged by ``keep``. A row without another, or without a place, is not in the result.
    """
    rows = keep(points.select(row_id, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull()), "rows")
    spots = keep(rows.groupBy(x, y).agg(F.min(row_id).alias("nearest"), F.count(F.lit(1)).alias("_n")), "spots")
    shared = rows.join(spots.where("_n > 1"), [x, y])
    second = shared.where(F.col(row_id) != F.col("nearest")).groupBy("nearest").agg(F.min(row_id).alias("_second"))
    found = shared.join(second, "nearest").select(row_id, F.when(F.col(row_id) == F.col("nearest"), F.col("_second")).otherwise(F.col("nearest")).alias("nearest"), F.lit(0.0).alias("distance"))
    n, *ends = spots.agg(F.count(F.lit(1)), F.max(x) - F.min(x), F.max(y) - F.min(y)).first()
    if n < 2:
        return found
    radius, at = max(ends) / (FIRST * n), 0
    left, spots = spots.where("_n = 1").select(F.col("nearest").alias(row_id), x, y), spots.drop("_n")
    while left.head(1):
        near = within_radius(spots, left, (), x, y, radius).where(F.col(row_id) != F.col("nearest"))
        best = near.groupBy(row_id).agg(F.min(F.struct("distance", "nearest")).alias("_m"))
        best = keep(best.select(row_id, "_m.nearest", "_m.distance"), f"near_{at}")
        found = found.unionByName(best)
        left = keep(left.join(best, row_id, "left_anti"), f"left_{at}")
        radius, at = radius * WIDER, at + 1
    return found


def band_pairs(df: DataFrame, row_id: str, value: str, width: float) -> DataFrame:
    """Pairs ``a < b`` of rows whose values differ by less than ``width``, each once."""
    cell = F.floor(F.col(value) / width).cast("long")
    left = df.select(F.col(row_id).alias("a"), F.col(value).alias("value_a"), cell.alias("_cell"))
    right = df.select(F.col(row_id).alias("b"), F.col(value).alias("value_b"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell"))
    return left.join(right, "_cell").where((F.col("a") < F.col("b")) & (F.abs(F.col("value_a") - F.col("value_b")) < width)).drop("_cell")
