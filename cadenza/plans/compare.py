"""Rides side by side, and which of them were ridden on the same circuit."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.geo import planar_metres
from cadenza.plans.staging import Staging

#: Circuits are the same if their middles are this near (m) and their lengths differ by less than this share.
APART, LENGTH = 250.0, 0.12


def compare_rows(rides: DataFrame, report: dict[str, DataFrame]) -> DataFrame:
    """One row a ride with its headline numbers."""
    s, f, w = report["summary"], report["finale"], report["wind"]
    finale = f.select("ride_id", F.col("exposed").alias("finale_exposed"))
    wind = w.select("ride_id", F.col("speed").alias("wind"), F.col("dir_from").alias("wind_dir"), F.col("source").alias("wind_source"), "cda")
    circuit = report["circuit"].select("ride_id", F.struct("lat", "lon", "lap_len").alias("circuit"))
    hr = report["hr"].select("ride_id", F.struct("avg", "max", "p95", "decoupling").alias("hr"))
    shape = report["shape"].select("ride_id", F.struct("trend", "slope_pct", "avg_np", "sd").alias("shape"))
    out = rides.select("ride_id", "name", F.timestamp_seconds("start_time").alias("date")).join(s, "ride_id").join(finale, "ride_id", "left").join(wind, "ride_id", "left")
    for side in (circuit, hr, shape):
        out = out.join(side, "ride_id", "left")
    return out.select(
        "ride_id", "name", "date", (F.col("moving_seconds") / 60).alias("minutes"), (F.col("distance") / 1000).alias("distance_km"), "avg", "np", "exposed", "sheltered", "median", "saved_pct",
        "laps", "turns", "surges", "match_kj", "corner_kj", "wbal_min_pct", "finale_exposed", "wind", "wind_dir", "wind_source", "cda", "circuit", "hr", "shape",
    )


def side_by_side(df: DataFrame, key: str, column: str, value: Column, names: list | None = None) -> DataFrame:
    """A row a key, a column for each of ``names`` (by default all that occur in ``column``)."""
    if names is None:
        names = sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().collect())
    return df.groupBy(key).pivot(column, names).agg(value)


def turn_matrix(turns: DataFrame) -> DataFrame:
    """Speed lost in each corner (km/h), a column a corner, as many as the ride with most of them has."""
    most = turns.agg(F.max("number")).first()[0] or 0
    return side_by_side(turns, "ride_id", "number", F.first(F.round(F.col("loss_v") * 3.6, 3)), list(range(1, most + 1)))


def same_circuit_pairs(circuits: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of rides on the same circuit, by cells of a degree's hundredth."""
    cell = lambda c: F.floor(F.col(c) * 100).cast("long")
    left = circuits.select(*(F.col(c).alias(f"a_{c}") for c in ("ride_id", "lat", "lon", "lap_len")), cell("lat").alias("_y"), cell("lon").alias("_x"))
    near = F.explode(F.array(*(F.struct((cell("lat") + i).alias("_y"), (cell("lon") + j).alias("_x")) for i in (-1, 0, 1) for j in (-2, -1, 0, 1, 2))))
    right = circuits.select(*(F.col(c).alias(f"b_{c}") for c in ("ride_id", "lat", "lon", "lap_len")), near.alias("_c")).select("*", "_c._y", "_c._x").drop("_c")
    ratio = F.try_divide(F.abs(F.col("a_lap_len") - F.col("b_lap_len")), F.greatest("a_lap_len", "b_lap_len"))
    apart = planar_metres(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    pairs = left.join(right, ["_y", "_x"]).where((F.col("a_ride_id") < F.col("b_ride_id")) & (apart < APART) & (F.coalesce(ratio, F.lit(1.0)) < LENGTH))
    return pairs.select(F.col("a_ride_id").alias("a"), F.col("b_ride_id").alias("b"), apart.alias("apart"), ratio.alias("length_ratio")).distinct()


def same_circuit_classes(circuits: DataFrame) -> DataFrame:
    """What ``same_circuit_pairs`` has, without expanding copies: rides that are equal in place and length are a class, named by its first ride.

    A row with ``copy`` is a ride ``b`` of the class ``a``. Other rows are classes ``a`` and ``b`` such that each ride of ``a`` is on the same
    circuit as every ride of ``b`` that comes after it, with ``apart`` and ``length_ratio`` as these pairs have them. (Distances are flat at the
    first ride of a pair, so two classes have a row each way where some rides of either come first.) All pairs follow from these rows.
    """
    place = ["lat", "lon", "lap_len"]
    rides = circuits.select("ride_id", *(F.col(c).cast("double").alias(c) for c in place)).dropna().distinct()
    classes = rides.groupBy(*place).agg(F.min("ride_id").alias("first"), F.max("ride_id").alias("last"))
    copies = rides.join(classes, place).where("ride_id > first").select(F.col("first").alias("a"), F.col("ride_id").alias("b"), F.lit(0.0).alias("apart"), F.lit(0.0).alias("length_ratio"), F.lit(True).alias("copy"))
    level = _level(F.col("lat"))
    own = classes.select(*(F.col(c).alias(f"a_{c}") for c in [*place, "first"]), level.alias("_k"), F.floor(F.col("lat") / CELL).cast("long").alias("_y"), _across(F.col("lon"), level).alias("_x"))
    beside = lambda c: F.explode(F.sequence(c - 1, c + 1))
    near = classes.withColumn("_k", F.explode(F.array_distinct(F.array(*(_level(F.col("lat") + d) for d in (-CELL, 0.0, CELL))))))
    near = near.withColumn("_y", beside(F.floor(F.col("lat") / CELL).cast("long"))).withColumn("_x", beside(_across(F.col("lon"), F.col("_k"))))
    near = near.select(*(F.col(c).alias(f"b_{c}") for c in [*place, "first", "last"]), "_k", "_y", "_x")
    ratio = F.try_divide(F.abs(F.col("a_lap_len") - F.col("b_lap_len")), F.greatest("a_lap_len", "b_lap_len"))
    apart = planar_metres(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    other = (F.col("a_lat") != F.col("b_lat")) | (F.col("a_lon") != F.col("b_lon")) | (F.col("a_lap_len") != F.col("b_lap_len"))
    pairs = own.join(near, ["_k", "_y", "_x"]).where((F.col("a_first") < F.col("b_last")) & other & (F.coalesce(ratio, F.lit(1.0)) < LENGTH) & (apart < APART))
    return pairs.select(F.col("a_first").alias("a"), F.col("b_first").alias("b"), apart.alias("apart"), ratio.alias("length_ratio"), F.lit(False).alias("copy")).union(copies)


#: Degrees of latitude in a cell, somewhat more than ``APART``; the largest exponent of a cell's width.
CELL, WIDEST = 0.0025, 12


def _level(lat: Column) -> Column:
    """How often a cell's width is doubled at a latitude, so that it stays as wide in metres as it is high."""
    return F.least(F.ceil(F.log2(1 / F.greatest(F.cos(F.radians(lat)), F.lit(2.0**-WIDEST)))), F.lit(WIDEST)).cast("long")


def _across(lon: Column, level: Column) -> Column:
    return F.floor(lon / (CELL * F.pow(F.lit(2.0), level))).cast("long")


def _in_cells(rides: DataFrame) -> DataFrame:
    """rides with the cell they lie in: ``_k`` (level), ``_y``, ``_x`` and, by length, ``_z``."""
    size = F.floor(F.log(F.col("lap_len")) / -math.log(1 - LENGTH)).cast("long")
    level = _level(F.col("lat"))
    return rides.withColumns({"_k": level, "_y": F.floor(F.col("lat") / CELL).cast("long"), "_x": _across(F.col("lon"), level), "_z": size})


def _around(rides: DataFrame) -> DataFrame:
    """A row for each cell where what is the same as a ride may lie: rides of ``_in_cells``, copied to those beside their own."""
    levels = F.array_distinct(F.array(*(_level(F.col("lat") + d) for d in (-CELL, 0.0, CELL))))
    beside = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
    out = rides.withColumn("_k", F.explode(levels))
    return out.withColumn("_x", _across(F.col("lon"), F.col("_k"))).withColumn("_y", beside("_y")).withColumn("_x", beside("_x")).withColumn("_z", beside("_z"))


CELLS = ["_k", "_y", "_x", "_z"]


def _meet(rides: DataFrame, leaders: DataFrame) -> DataFrame:
    """Rides with each leader before them that was on the same circuit; a ride meets only the leaders of cells near its own."""
    of = _around(_in_cells(leaders)).select(*CELLS, F.col("ride_id").alias("l_id"), F.col("_rank").alias("l_rank"), F.col("lat").alias("l_lat"), F.col("lon").alias("l_lon"), F.col("lap_len").alias("l_len"))
    ratio = F.try_divide(F.abs(F.col("lap_len") - F.col("l_len")), F.greatest("lap_len", "l_len"))
    own, other = (F.col("lat"), F.col("lon")), (F.col("l_lat"), F.col("l_lon"))
    apart = F.when(F.col("ride_id") < F.col("l_id"), planar_metres(*own, *other)).otherwise(planar_metres(*other, *own))
    return _in_cells(rides).join(of, CELLS).where((F.col("l_rank") < F.col("_rank")) & (apart < APART) & (F.coalesce(ratio, F.lit(1.0)) < LENGTH))


def circuit_groups(circuits: DataFrame, order: str = "ride_id", keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """circuits with ``circuit_id`` and ``races``, circuits with most races first: rides in order, each joins the first
    group whose first ride was on the same circuit; that ride gives the group its id.

    An index of leaders. In each round the first open ride of each cell is found by a grouped minimum; it leads if none
    before it is open in the cells around. Open rides then meet the round's leaders, a few a cell, and those on the same
    circuit as an earlier one follow, so they lead nobody. When all lead or follow, followers meet all leaders near them
    and join the first. Rides never meet each other, so a million of them on one circuit are a million rows of work.
    Circuits without a place or a length are groups of their own.
    """
    keep = keep or Staging(circuits.sparkSession).put
    tag = uuid.uuid4().hex
    rank = F.struct(order, "ride_id") if order != "ride_id" else F.struct("ride_id")
    slim = keep(circuits.select("ride_id", rank.alias("_rank"), *(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in ("lat", "lon", "lap_len"))), f"circuits-{tag}")
    placed = "lat IS NOT NULL AND lon IS NOT NULL AND lap_len > 0"
    open_, leaders, at = slim.where(placed), [], 0
    while open_.head(1):
        firsts = _in_cells(open_).groupBy(*CELLS).agg(F.min(F.struct("_rank", "ride_id", "lat", "lon", "lap_len")).alias("m")).select(*CELLS, "m.*")
        claims = _around(firsts).groupBy(*CELLS).agg(F.min("_rank").alias("_least"))
        lead = keep(firsts.join(claims, CELLS).where("_rank <= _least").drop(*CELLS, "_least"), f"leaders-{at}-{tag}")
        leaders.append(lead)
        gone = _meet(open_, lead).select("ride_id").union(lead.select("ride_id"))
        open_ = keep(open_.join(gone.distinct(), "ride_id", "left_anti"), f"open-{at}-{tag}")
        at += 1
    every = reduce(DataFrame.union, (d.select(*slim.columns) for d in leaders)) if leaders else slim.limit(0)
    joined = _meet(slim.where(placed), every).groupBy("ride_id").agg(F.min_by("l_id", "l_rank").alias("leader"))
    state = keep(slim.select("ride_id").join(joined, "ride_id", "left").select("ride_id", F.coalesce("leader", "ride_id").alias("leader")), f"groups-{tag}")
    races = state.groupBy("leader").agg(F.count(F.lit(1)).alias("races"))
    named = circuits.join(state, "ride_id").join(races, "leader").withColumnRenamed("leader", "circuit_id")
    return named.select(*circuits.columns, "circuit_id", "races").orderBy(F.col("races").desc(), "circuit_id", order)
