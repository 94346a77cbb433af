"""Drag area and wind from the data: cohorts and drag areas in SQL, winds by one small NumPy solve a ride."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.config import ModelConfig
from cadenza.functions.physics import GRAVITY, power_terms
from cadenza.functions.wind import sector_of, shelter_factor, wind_bearing, wind_vector
from cadenza.operators.series import RIDE
from cadenza.plans.staging import Staging

#: Bounds of drag areas and how often the bracket is halved.
LOW, HIGH, HALVINGS = 0.16, 0.60, 18
#: Halvings in one pass over the rows.
TOGETHER = 3


def octant_spread(df: DataFrame, keys: tuple[str, ...], octant: str, share: float = 0.05) -> DataFrame:
    """How many octants hold at least ``share`` of each key's rows."""
    counts = df.groupBy(*keys, octant).agg(F.count(F.lit(1)).alias("_c"))
    own = counts.withColumn("_share", F.col("_c") / F.sum("_c").over(Window.partitionBy(*keys)))
    return own.groupBy(*keys).agg(F.sum(F.when(F.col("_share") >= share, 1).otherwise(0)).alias("spread"))


def relaxed_cohort(df: DataFrame, keys: tuple[str, ...], strict: Column, loose: Column, least: int) -> DataFrame:
    """Rows that pass ``strict``; of keys with fewer than ``least`` such rows, those that pass ``loose`` if these are more. Adds ``relaxed``."""
    whole = Window.partitionBy(*keys)
    df = df.withColumns({"_strict": F.coalesce(strict, F.lit(False)), "_loose": F.coalesce(loose, F.lit(False))})
    n = lambda c: F.sum(F.col(c).cast("int")).over(whole)
    df = df.withColumn("relaxed", (n("_strict") < least) & (n("_loose") > n("_strict")))
    return df.where(F.when(F.col("relaxed"), F.col("_loose")).otherwise(F.col("_strict"))).drop("_strict", "_loose")


def clean_air(grid: DataFrame) -> DataFrame:
    """Seconds of steady, straight, fast riding under power (``cp`` is a column)."""
    rides = F.col("moving") & ~F.col("gap") & (F.col("v") >= 6.5) & (F.col("watts") >= 0.45 * F.col("cp"))
    tight = lambda a, k: rides & (F.abs("accel") <= a) & (F.abs("curvature") <= k)
    return relaxed_cohort(grid, ("ride_id",), tight(0.15, 1 / 80), tight(0.3, 1 / 30), 250)


def ratio_quantiles(watts: np.ndarray, need: np.ndarray, floor: float, pct: float) -> tuple[np.ndarray, np.ndarray]:
    """The ``pct`` quantile of watts / need in each row of need, over entries above the floor; how many these are."""
    fine = need > floor
    ratio = np.sort(np.where(fine, watts / np.where(fine, need, 1.0), np.inf), axis=1)
    n = fine.sum(1)
    at = pct * np.maximum(n - 1, 0)
    low = np.floor(at).astype(int)
    a, b = (np.take_along_axis(ratio, np.minimum(x, np.maximum(n - 1, 0))[:, None], 1)[:, 0] for x in (low, low + 1))
    with np.errstate(invalid="ignore"):
        return np.where(n > 0, a + np.where(at > low, (b - a) * (at - low), 0.0), np.nan), n


def drag_at_one(watts: np.ndarray, fixed: np.ndarray, per_cda: np.ndarray, floor: float, default: float, pct: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of terms: the drag area at which the quantile of watts over need is 1, whether it is
    bracketed, and -1 or 1 where it lies beyond the low or high bound."""
    rows = len(fixed)
    value = lambda cda: ratio_quantiles(watts, fixed + per_cda * cda[:, None], floor, pct)
    low, high = np.full(rows, LOW), np.full(rows, HIGH)
    (at_low, n_low), (at_high, n_high) = value(low), value(high)
    known = (n_low >= 20) & (n_high >= 20) & (watts.shape[-1] >= 30)
    side = np.where(known & (at_low < 1), -1, np.where(known & (at_high > 1), 1, 0))
    for _ in range(HALVINGS):
        middle = (low + high) / 2
        above = value(middle)[0] > 1
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    cda = np.select([~known, side < 0, side > 0], [default, LOW, HIGH], (low + high) / 2)
    return cda, known & (side == 0), side


def _near_one(ratio: Column, name: str, under: bool = False) -> list[Column]:
    """What tells the side of 1 of any quantile: how many ratios there are, how many up to 1 (or under it), and those next to 1."""
    low = ratio < 1 if under else ratio <= 1
    return [F.count(ratio).alias(f"_n{name}"), F.count_if(low).alias(f"_c{name}"), F.max(F.when(low, ratio)).alias(f"_a{name}"), F.min(F.when(~low, ratio)).alias(f"_b{name}")]


def _beyond_one(name: str, pct: float, under: bool = False) -> Column:
    """Whether the ``pct`` quantile is above 1 (or under it), from the columns of ``_near_one``."""
    n, c, a, b = (F.col(f"_{x}{name}") for x in "ncab")
    at = F.lit(pct) * F.greatest(n - 1, F.lit(0))
    low = F.floor(at)
    between = F.when(at > low, a + (b - a) * (at - low)).otherwise(a)
    few, many = (F.lit(False), F.lit(True)) if under else (n > 0, F.lit(False))
    return F.when(c <= low, few).when(c >= low + 2, many).otherwise(between < 1 if under else between > 1)


def solve_drag(cohort: DataFrame, keys: tuple[str, ...], floor: Column, default: Column, pct: float, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """``keys, cda, ok, side, cohort_size`` from rows of ``watts``, ``fixed`` and ``per_cda``.

    Each pass over the rows does ``TOGETHER`` halvings of all keys by counts and extremes, which add up in parts: no
    task holds a key, however many rows it has. Brackets are staged between passes.
    """
    keep = keep or Staging(cohort.sparkSession).put
    rows = keep(cohort.select(*keys, *(F.col(c).cast("double").alias(f"_{c}") for c in ("watts", "fixed", "per_cda")), floor.alias("_floor"), default.alias("_default")), "drag_rows")

    def ratio(cda: Column) -> Column:
        need = F.col("_fixed") + F.col("_per_cda") * cda
        return F.when((need > F.col("_floor")) & ~F.isnan(need), F.col("_watts") / need)

    ends = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("cohort_size"), F.max("_default").alias("_default"), *_near_one(ratio(F.lit(LOW)), "_low", under=True), *_near_one(ratio(F.lit(HIGH)), "_high"))
    known = (F.col("_n_low") >= 20) & (F.col("_n_high") >= 20) & (F.col("cohort_size") >= 30)
    side = F.when(known & _beyond_one("_low", pct, under=True), -1).when(known & _beyond_one("_high", pct), 1).otherwise(0)
    found = keep(ends.select(*keys, "cohort_size", "_default", known.alias("_known"), side.alias("side"), F.lit(LOW).alias("_from"), F.lit(HIGH).alias("_to")), "drag_ends")
    sides = rows.drop("_default").withColumnsRenamed({k: f"_key_{k}" for k in keys})
    for step in range(0, HALVINGS if found.head(1) else 0, TOGETHER):
        depth, middles = min(TOGETHER, HALVINGS - step), {}

        def split(low: Column, high: Column, path: str = "_") -> None:
            middles[path] = middle = (low + high) / 2
            if len(path) < depth:
                split(low, middle, path + "l")
                split(middle, high, path + "h")

        def follow(low: Column, high: Column, path: str = "_") -> Column:
            if len(path) > depth:
                return F.struct(low.alias("low"), high.alias("high"))
            middle = F.col(f"_m{path}")
            return F.when(_beyond_one(path, pct), follow(middle, high, path + "h")).otherwise(follow(low, middle, path + "l"))

        split(F.col("_from"), F.col("_to"))
        brackets = found.withColumns({f"_m{path}": middle for path, middle in middles.items()})
        same = reduce(and_, (sides[f"_key_{k}"].eqNullSafe(brackets[k]) for k in keys))
        counted = sides.join(brackets, same).groupBy(*brackets.columns).agg(*(c for path in middles for c in _near_one(ratio(F.col(f"_m{path}")), path)))
        halved = counted.withColumn("_bracket", follow(F.col("_from"), F.col("_to")))
        found = keep(halved.withColumns({"_from": F.col("_bracket.low"), "_to": F.col("_bracket.high")}).select(*found.columns), f"drag_{step}")
    cda = F.when(~F.col("_known"), F.col("_default")).when(F.col("side") < 0, LOW).when(F.col("side") > 0, HIGH).otherwise((F.col("_from") + F.col("_to")) / 2)
    return found.select(*keys, cda.alias("cda"), (F.col("_known") & (F.col("side") == 0)).alias("ok"), "side", "cohort_size")


def octant_costs(watts: np.ndarray, need: np.ndarray, octant: np.ndarray, floor: float, pct: float, least: int, enough: int) -> np.ndarray:
    """How far the octants' quantiles of watts / need are apart (weighted variance) for each row of need. Octants of fewer
    than ``least`` entries don't count; rows with fewer than ``enough`` counted entries cost infinity."""
    weight, first, second = np.zeros(len(need)), np.zeros(len(need)), np.zeros(len(need))
    for o in range(8):
        own = octant == o
        if own.sum() < least:
            continue
        q, k = ratio_quantiles(watts[own], need[:, own], floor, pct)
        k, q = np.where(k >= least, k, 0), np.where(k >= least, q, 0.0)
        weight, first, second = weight + k, first + k * q, second + k * q * q
    mean = first / np.maximum(weight, 1)
    return np.where(weight >= max(enough, 1), second / np.maximum(weight, 1) - mean**2, np.inf)


class WindFit:
    """Wind and drag area together: the wind with which all headings look equally hard."""

    def __init__(self, frame: pd.DataFrame, config: ModelConfig) -> None:
        self.rows, self.config = frame, config
        self.watts, self.v, self.heading = (self.rows[c].to_numpy(float) for c in ("watts", "v", "heading"))
        theta, accel, mass = (self.rows[c].to_numpy(float) for c in ("theta", "accel", "mass"))
        road = mass * GRAVITY * (np.sin(theta) + config.crr * np.cos(theta)) + (mass + config.rotating_mass) * accel
        self.fixed = road * self.v / config.efficiency
        self.octant = (np.degrees(self.heading) % 360 // 45).astype(int) % 8
        self.floor = max(40.0, 0.5 * float(self.rows["cp"].iat[0]))
        self.rho = float(self.rows["rho"].iat[0])

    def spread(self) -> int:
        return int((np.bincount(self.octant, minlength=8) >= 0.05 * len(self.rows)).sum())

    def costs(self, winds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The spread of octants, and the drag area, for each of the winds (east, north)."""
        e, n = winds[:, :1], winds[:, 1:]
        along = self.v - (e * np.sin(self.heading) + n * np.cos(self.heading))
        cross = e * np.cos(self.heading) - n * np.sin(self.heading)
        speed = np.hypot(along, cross)
        sine = np.divide(cross, speed, out=np.zeros_like(cross), where=speed > 1e-6)
        per_cda = 0.5 * self.rho * (1 + self.config.yaw_factor * sine**2) * speed * along * self.v / self.config.efficiency
        fixed = np.broadcast_to(self.fixed, per_cda.shape)
        cda, _, _ = drag_at_one(self.watts, fixed, per_cda, self.floor, self.config.cda, self.config.clean_air_pct)
        need = fixed + per_cda * cda[:, None]
        return octant_costs(self.watts, need, self.octant, self.floor, self.config.clean_air_pct, 12, 60), cda

    def solve(self) -> tuple[float, float, float, float]:
        """East, north, drag area and cost of the best wind: a coarse grid, refined twice."""
        best, cda, cost = np.zeros(2), self.config.cda, np.inf
        for reach, step in ((7.0, 1.0), (1.0, 0.25), (0.3, 0.1)):
            side = np.arange(-reach, reach + 1e-9, step)
            winds = np.array([(best[0] + e, best[1] + n) for e in side for n in side])
            every, drags = self.costs(winds)
            k = int(np.argmin(every))
            if every[k] < cost:
                best, cda, cost = winds[k], float(drags[k]), float(every[k])
        return float(best[0]), float(best[1]), cda, cost


#: A ride's seconds are thinned evenly to at least so many, fewer than twice as many.
SAMPLE = 450
FIT = "ride_id string, we double, wn double, cda double, ok boolean, spread int, cohort_size long, note string"


def fit_wind(cohort: DataFrame, config: ModelConfig) -> DataFrame:
    """Wind, drag area, spread of headings and a note for each ride of the cohort."""
    n, place = F.count(F.lit(1)).over(RIDE.whole), F.row_number().over(RIDE.window) - 1
    rows = cohort.select("ride_id", "i", "watts", "v", "theta", "accel", "heading", "mass", "cp", "rho").withColumns({"n": n, "_place": place})
    # every so-manieth second of a ride: what reaches Python is bounded however long rides are
    some = rows.where(F.col("_place") % F.greatest(F.lit(1), F.floor(F.col("n") / SAMPLE)) == 0).drop("_place")

    def solve(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        n = int(frame["n"].iat[0])
        result = (0.0, 0.0, config.cda, False, 0, n, "not enough steady riding to fit wind")
        if n >= 120:
            fit = WindFit(frame.sort_values("i"), config)
            spread = fit.spread()
            result = (0.0, 0.0, config.cda, False, spread, n, "course is too directional to separate wind from CdA")
            if spread >= 4:
                e, north, cda, cost = fit.solve()
                low = f"only {spread} of 8 compass sectors were ridden, so the inferred direction could be tens of degrees out"
                result = (e, north, cda, bool(np.isfinite(cost)), spread, n, low if spread < 6 else None)
        return pd.DataFrame([[*key, *result]], columns=[f.split()[0] for f in FIT.split(", ")])

    return some.groupBy("ride_id").applyInPandas(solve, FIT)


def resolve_wind(grid: DataFrame, config: ModelConfig, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """``ride_id, source, we, wn, speed, dir_from, reported10m, cda, ok, confidence, spread, cohort_size, note``.

    grid carries ``cp``, ``mass``, ``rho`` and ``we``, ``wn`` (null without weather). ``we`` and ``wn`` of the
    result are null where the wind of each second is used. Weather that is asked for but not known means a fit.
    """
    rides = grid.groupBy("ride_id").agg(F.avg("we").alias("_e"), F.avg("wn").alias("_n"))
    measured = F.col("_e").isNotNull()
    source = F.lit(config.wind_source)
    source = F.when((source == "weather") & ~measured, F.lit("fit-fallback")).otherwise(source)
    rides = rides.withColumn("source", source)
    manual = [c * shelter_factor(config.roughness) for c in wind_vector(F.lit(config.wind_speed), F.lit(config.wind_dir))]
    tagged = grid.join(rides.select("ride_id", "source"), "ride_id")
    cohort = clean_air(tagged)
    given = cohort.where("source in ('weather', 'manual')")
    east = F.when(F.col("source") == "weather", F.col("we")).otherwise(manual[0])
    north = F.when(F.col("source") == "weather", F.col("wn")).otherwise(manual[1])
    fixed, per_cda = power_terms(*map(F.col, ("v", "theta", "accel", "heading")), east, north, F.col("mass"), F.lit(config.crr), F.col("rho"), F.lit(config.efficiency), F.lit(config.rotating_mass), F.lit(config.yaw_factor))
    if config.wind_source != "fit":
        solved = solve_drag(given.withColumns({"fixed": fixed, "per_cda": per_cda}), ("ride_id",), F.greatest(F.lit(40.0), 0.5 * F.col("cp")), F.lit(config.cda), config.clean_air_pct, keep)
    else:  # no ride has a wind that is given
        solved = grid.sparkSession.createDataFrame([], "ride_id string, cda double, ok boolean, side int, cohort_size long")
    fitted = fit_wind(cohort.where("source in ('fit', 'fit-fallback')"), config)
    nothing = F.lit(None).cast("double")
    kept = rides.where("source in ('weather', 'manual')").join(solved, "ride_id", "left")
    by_hour = F.col("source") == "weather"
    e, n = F.when(by_hour, F.col("_e")).otherwise(manual[0]), F.when(by_hour, F.col("_n")).otherwise(manual[1])
    speed = F.hypot(e, n)
    bound = F.when(F.col("side") < 0, "low").when(F.col("side") > 0, "high")
    a = kept.select(
        "ride_id", "source", F.when(~by_hour, e).alias("we"), F.when(~by_hour, n).alias("wn"), speed.alias("speed"),
        F.when(by_hour, F.when(speed < 1e-6, 0.0).otherwise(wind_bearing(e, n))).otherwise(F.lit(config.wind_dir)).alias("dir_from"),
        F.when(~by_hour, F.lit(config.wind_speed)).alias("reported10m"), F.coalesce("cda", F.lit(config.cda)).alias("cda"), F.coalesce("ok", F.lit(False)).alias("ok"),
        F.lit(None).cast("string").alias("confidence"), F.lit(None).cast("int").alias("spread"), F.coalesce("cohort_size", F.lit(0)).alias("cohort_size"),
        F.when(bound.isNotNull(), F.concat(F.lit("CdA hit its "), bound, F.lit(" bound: check mass and speed data"))).alias("note"),
    )
    f = rides.where("source in ('fit', 'fit-fallback')").join(fitted, "ride_id", "left")
    we, wn = F.coalesce("we", F.lit(0.0)), F.coalesce("wn", F.lit(0.0))
    b = f.select(
        "ride_id", "source", we.alias("we"), wn.alias("wn"), F.hypot(we, wn).alias("speed"), F.when(F.hypot(we, wn) < 1e-9, 0.0).otherwise(wind_bearing(we, wn)).alias("dir_from"),
        nothing.alias("reported10m"), F.coalesce("cda", F.lit(config.cda)).alias("cda"), F.coalesce("ok", F.lit(False)).alias("ok"),
        F.when(F.col("spread") >= 7, "high").when(F.col("spread") >= 6, "medium").otherwise("low").alias("confidence"), "spread", F.coalesce("cohort_size", F.lit(0)).alias("cohort_size"), "note",
    )
    return {"fit": b, "manual": a}.get(config.wind_source, a.unionByName(b))


def heading_octant(heading: Column) -> Column:
    return sector_of(F.degrees(heading), 45.0, 8)
