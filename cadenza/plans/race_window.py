"""Where the race is inside a recording with warm-up, cool-down and the way there and home."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.config import ModelConfig
from cadenza.functions.geo import DEGREE_M
from cadenza.operators.aggregates import pick_ranked
from cadenza.operators.islands import runs
from cadenza.operators.joins import within_radius
from cadenza.operators.series import RIDE, Series, last_known, power_mean
from cadenza.plans.laps import lap_samples
from cadenza.plans.mean_lap import STEP, mean_lap
from cadenza.plans.prepare import located
from cadenza.plans.turns import Keep


@dataclass(frozen=True)
class WindowConfig:
    """Metres to the circuit and to the racing line, and how soft or slow a lap of warm-up or cool-down is."""

    circuit: float = 45.0
    line: float = 25.0
    off_line: float = 0.2
    deviation: float = 4.0
    cool_np: float = 0.65
    cool_pace: float = 0.62
    warm_np: float = 0.45
    warm_pace: float = 0.55
    least_laps: int = 4
    fragment: int = 20


def distance_to_line(points: DataFrame, line: DataFrame, every: int, radius: float, out: str, close: float | None = None, keep: Keep = lambda df, name: df) -> DataFrame:
    """points (``ride_id, i`` and a place) with the distance to the nearest of every so many points of the ride's line, null beyond ``radius``.

    Where most points are nearer than ``close``, pairs are fewer with it."""
    origin = line.where("j = 0").select("ride_id", F.col("lat").alias("_lat0"), F.col("lon").alias("_lon0"))
    thin = line.where(F.col("j") % every == 0).select("ride_id", "x", "y")
    flat = points.where(located()).join(origin, "ride_id").select("ride_id", "i", ((F.col("lon") - F.col("_lon0")) * DEGREE_M * F.cos(F.radians("_lat0"))).alias("x"), ((F.col("lat") - F.col("_lat0")) * DEGREE_M).alias("y"))
    nearest = lambda flat, radius: within_radius(flat, thin, ("ride_id",), "x", "y", radius, out).groupBy("ride_id", "i").agg(F.min(out).alias(out))
    if not close:
        return points.join(nearest(flat, radius), ["ride_id", "i"], "left")
    # most points are near: only the others look further, among many more
    near = keep(nearest(flat, close), f"close{out}")
    far = nearest(flat.join(near, ["ride_id", "i"], "left_anti"), radius)
    return points.join(near.unionByName(far), ["ride_id", "i"], "left")


def _fragment_power(grid: DataFrame, bounds: DataFrame, inside: Column, name: str) -> DataFrame:
    """Normalised power of the moving seconds of one stretch of each ride, null if there are fewer than twenty."""
    s = grid.where("moving").join(bounds, "ride_id").where(inside)
    return power_mean(s, RIDE, "watts", name, extra=[F.count(F.lit(1)).alias("_n")]).select("ride_id", F.when(F.col("_n") >= WindowConfig.fragment, F.col(name)).alias(name))


def race_window(grid: DataFrame, laps: DataFrame, config: ModelConfig = ModelConfig(), rules: WindowConfig = WindowConfig(), keep: Keep = lambda df, name: df, circuit: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(window, lap_info, phases). Rides without four laps keep their whole recording, ``found`` false.

    A lap that leaves the racing line, is soft or slow is no race lap; such
    laps are cut off at both ends only, so a race that fades keeps all of its laps. ``circuit`` is the mean lap of ``laps``
    where it is known.
    """
    enough = laps.where("source <> 'none'").withColumn("_c", F.count(F.lit(1)).over(Window.partitionBy("ride_id"))).where(F.col("_c") >= rules.least_laps).drop("_c")
    g = grid.join(enough.select("ride_id").distinct(), "ride_id", "left_semi")
    # on the circuit or not; a second without a place is where the one before was
    circuit = keep(mean_lap(g, enough), "window_circuit") if circuit is None else circuit.join(enough.select("ride_id").distinct(), "ride_id", "left_semi")
    on = distance_to_line(g.select("ride_id", "i", "moving", "lat", "lon", "watts"), circuit, max(1, int(10 / STEP + 0.5)), rules.circuit, "_d")
    has_line = circuit.select("ride_id").distinct().withColumn("_line", F.lit(True))
    on = on.join(has_line, "ride_id", "left").withColumn("on_circuit", F.when(F.col("_line").isNull(), True).otherwise(F.coalesce(last_known(F.when(located(), F.col("_d").isNotNull()), RIDE), F.lit(False)))).drop("_line", "_d")
    on = keep(on, "on_circuit")
    # laps with pace, power and distance from the line of the faster half
    samples = lap_samples(g.select("ride_id", "i", "dist", "watts", "moving", "lat", "lon"), enough)
    info = samples.groupBy("ride_id", "lap", "i0", "i1", "source").agg((F.max("i") - F.min("i")).cast("double").alias("seconds"), (F.max("dist") - F.min("dist")).alias("_len"))
    info = info.withColumn("speed", F.coalesce(F.try_divide(F.col("_len"), F.col("seconds")), F.lit(0.0)))
    np = power_mean(samples.where("moving"), Series(("ride_id", "lap"), ("i",)), "watts")
    info = info.join(np, ["ride_id", "lap"], "left").withColumn("np", F.coalesce("np", F.lit(0.0)))
    place = F.row_number().over(Window.partitionBy("ride_id").orderBy(F.col("speed").desc(), "lap"))
    info = info.withColumn("fast", place <= F.greatest(F.lit(3), F.ceil(F.count(F.lit(1)).over(Window.partitionBy("ride_id")) * 0.5)))
    info = keep(info, "window_laps")
    line = mean_lap(g, info.where("fast").select("ride_id", "lap", "i0", "i1", "source"))
    line = keep(line, "window_line")
    away = distance_to_line(g.where(F.col("moving") & located()).select("ride_id", "i", "lat", "lon"), line, max(1, int(6 / STEP + 0.5)), 4 * rules.circuit, "_dev", rules.line, keep)
    # what is farther from the line than any lap should ever be counts as that far
    away = away.withColumn("_dev", F.coalesce("_dev", F.lit(4 * rules.circuit))).select("ride_id", "i", "_dev")
    per_lap = samples.select("ride_id", "lap", "i").join(away, ["ride_id", "i"]).join(line.select("ride_id").distinct(), "ride_id", "left_semi")
    per_lap = per_lap.groupBy("ride_id", "lap").agg(F.avg((F.col("_dev") > rules.line).cast("double")).alias("off_line"), F.avg("_dev").alias("mean_dev"))
    info = keep(info.join(per_lap, ["ride_id", "lap"], "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("off_line", "mean_dev")}), "window_deviations")
    for name, value, share, rows in (("typical", "mean_dev", 0.5, info.where("fast")), ("race_pace", "speed", 0.75, info), ("race_np", "np", 0.75, info)):
        info = info.join(pick_ranked(rows, ("ride_id",), value, share, name), "ride_id")
    left = (F.col("off_line") > rules.off_line) | ((F.col("typical") > 0.5) & (F.col("mean_dev") > F.col("typical") * rules.deviation))
    soft = lambda share: (F.col("np") > 0) & (F.col("np") < F.col("race_np") * share)
    slow = lambda share: F.col("speed") < F.col("race_pace") * share
    info = info.withColumn("left_course", left).withColumns({"_cool": left | soft(rules.cool_np) | slow(rules.cool_pace), "_warm": left | soft(rules.warm_np) | slow(rules.warm_pace)}).where("race_pace > 0")
    last_lap = F.max("lap").over(Window.partitionBy("ride_id"))
    info = keep(info.withColumn("_last", last_lap), "window_judged")
    ends = info.groupBy("ride_id").agg(F.coalesce(F.min(F.when(~F.col("_warm"), F.col("lap"))), F.max("lap")).alias("first_lap"), F.max(F.when(~F.col("_cool"), F.col("lap"))).alias("_b"), F.max("lap").alias("total_laps"), F.first("race_pace").alias("race_pace"), F.first("race_np").alias("race_np"), F.first("source").alias("_source"))
    ends = ends.withColumn("last_lap", F.greatest("first_lap", F.coalesce("_b", F.lit(0)))).where(F.col("last_lap") - F.col("first_lap") >= 2)
    # the first long stop after the first race lap ends the race
    stops = runs(g, RIDE, ~F.col("moving"), least=config.stop_seconds).select("ride_id", F.col("i0").alias("_s0"))
    first_end = info.join(ends.select("ride_id", "first_lap"), "ride_id").where("lap = first_lap").select("ride_id", F.col("i1").alias("_first1"))
    halted = stops.join(first_end, "ride_id").where("_s0 > _first1").groupBy("ride_id").agg(F.min("_s0").alias("_halt"))
    n_stops = stops.groupBy("ride_id").agg(F.count(F.lit(1)).alias("stops"))
    ends = ends.join(halted, "ride_id", "left").join(n_stops, "ride_id", "left")
    before_halt = info.select("ride_id", "lap", "i0").join(ends.select("ride_id", "first_lap", "last_lap", "_halt"), "ride_id").where("lap >= first_lap and lap <= last_lap and (_halt is null or i0 <= _halt or lap = first_lap)")
    ends = ends.drop("last_lap").join(before_halt.groupBy("ride_id").agg(F.max("lap").alias("last_lap")), "ride_id").withColumn("ended_at_stop", F.col("_halt").isNotNull())
    edges = info.join(ends.select("ride_id", "first_lap", "last_lap"), "ride_id").groupBy("ride_id").agg(
        F.max(F.when(F.col("lap") == F.col("first_lap"), F.col("i0"))).alias("_i0"), F.max(F.when(F.col("lap") == F.col("last_lap"), F.col("i1"))).alias("_i1"),
        F.max(F.col("left_course")).alias("any_left_course"), F.max(F.col("left_course") & ((F.col("lap") < F.col("first_lap")) | (F.col("lap") > F.col("last_lap")))).alias("trimmed_by_course"),
    )
    ends = keep(ends.join(edges, "ride_id"), "window_ends")
    # pieces of laps before the first and after the last belong to the race if they were raced
    cuts = ends.select("ride_id", "_i0", "_i1")
    tail, head = (_fragment_power(g, cuts, inside, name) for inside, name in ((F.col("i") > F.col("_i1"), "_tail"), (F.col("i") < F.col("_i0"), "_head")))
    size = g.groupBy("ride_id").agg(F.max("i").alias("_n1"), _count(~F.col("moving")).alias("_stopped"), F.min(F.when(F.col("moving"), F.col("i"))).alias("_first_move"))
    w = ends.join(tail, "ride_id", "left").join(head, "ride_id", "left").join(size, "ride_id")
    keep_tail = F.coalesce((F.col("last_lap") == F.col("total_laps")) & (F.col("_tail") >= F.col("race_np") * rules.cool_np), F.lit(False))
    keep_head = F.coalesce((F.col("first_lap") == 1) & (F.col("_head") >= F.col("race_np") * rules.warm_np), F.lit(False))
    w = w.withColumns({"kept_trailing_fragment": keep_tail, "kept_leading_fragment": keep_head, "i0": F.when(keep_head, 0).otherwise(F.col("_i0")), "i1": F.when(keep_tail, F.col("_n1")).otherwise(F.col("_i1"))})
    w = keep(w, "window_edges")
    # phases
    p = on.join(w.select("ride_id", F.col("i0").alias("_w0"), F.col("i1").alias("_w1"), "_n1"), "ride_id")
    i = F.col("i")
    p = p.withColumns({"_arrive": F.coalesce(F.min(F.when(F.col("on_circuit") & (i < F.col("_w0")), i)).over(RIDE.whole), F.col("_w0")), "_leave": F.coalesce(F.max(F.when(F.col("on_circuit") & (i > F.col("_w1")), i)).over(RIDE.whole), F.col("_w1"))})
    kind = F.when(i < F.col("_arrive"), "approach").when(i < F.col("_w0"), "warmup").when(i <= F.col("_w1"), "race").when(i <= F.col("_leave"), "cooldown").otherwise("home")
    phases = p.withColumn("kind", kind).groupBy("ride_id", "kind").agg(F.min("i").alias("i0"), F.max("i").alias("i1"), _count(F.col("moving")).alias("seconds")).where("seconds > 5")
    sec = lambda c: _count(F.col("moving") & c)
    early, late = i < F.col("_w0"), i > F.col("_w1")
    spent = p.groupBy("ride_id").agg(sec(early & ~F.col("on_circuit")).alias("approach_seconds"), sec(early & F.col("on_circuit")).alias("warmup_seconds"), sec(late & F.col("on_circuit")).alias("cooldown_seconds"), sec(late & ~F.col("on_circuit")).alias("home_seconds"))
    w = w.join(spent, "ride_id")
    trimmed = (F.col("_stopped") / F.greatest(F.col("_n1"), F.lit(1)) < 0.03) & (F.coalesce("_first_move", F.lit(0)) < 15)
    race_laps = F.col("last_lap") - F.col("first_lap") + 1
    outside = F.col("approach_seconds") + F.col("warmup_seconds") + F.col("cooldown_seconds") + F.col("home_seconds")
    basis = F.concat_ws(", ", F.when(F.col("_source") == "manual", "your start/finish line").otherwise("circuit geometry"), F.when(F.col("any_left_course"), F.lit("the racing line")), F.lit("lap power"), F.when(F.col("ended_at_stop"), F.lit("and the stop after the finish")))
    found = w.select(
        "ride_id", F.lit(True).alias("found"), "i0", "i1", "approach_seconds", "warmup_seconds", "cooldown_seconds", "home_seconds", race_laps.alias("race_laps"), "total_laps", "first_lap", "last_lap",
        ((race_laps == F.col("total_laps")) & (outside < 60)).alias("pre_cropped"), "trimmed_by_course", "any_left_course", trimmed.alias("looks_pre_trimmed"), F.when(trimmed, 120).otherwise(60).alias("min_worth_trimming"),
        "kept_trailing_fragment", "kept_leading_fragment", "race_pace", "race_np", "ended_at_stop", F.coalesce("stops", F.lit(0)).alias("stops"), basis.alias("basis"),
    )
    rest = grid.join(found.select("ride_id"), "ride_id", "left_anti").groupBy("ride_id").agg(F.min("i").alias("i0"), F.max("i").alias("i1")).withColumns({"found": F.lit(False), "basis": F.lit("whole recording")})
    window = found.unionByName(rest, allowMissingColumns=True)
    lap_info = info.join(found.select("ride_id", "first_lap", "last_lap"), "ride_id").withColumn("in_race", F.col("lap").between(F.col("first_lap"), F.col("last_lap"))).select("ride_id", "lap", "i0", "i1", "seconds", "speed", "np", "off_line", "mean_dev", "left_course", "in_race")
    return window, lap_info, phases


def adjust_window(window: DataFrame, lap_info: DataFrame, start: int, end: int) -> DataFrame:
    """window moved by whole laps at both ends, within the laps there are. Phases and the seconds outside stay as they were."""
    w = window.where("found")
    a = F.greatest(F.lit(1), F.least(F.col("last_lap"), F.col("first_lap") + start))
    b = F.least(F.col("total_laps"), F.greatest(a, F.col("last_lap") + end))
    w = w.withColumns({"_a": a, "_b": b}).withColumns({"first_lap": F.col("_a"), "last_lap": F.col("_b"), "race_laps": F.col("_b") - F.col("_a") + 1})
    edges = lap_info.select("ride_id", "lap", F.col("i0").alias("_i0"), F.col("i1").alias("_i1")).join(w.select("ride_id", "_a", "_b"), "ride_id").groupBy("ride_id").agg(F.max(F.when(F.col("lap") == F.col("_a"), F.col("_i0"))).alias("_i0"), F.max(F.when(F.col("lap") == F.col("_b"), F.col("_i1"))).alias("_i1"))
    moved = w.join(edges, "ride_id").withColumns({"i0": F.col("_i0"), "i1": F.col("_i1")}).select(*window.columns)
    return moved.unionByName(window.where("not found"))


def worth_trimming(window: DataFrame) -> DataFrame:
    """``ride_id, offer, auto_tail``: whether what lies outside the race is worth cutting off, and whether the end may go unasked."""
    spare = F.coalesce(F.col("approach_seconds") + F.col("warmup_seconds") + F.col("cooldown_seconds") + F.col("home_seconds"), F.lit(0))
    tail = F.coalesce(F.col("cooldown_seconds") + F.col("home_seconds"), F.lit(0))
    return window.select("ride_id", (F.col("found") & (spare > F.coalesce("min_worth_trimming", F.lit(60)))).alias("offer"), (F.col("found") & (tail > 60)).alias("auto_tail"))


def _count(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0))
