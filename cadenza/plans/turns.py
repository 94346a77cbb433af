"""Corners of the circuit and what each pass of them costs."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.config import ModelConfig
from cadenza.functions.geo import DEGREE_M, corner_kind
from cadenza.functions.scalars import angle_difference
from cadenza.operators.aggregates import fit_circle, spread
from cadenza.operators.folds import Step, fold_sorted
from cadenza.operators.islands import closed_runs
from cadenza.operators.joins import interval_join, within_radius
from cadenza.operators.series import RIDE, Series
from cadenza.plans.laps import lap_lengths, lap_samples
from cadenza.plans.mean_lap import LINE, STEP
from cadenza.plans.prepare import located

#: Keeps a table that several others are made from, under a name.
Keep = Callable[[DataFrame, str], DataFrame]
#: A corner's shoulders are bends of up to this multiple of its radius, on the mean lap and on the raw track.
SHOULDER, RAW_SHOULDER = 1.7, 1.8
#: Seconds before the apex, until recovery, share of the entry speed that counts as recovered.
BACK, RECOVER, REGAINED = 8, 30, 0.97
#: Fixed value: pedalling is a cadence above this.
PEDALLING = 5

TURN = ["ride_id", "number", "name", "entry_s", "exit_s", "apex_s", "lat", "lon", "lap_offset", "turned", "dir", "radius", "length_m", "type", "mean_apex_v", "source", "first_seen"]
EVENT = ["ride_id", "number", "lap", "i0", "i1", "apex", "turned", "dir"]


def _corners(line: DataFrame, config: ModelConfig) -> DataFrame:
    """Corners of mean laps, without numbers."""
    k = F.abs("curvature")
    sign = F.when(k > 1 / (config.corner_radius * SHOULDER), F.signum("curvature")).otherwise(0.0)
    points = closed_runs(line, LINE, sign, k >= 1 / config.corner_radius)
    ends = lambda f, c: f(c, "unrolled")
    found = points.groupBy("ride_id", "run", "sign").agg(
        F.min("unrolled").alias("a"), F.max("unrolled").alias("b"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n"), F.first("lap_len").alias("lap_len"),
        ends(F.min_by, "s").alias("entry_s"), ends(F.max_by, "s").alias("exit_s"), ends(F.min_by, "heading").alias("_h0"), ends(F.max_by, "heading").alias("_h1"),
    )
    found = found.withColumn("_turned", angle_difference(F.col("_h0"), F.col("_h1"))).where((F.col("_turned") >= math.radians(config.min_corner_deg)) & (F.col("size") * STEP >= 4))
    circles = fit_circle(points, ("ride_id", "run"), "x", "y").where("n >= 4").select("ride_id", "run", F.col("radius").alias("_radius"))
    # the apex is the slowest point, up to eight metres beyond the corner
    wide = found.select("ride_id", "run", "n", F.explode(F.sequence(F.col("a") - int(8 / STEP), F.col("b") + int(8 / STEP))).alias("_u")).withColumn("j", F.pmod("_u", "n"))
    slow = wide.join(line.select("ride_id", "j", "s", "v", "lat", "lon"), ["ride_id", "j"]).groupBy("ride_id", "run").agg(F.min(F.struct("v", "_u", "s", "lat", "lon")).alias("m"))
    t = found.join(circles, ["ride_id", "run"], "left").join(slow, ["ride_id", "run"])
    length = F.col("size") * F.lit(STEP)
    degrees = F.degrees("_turned")
    return t.select(
        "ride_id", "entry_s", "exit_s", F.col("m.s").alias("apex_s"), "m.lat", "m.lon", (F.col("m.s") / F.col("lap_len")).alias("lap_offset"), degrees.alias("turned"),
        F.when(F.col("sign") > 0, "right").otherwise("left").alias("dir"), F.coalesce(F.when(F.col("_radius") < 400, F.col("_radius")), length / F.col("_turned")).alias("radius"),
        length.alias("length_m"), corner_kind(degrees).alias("type"), F.col("m.v").alias("mean_apex_v"), F.lit("mean-lap").alias("source"), "lap_len",
    )


def number_from_start(turns: DataFrame, grid: DataFrame) -> DataFrame:
    """turns with ``number, name, first_seen``: in the order in which the ride first passes within 30 m of them;
    in the order along the lap for rides that never pass near one of them."""
    origin = grid.where("i = 0").select("ride_id", (F.lit(DEGREE_M) * F.cos(F.radians(F.coalesce("lat", F.lit(0.0))))).alias("_per_lon"))
    flat = lambda df: df.join(origin, "ride_id").withColumns({"x": F.col("lon") * F.col("_per_lon"), "y": F.col("lat") * DEGREE_M})
    keyed = turns.withColumn("_turn", F.struct("lat", "lon"))
    near = within_radius(flat(grid.where(F.col("moving") & located())).select("ride_id", "i", "x", "y"), flat(keyed).select("ride_id", "_turn", "x", "y"), ("ride_id",), "x", "y", 30.0)
    seen = near.groupBy("ride_id", "_turn").agg(F.min("i").alias("first_seen"))
    joined = keyed.join(seen, ["ride_id", "_turn"], "left")
    all_seen = F.count("first_seen").over(Window.partitionBy("ride_id")) == F.count(F.lit(1)).over(Window.partitionBy("ride_id"))
    joined = joined.withColumn("_key", F.when(all_seen, F.col("first_seen").cast("double")).otherwise(F.col("lap_offset")))
    number = F.row_number().over(Window.partitionBy("ride_id").orderBy("_key", "lap_offset")).cast("long")
    return joined.withColumn("number", number).withColumn("name", F.concat(F.lit("Turn "), F.col("number").cast("string"))).drop("_turn", "_key")


def _passes(turns: DataFrame, grid: DataFrame, laps: DataFrame) -> DataFrame:
    """Where each lap passes each corner: the first second at or beyond its share of the lap."""
    samples = lap_samples(grid.select("ride_id", "i", "dist", "v"), laps.where("source <> 'none'"))
    lengths = lap_lengths(samples).where("len > 0")
    w = Window.partitionBy("ride_id", "lap").orderBy("i")
    reached = samples.select("ride_id", "lap", "i", F.coalesce(F.lag("dist").over(w), F.col("dist")).alias("_from"), F.col("dist").alias("_to"))
    share = lambda c: F.pmod(F.col(c) / F.col("lap_len"), F.lit(1.0))
    wanted = turns.select("ride_id", "number", F.explode(F.array(*(F.struct(F.lit(p).alias("part"), share(f"{p}_s").alias("f")) for p in ("entry", "exit", "apex")))).alias("w"))
    wanted = wanted.join(lengths.select("ride_id", "lap", "d0", "len"), "ride_id").select("ride_id", "lap", "number", "w.part", (F.col("d0") + F.col("w.f") * F.col("len")).alias("_target"))
    at = interval_join(wanted, reached, ("ride_id", "lap"), F.col("_target"), "_from", "_to", 64.0)
    at = at.groupBy("ride_id", "lap", "number").agg(*(F.min(F.when(F.col("part") == p, F.col("i"))).alias(f"_{p}") for p in ("entry", "exit", "apex")))
    at = at.join(lengths.select("ride_id", "lap", F.col("i0").alias("_lap0"), F.col("i1").alias("_lap1")), ["ride_id", "lap"])
    exit_at = F.when(F.col("_exit") < F.col("_entry"), F.least(F.col("_lap1"), F.col("_entry") + 2)).otherwise(F.col("_exit"))
    at = at.withColumns({"i1": exit_at, "i0": F.col("_entry"), "_a": F.greatest(F.col("_lap0"), F.col("_apex") - 3), "_b": F.least(F.col("_lap1"), F.col("_apex") + 3)}).where("_apex is not null")
    slow = interval_join(grid.select("ride_id", "i", "v"), at.select("ride_id", "lap", "number", "_a", "_b"), ("ride_id",), F.col("i"), "_a", "_b", 32)
    apex = slow.groupBy("ride_id", "lap", "number").agg(F.min_by("i", F.struct("v", "i")).alias("apex"))
    return at.join(apex, ["ride_id", "lap", "number"]).join(turns.select("ride_id", "number", "turned", "dir"), ["ride_id", "number"]).select(*EVENT)


def _track_turns(grid: DataFrame, laps: DataFrame, config: ModelConfig, keep: Keep) -> tuple[DataFrame, DataFrame]:
    """Corners of rides without a mean lap: bends of the raw track, clustered by place in the order they come."""
    k = F.abs("curvature")
    sign = F.when(k > 1 / (config.corner_radius * RAW_SHOULDER), F.signum("curvature")).otherwise(0.0)
    df = grid.where("lat is not null").withColumns({"_sign": sign, "_seed": (k >= 1 / config.corner_radius) & F.col("moving") & (F.col("i") > 0)})
    run = F.sum(F.coalesce(F.col("_sign") != F.lag("_sign").over(RIDE.window), F.lit(False)).cast("long")).over(RIDE.so_far)
    bends = df.withColumn("run", run).where("_sign <> 0").groupBy("ride_id", "run").agg(
        F.first("_sign").alias("_sign"), F.max("_seed").alias("_seeded"), F.min("i").alias("i0"), F.max("i").alias("i1"),
        F.min_by("heading", "i").alias("_h0"), F.max_by("heading", "i").alias("_h1"), (F.max("dist") - F.min("dist")).alias("_len"),
    )
    bends = bends.withColumn("turned", angle_difference(F.col("_h0"), F.col("_h1"))).where((F.col("turned") >= math.radians(config.min_corner_deg)) & (F.col("_len") > 4) & F.col("_seeded"))
    bends = bends.select("ride_id", "i0", "i1", F.degrees("turned").alias("turned"), "_len", F.when(F.col("_sign") > 0, "right").otherwise("left").alias("dir"), (F.col("i0") - 2).alias("_a"), (F.col("i1") + 2).alias("_b"))
    inside = interval_join(grid.select("ride_id", "i", "v", "lat", "lon", "dist"), bends, ("ride_id",), F.col("i"), "_a", "_b", 32)
    event = inside.groupBy("ride_id", "i0", "i1", "turned", "dir", "_len").agg(F.min(F.struct("v", F.col("i").alias("apex"), "lat", "lon", "dist")).alias("m")).select("*", "m.apex", "m.lat", "m.lon", "m.dist").drop("m")

    def start() -> Step:
        middles: list[list[float]] = []  # latitude, longitude, passes

        def step(columns: dict[str, list]) -> dict[str, list]:
            out = []
            for lat, lon in zip(columns["lat"], columns["lon"]):
                per_lon = DEGREE_M * math.cos(math.radians(middles[0][0] if middles else lat))
                at = next((n for n, m in enumerate(middles) if math.hypot((lon - m[1]) * per_lon, (lat - m[0]) * DEGREE_M) < config.turn_cluster_m), len(middles))
                if at == len(middles):
                    middles.append([lat, lon, 0])
                m = middles[at]
                m[2] += 1
                m[0] += (lat - m[0]) / m[2]
                m[1] += (lon - m[1]) / m[2]
                out.append(at)
            return {"cluster": out}

        return step

    event = keep(fold_sorted(event, Series(("ride_id",), ("i0",)), ["lat", "lon"], "cluster long", start), "bends")
    whole = Window.partitionBy("ride_id", "cluster")
    event = event.withColumn("_n", F.count(F.lit(1)).over(whole)).where("_n >= 2")
    spans = lap_lengths(lap_samples(grid.select("ride_id", "i", "dist"), laps))
    typical = spans.groupBy("ride_id").agg(F.percentile("len", F.lit(0.5)).alias("lap_len"))
    in_lap = interval_join(event, spans.select("ride_id", "lap", "d0", F.col("i0").alias("_l0"), F.col("i1").alias("_l1")), ("ride_id",), F.col("apex"), "_l0", "_l1", 256, how="left")
    event = in_lap.groupBy(*event.columns).agg(F.min("lap").alias("lap"), F.min_by("d0", "lap").alias("d0")).join(typical, "ride_id", "left")
    offset = F.coalesce((F.col("dist") - F.col("d0")) / F.nullif(F.col("lap_len"), F.lit(0.0)), F.col("dist"))
    event = keep(event, "placed_bends")
    event = event.withColumns({"_offset": offset, "_radius": F.col("_len") / F.radians("turned")})
    turns = event.groupBy("ride_id", "cluster").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.min_by("_offset", "i0").alias("lap_offset"), F.percentile("turned", F.lit(0.5)).alias("turned"), F.min_by("dir", "i0").alias("dir"), F.percentile("_radius", F.lit(0.5)).alias("radius"))
    nothing = F.lit(None).cast("double")
    turns = turns.withColumns({**{c: nothing for c in ("entry_s", "exit_s", "apex_s", "length_m", "mean_apex_v")}, "type": corner_kind(F.col("turned")), "source": F.lit("track")})
    turns = number_from_start(turns, grid)
    named = event.join(turns.select("ride_id", "cluster", "number"), ["ride_id", "cluster"])
    return turns.select(*TURN), named.select(*EVENT)


def detect_turns(grid: DataFrame, laps: DataFrame, line: DataFrame, config: ModelConfig = ModelConfig(), keep: Keep = lambda df, name: df) -> tuple[DataFrame, DataFrame]:
    """Corners, and where each lap passes them; from mean laps, and from the raw track for rides that these give none."""
    turns = keep(number_from_start(keep(_corners(line, config), "corners"), grid), "numbered")
    events = keep(_passes(turns, grid, laps), "passes")
    often = events.groupBy("ride_id", "number").count().where("count >= 2").select("ride_id", "number")
    turns, events = (df.join(often, ["ride_id", "number"], "left_semi") for df in (turns, events))
    rest = grid.join(turns.select("ride_id").distinct(), "ride_id", "left_anti")
    raw_turns, raw_events = _track_turns(rest, laps.join(rest.select("ride_id").distinct(), "ride_id", "left_semi"), config, keep)
    return turns.select(*TURN).unionByName(raw_turns), events.unionByName(raw_events)


def price_passes(events: DataFrame, series: DataFrame) -> DataFrame:
    """turn_events: speed lost in each pass and what it took to get it back."""
    key = ["ride_id", "number", "lap", "i0", "i1", "apex", "turned", "dir"]
    spans = events.withColumns({"_a": F.least("i0", F.col("apex") - BACK), "_b": F.greatest("i1", F.col("apex") + RECOVER)})
    s = interval_join(series.select("ride_id", "i", "v", "watts", "cad", "ratio", "dist", "cp"), spans, ("ride_id",), F.col("i"), "_a", "_b", 64)
    whole = Window.partitionBy(*key)
    i, apex = F.col("i"), F.col("apex")
    s = s.withColumn("entry_v", F.coalesce(F.max(F.when((i >= apex - BACK) & (i < apex), F.col("v"))).over(whole), F.lit(0.0)))
    s = s.withColumn("_regained", F.min(F.when((i > apex) & (i <= apex + RECOVER) & (F.col("v") >= REGAINED * F.col("entry_v")), i)).over(whole))
    s = s.withColumn("_end", F.coalesce("_regained", F.least(F.max("i").over(whole), apex + RECOVER)))
    leaving, passing = (i >= apex) & (i <= F.col("_end")), (i >= F.col("i0")) & (i <= F.col("i1"))
    pedals = passing & (F.col("cad") > PEDALLING)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    e = s.groupBy(*key).agg(
        F.first("entry_v").alias("entry_v"), F.max(F.when(i == apex, F.col("v"))).alias("apex_v"), (F.first("_regained") - apex).cast("double").alias("recover_s"),
        (F.sum(F.when(leaving, F.greatest(F.col("watts") - F.col("cp"), F.lit(0.0)))) / 1000).alias("exit_kj"), F.max(F.when(leaving, F.col("watts"))).alias("exit_peak"),
        F.avg(F.when((i >= apex - BACK) & (i <= apex), F.col("ratio"))).alias("ratio_in"), F.avg(F.when(leaving, F.col("ratio"))).alias("ratio_out"),
        F.when(F.count("cad") > 0, F.coalesce(F.avg(F.when(pedals, F.col("cad"))), F.lit(0.0))).alias("cadence"),
        F.when(F.count("cad") > 0, 1 - F.try_divide(count(pedals), count(passing))).alias("coast_frac"),
        (F.max(F.when(passing, F.col("dist"))) - F.min(F.when(passing, F.col("dist")))).alias("_len"),
    )
    return e.withColumn("loss_v", F.col("entry_v") - F.col("apex_v")).withColumn("radius", F.try_divide(F.col("_len"), F.radians("turned"))).drop("_len")


def price_turns(turns: DataFrame, passes: DataFrame) -> DataFrame:
    """turns with the means, totals and spread of their passes."""
    mean = lambda c: F.avg(c).alias(c)
    rolled = passes.groupBy("ride_id", "number").agg(
        F.count(F.lit(1)).alias("passes"), *map(mean, ("entry_v", "apex_v", "loss_v", "exit_kj", "exit_peak", "recover_s", "ratio_out", "cadence", "coast_frac")),
        F.sum("exit_kj").alias("exit_kj_total"), spread(F.col("loss_v")).alias("loss_sd"),
    )
    return turns.join(rolled, ["ride_id", "number"])
