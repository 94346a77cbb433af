"""Laps of a circuit: from a line the rider placed, from device markers, or from repeated passes of a place."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.config import ModelConfig
from cadenza.functions.geo import DEGREE_M
from cadenza.functions.scalars import angle_delta, let
from cadenza.operators.joins import interval_join
from cadenza.operators.series import RIDE
from cadenza.plans.staging import Staging

Keep = Callable[[DataFrame, str], DataFrame]

LAPS = "ride_id string, lap long, i0 long, i1 long, source string"
#: Bearings at a crossing agree within 70 degrees; lap lengths scatter by up to 0.22 of the median.
SAME_WAY, SCATTER, MARKER_SCATTER = 1.22, 0.22, 0.15


def tracks(grid: DataFrame, config: ModelConfig) -> DataFrame:
    """What the search needs of each second with a place: the cell that it lies in, as wide as ``lap_radius`` at the ride's farthest
    latitude, and its ``rank`` if it may be a lap's line: every third second from the first one ridden to 60 % of the ride."""
    known = (F.coalesce("lat", F.lit(0.0)) != 0) | (F.coalesce("lon", F.lit(0.0)) != 0)
    rows = grid.select("ride_id", "i", F.coalesce("lat", F.lit(0.0)).alias("lat"), F.coalesce("lon", F.lit(0.0)).alias("lon"), "heading", "dist", known.alias("known"), (known & F.col("moving")).alias("riding"))
    high = config.lap_radius / DEGREE_M
    least_cos = F.greatest(F.min(F.when(F.col("known"), F.cos(F.radians("lat")))).over(RIDE.whole), F.lit(1e-6))
    first = F.min(F.when(F.col("riding"), F.col("i"))).over(RIDE.whole)
    rows = rows.withColumns({"_since": F.col("i") - first, "_end": F.min("i").over(RIDE.whole) + F.floor(F.count(F.lit(1)).over(RIDE.whole) * 0.6), "_cos": least_cos})
    rank = F.when(F.col("riding") & (F.col("_since") % 3 == 0) & (F.col("i") < F.col("_end")), F.floor(F.col("_since") / 3))
    rows = rows.withColumns({"rank": rank, "cy": F.floor(F.col("lat") / high), "cx": F.floor(F.col("lon") * F.col("_cos") / high)})
    return rows.where("known").drop("known", "_since", "_end", "_cos")


def passes(rows: DataFrame, anchors: DataFrame, config: ModelConfig) -> DataFrame:
    """``ride_id, anchor, i, dist`` of each pass of an anchor (a row of the tracks), its nearest second: within ``lap_radius`` and the same way.

    An equality join on cells; an anchor looks into nine of them.
    """
    around = F.explode(F.array(*(F.struct((F.col("cy") + y).alias("cy"), (F.col("cx") + x).alias("cx")) for y in (-1, 0, 1) for x in (-1, 0, 1))))
    seeking = anchors.withColumn("c", around).select("ride_id", F.col("i").alias("anchor"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), F.col("heading").alias("a_heading"), "c.cy", "c.cx")
    per_lon = F.lit(DEGREE_M) * F.cos(F.radians("a_lat"))
    away = F.hypot((F.col("lon") - F.col("a_lon")) * per_lon, (F.col("lat") - F.col("a_lat")) * DEGREE_M)
    turn = F.abs(angle_delta(F.col("a_heading"), F.col("heading")))
    close = rows.select("ride_id", "i", "lat", "lon", "heading", "dist", "cy", "cx").join(seeking, ["ride_id", "cy", "cx"]).withColumn("away", away).where((F.col("away") < config.lap_radius) & (turn < SAME_WAY))
    by = Window.partitionBy("ride_id", "anchor")
    close = close.withColumn("run", F.col("i") - F.row_number().over(by.orderBy("i")))
    return close.groupBy("ride_id", "anchor", "run").agg(F.min_by(F.struct("i", "dist"), F.struct("away", "i")).alias("p")).select("ride_id", "anchor", "p.i", "p.dist")


def anchor_laps(found: DataFrame, config: ModelConfig) -> DataFrame:
    """``ride_id, anchor, laps`` (pairs of seconds) of the anchors whose passes describe a circuit.

    Passes nearer than a shortest lap to the last one taken are left out; three or more must be left, at distances that scatter little.
    """
    marks = F.sort_array(F.collect_list(F.struct("i", "dist")))

    # the passes of one anchor: at most a few thousand
    def spaced(every: Column) -> Column:
        return F.aggregate(
            F.slice(every, 2, F.size(every)), F.slice(every, 1, 1),
            lambda kept, x: F.when(x["dist"] - F.element_at(kept, -1)["dist"] > config.min_lap_metres, F.concat(kept, F.array(x))).otherwise(kept),
        )

    def pairs(marks: Column) -> Column:
        n = F.size(marks) - 1
        return F.zip_with(F.slice(marks, 1, n), F.slice(marks, 2, n), lambda a, b: F.struct(a["i"].alias("i0"), b["i"].alias("i1"), (b["dist"] - a["dist"]).alias("len")))

    def middle(x: Column) -> Column:
        return (F.get(x, F.floor((F.size(x) - 1) / 2).cast("int")) + F.get(x, F.floor(F.size(x) / 2).cast("int"))) / 2

    def regular(pairs: Column) -> Column:
        return let(F.sort_array(F.transform(pairs, lambda p: p["len"])), lambda sizes: let(middle(sizes), lambda mid: F.when((mid > 0) & (scatter(sizes, mid) <= SCATTER), F.filter(pairs, lambda p: (p["len"] > 0.7 * mid) & (p["len"] < 1.4 * mid)))))

    def scatter(sizes: Column, mid: Column) -> Column:
        return F.sqrt(F.aggregate(sizes, F.lit(0.0), lambda s, d: s + F.pow(d - mid, F.lit(2.0))) / F.size(sizes)) / mid

    good = let(marks, lambda every: let(spaced(every), lambda kept: F.when(F.size(kept) >= 3, let(pairs(kept), regular))))
    # within the aggregation: as columns of their own, filters and lambdas would have each step again for each use of it
    return found.groupBy("ride_id", "anchor").agg(good.alias("laps")).where(F.size("laps") >= 2)


#: Candidates that the first round tries, and how many times more each later one does.
FIRST_ROUND, MORE = 8, 8


def _numbered(laps: DataFrame, source: str) -> DataFrame:
    out = laps.select("ride_id", F.posexplode("laps").alias("at", "p"))
    return out.select("ride_id", (F.col("at") + 1).cast("long").alias("lap"), F.col("p.i0").alias("i0"), F.col("p.i1").alias("i1"), F.lit(source).alias("source"))


def placed_laps(grid: DataFrame, config: ModelConfig, within: float = 120.0) -> DataFrame:
    """Laps from the second ridden nearest to the place (``anchor_lat``, ``anchor_lon``) that the rider set, if it is near."""
    rows = tracks(grid, config)
    line = grid.groupBy("ride_id").agg(F.first("anchor_lat").alias("_la"), F.first("anchor_lon").alias("_lo"))
    away = F.hypot((F.col("lon") - F.col("_lo")) * F.lit(DEGREE_M) * F.cos(F.radians("_la")), (F.col("lat") - F.col("_la")) * DEGREE_M)
    near = rows.where("riding").join(line, "ride_id").withColumn("_away", away).where(F.col("_away") < within)
    anchors = near.groupBy("ride_id").agg(F.min_by(F.struct(*(c for c in rows.columns if c != "ride_id")), F.struct("_away", "i")).alias("a")).select("ride_id", "a.*")
    return _numbered(anchor_laps(passes(rows, anchors, config), config), "manual")


def searched_laps(grid: DataFrame, config: ModelConfig, keep: Keep | None = None) -> DataFrame:
    """Laps from the earliest place of each ride that it passes again and again.

    Rides are settled in rounds: the first tries a few candidates of each ride, later ones ever more of what is left, so
    most candidates of rides with a circuit are never joined, and there are as many rounds as the candidates have digits.
    """
    keep = keep or Staging(grid.sparkSession).put
    rows = keep(tracks(grid, config), f"tracks-{uuid.uuid4().hex}")
    done: list[DataFrame] = []
    low, high = 0, FIRST_ROUND
    while True:
        left = rows.where(F.col("rank") >= low)
        for d in done:
            left = left.join(d.select("ride_id"), "ride_id", "left_anti")
        if not left.head(1):
            break
        best = anchor_laps(passes(rows, left.where(F.col("rank") < high), config), config).groupBy("ride_id").agg(F.min_by("laps", "anchor").alias("laps"))
        done.append(keep(best, f"round-{low}-{uuid.uuid4().hex}"))
        low, high = high, high * MORE
    if not done:
        return grid.sparkSession.createDataFrame([], LAPS)
    return reduce(DataFrame.unionByName, (_numbered(d, "gps") for d in done))


def marker_laps(marks: DataFrame, grid: DataFrame, seconds: int = 20, metres: float = 300.0, scatter: float = MARKER_SCATTER) -> DataFrame:
    """Laps between device markers of rides whose markers describe a circuit: markers more than ``seconds`` apart, three
    laps or more of a median length above ``metres`` that scatter by no more than ``scatter`` of it; odd ones are left out."""
    pairs = marks.where("marks is not null").select("ride_id", F.posexplode(F.arrays_zip(F.slice("marks", 1, F.size("marks") - 1).alias("i0"), F.slice("marks", 2, F.size("marks") - 1).alias("i1"))).alias("at", "p"))
    pairs = pairs.select("ride_id", F.col("p.i0").alias("i0"), F.col("p.i1").alias("i1")).where(F.col("i1") - F.col("i0") > seconds)
    at = lambda side: grid.select("ride_id", F.col("i").alias(side), F.col("dist").alias(f"d_{side}"))
    sized = pairs.join(at("i0"), ["ride_id", "i0"]).join(at("i1"), ["ride_id", "i1"]).withColumn("len", F.col("d_i1") - F.col("d_i0"))
    whole = Window.partitionBy("ride_id")
    sized = sized.withColumn("mid", F.percentile("len", F.lit(0.5)).over(whole)).withColumn("n", F.count(F.lit(1)).over(whole))
    sized = sized.withColumn("cv", F.sqrt(F.avg(F.pow(F.col("len") - F.col("mid"), 2)).over(whole)) / F.nullif(F.col("mid"), F.lit(0.0)))
    good = sized.where((F.col("n") >= 3) & (F.col("mid") > metres) & (F.col("cv") <= scatter) & (F.col("len") > 0.75 * F.col("mid")) & (F.col("len") < 1.35 * F.col("mid")))
    return good.select("ride_id", F.row_number().over(whole.orderBy("i0")).cast("long").alias("lap"), "i0", "i1", F.lit("device").alias("source"))


def detect_laps(grid: DataFrame, rides: DataFrame, marks: DataFrame | None, config: ModelConfig = ModelConfig(), keep: Keep | None = None) -> DataFrame:
    """``ride_id, lap, i0, i1, source`` of every ride; one lap of source ``none`` where there is no circuit.

    ``marks`` may be None where no ride has any. Laps share their boundary seconds. Odd laps are left out before numbering.
    """
    keep = keep or Staging(grid.sparkSession).put
    with_place = grid.where("lat is not null")
    given = grid.sparkSession.createDataFrame([], LAPS) if marks is None else marker_laps(marks, grid).join(with_place.select("ride_id").distinct(), "ride_id", "left_semi")
    anchors = rides.select("ride_id", "anchor_lat", "anchor_lon").where("anchor_lat is not null")
    if anchors.head(1):
        manual = keep(placed_laps(with_place.join(anchors, "ride_id"), config), f"placed-{uuid.uuid4().hex}")
        given = manual.unionByName(_without(given, manual))
    if marks is not None:
        given = keep(given, f"given-{uuid.uuid4().hex}")
    found = given.unionByName(searched_laps(_without(with_place, given), config, keep))
    whole = _without(grid, found).groupBy("ride_id").agg(F.min("i").alias("i0"), F.max("i").alias("i1")).select("ride_id", F.lit(1).cast("long").alias("lap"), "i0", "i1", F.lit("none").alias("source"))
    return found.unionByName(whole)


def _without(df: DataFrame, *done: DataFrame) -> DataFrame:
    for d in done:
        df = df.join(d.select("ride_id").distinct(), "ride_id", "left_anti")
    return df


def lap_samples(grid: DataFrame, laps: DataFrame) -> DataFrame:
    """Seconds with the laps they belong to; a boundary second belongs to both."""
    return interval_join(grid, laps.select("ride_id", "lap", "i0", "i1", "source"), ("ride_id",), F.col("i"), "i0", "i1", 256)


def lap_lengths(samples: DataFrame) -> DataFrame:
    """``ride_id, lap, i0, i1, source, d0, len`` of laps."""
    return samples.groupBy("ride_id", "lap", "i0", "i1", "source").agg(F.min("dist").alias("d0"), (F.max("dist") - F.min("dist")).alias("len"))
