import math
import random
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadenza.operators import aggregates, folds, islands, joins, series
from cadenza.operators.resample import crop, marker_indices, resample, too_short_or_long
from cadenza.operators.series import Series
from cadenza.plans.mean_lap import stacked
from cadenza.queries import QUERIES

S = Series(("k",), ("i",))


def frame(spark, values, key="a"):
    return spark.createDataFrame([(key, i, float(v) if v is not None else None) for i, v in enumerate(values)], "k string, i long, x double")


def test_centred_mean_counts_undefined_as_zero(spark):
    rows = frame(spark, [3, None, 6, 9]).select("i", series.centred_mean(F.col("x"), S, 3).alias("m")).orderBy("i").collect()
    assert [r["m"] for r in rows] == pytest.approx([1.5, 3, 5, 7.5])


def test_derivative_is_zero_where_x_stands_still(spark):
    df = spark.createDataFrame([("a", 0, 1.0, 0.0), ("a", 1, 2.0, 0.0)], "k string, i long, y double, x double")
    assert {r["d"] for r in df.select(series.central_derivative(F.col("y"), F.col("x"), S).alias("d")).collect()} == {0.0}


@pytest.mark.parametrize(("slope", "step"), [(0.04, 12.0), (0.0, 12.0), (0.04, 1.0)])
def test_range_slope_recovers_gradients(spark, slope, step):
    rng = random.Random(5)
    rows = [("a", i, i * step, i * step * slope + rng.uniform(-0.05, 0.05)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i long, d double, h double")
    out = series.range_slope(df, S, "h", "d", 30, 9, 0.25, "s").where("i between 10 and 190").select("s").collect()
    assert all(abs(r["s"] - slope) < 0.02 for r in out)


def test_power_mean_of_constant_and_short(spark):
    df = frame(spark, [250] * 60).union(frame(spark, [100, 200], "b"))
    out = {r["k"]: r["np"] for r in series.power_mean(df, S, "x").collect()}
    assert out["a"] == pytest.approx(250) and out["b"] == pytest.approx(150)


def test_reserve(spark):
    df = frame(spark, [500] * 600).withColumns({"cp": F.lit(300.0), "w": F.lit(20000.0)})
    stats = folds.reserve_stats(folds.reserve_balance(df, S, "x", "cp", "w"), S).first()
    assert stats["overdraft"] == pytest.approx(100_000)
    assert stats["depleted"] and abs(stats["depleted_seconds"] - 501) <= 1 and stats["min_at"] == 99
    rest = frame(spark, [500] * 50 + [100] * 3000).withColumns({"cp": F.lit(300.0), "w": F.lit(20000.0)})
    last = folds.reserve_balance(rest, S, "x", "cp", "w").orderBy(F.col("i").desc()).first()
    assert 19_000 < last["balance"] <= 20_000


def test_spacing_is_from_the_last_kept(spark):
    df = frame(spark, [0, 300, 450, 800, 900])
    kept = folds.spacing_filter(df, S, "x", 400).orderBy("i").collect()
    assert [r["x"] for r in kept] == [0, 450, 900]


def test_resample_leaves_holes(spark):
    t = [*range(200), *range(240, 400)]
    rows = [("a", i, float(x), 11.0, 240.0, 11.0 * x) for i, x in enumerate(t)]
    df = spark.createDataFrame(rows, "k string, seq long, t double, v double, w double, d double")
    grid = resample(df, ("k",), "t", hold=["d"], zero=["v", "w"], tie="seq").orderBy("i").collect()
    gaps = [r for r in grid if r["gap"]]
    assert len(grid) == 400 and 35 <= len(gaps) <= 45
    assert all(r["w"] == 0 and r["v"] == 0 and r["d"] == 11.0 * 199 for r in gaps)
    assert gaps[0]["i"] == 199


def test_resample_fills_unknown(spark):
    rows = [("a", 0, 0.0, None, 0.0), ("a", 1, 1.0, 4.0, 45.0), ("a", 2, 3.0, None, 0.0), ("a", 3, 4.0, None, None)]
    df = spark.createDataFrame(rows, "k string, seq long, t double, x double, lat double")
    grid = resample(df, ("k",), "t", zero=["x"], places=["lat"], tie="seq").orderBy("i").collect()
    assert [r["x"] for r in grid] == [4, 4, 4, 4, 4]
    assert [r["lat"] for r in grid] == [45, 45, 45, 45, 45]


def test_crop_and_limits(spark):
    df = spark.createDataFrame([("a", float(i), 3.0, 15.0) for i in range(30)] + [("b", float(i), 3.0, 5.0) for i in range(30)] + [("c", float(i), None, None) for i in range(3)], "k string, t double, s double, e double")
    counts = {r["k"]: r["count"] for r in crop(df, ("k",), "t", F.col("s"), F.col("e"), 10).groupBy("k").count().collect()}
    assert counts == {"a": 13, "b": 30, "c": 3}
    assert [(r["k"], r["reason"]) for r in too_short_or_long(df, ("k",), "t", 10, 1000).collect()] == [("c", "too few samples")]
    marks = spark.range(1).select(marker_indices(F.array(*map(F.lit, (10.0, 20.4, 20.0, 99.0))), F.lit(0.0), F.lit(50)).alias("m")).first()["m"]
    assert marks == [0, 10, 20, 49]


def test_islands(spark):
    df = frame(spark, [0, 5, 5, 5, 0, 0, 5, 5, 0, 5])
    runs = islands.runs(df, S, F.col("x") > 1, least=2).orderBy("i0").collect()
    assert [(r["i0"], r["i1"], r["size"]) for r in runs] == [(1, 3, 3), (6, 7, 2)]
    merged = islands.merge_regions(islands.runs(df, S, F.col("x") > 1), ("k",), 2).orderBy("i0").collect()
    assert [(r["i0"], r["i1"]) for r in merged] == [(1, 3), (6, 9)]


def test_closed_runs_join_both_ends(spark):
    df = frame(spark, [1, 1, 0, -1, -1, 0, 1])
    runs = islands.closed_runs(df, S, F.signum("x"), F.abs("x") >= 1).groupBy("run", "sign").agg(F.min("unrolled").alias("a"), F.max("unrolled").alias("b")).collect()
    assert {(r["sign"], r["a"], r["b"]) for r in runs} == {(1.0, -1, 1), (-1.0, 3, 4)}


def test_interval_join_is_inclusive_at_both_ends(spark):
    points = frame(spark, range(11))
    spans = spark.createDataFrame([("a", 0, 5), ("a", 5, 10), ("b", 0, 10)], "k string, s long, e long")
    out = joins.interval_join(points, spans, ("k",), F.col("i"), "s", "e", 3).groupBy("i").count().collect()
    assert {r["i"]: r["count"] for r in out} == {i: 2 if i == 5 else 1 for i in range(11)}


def test_within_radius_against_all_pairs(spark):
    rng = random.Random(1)
    a = [("g", i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(60)]
    b = [("g", i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(60)]
    out = joins.within_radius(spark.createDataFrame(a, "k string, p long, x double, y double"), spark.createDataFrame(b, "k string, q long, x double, y double"), ("k",), "x", "y", 12.0)
    want = {(p, q) for _, p, x, y in a for _, q, u, v in b if math.hypot(x - u, y - v) < 12}
    assert {(r["p"], r["q"]) for r in out.collect()} == want


def test_two_medians_and_two_p75s(spark):
    df = frame(spark, [1, 2, 3, 4])
    assert aggregates.pick_ranked(df, ("k",), "x", 0.5, "m").first()["m"] == 3
    assert df.agg(aggregates.percentile(F.col("x"), 0.5).alias("m")).first()["m"] == 2.5
    assert aggregates.pick_ranked(df, ("k",), "x", 0.75, "m").first()["m"] == 4
    assert df.agg(aggregates.percentile(F.col("x"), 0.75).alias("m")).first()["m"] == 3.25


def test_circle(spark):
    rows = [("a", 5 + 3 * math.cos(t / 10), 2 + 3 * math.sin(t / 10)) for t in range(20)] + [("b", float(t), 2.0 * t) for t in range(5)]
    out = {r["k"]: r for r in aggregates.fit_circle(spark.createDataFrame(rows, "k string, x double, y double"), ("k",), "x", "y").collect()}
    assert (out["a"]["cx"], out["a"]["cy"], out["a"]["radius"]) == pytest.approx((5, 2, 3))
    assert out["b"]["radius"] is None


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "k string, i long, x double")
    assert series.power_mean(empty, S, "x").count() == 0
    assert islands.runs(empty, S, F.col("x") > 1).count() == 0
    assert folds.spacing_filter(empty, S, "x", 1.0).count() == 0


def test_means_do_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(4)
    series_of = {k: [round(rng.uniform(0, 500), 2) for _ in range(32)] for k in range(60)} | {100: [1e300, -1e300, 5.0], 101: [None, 1.5], 102: [None], 103: [float("nan"), 1.0], 104: [1 / 3] * 7}
    rows = [(k, v) for k, values in series_of.items() for v in values]
    want = {k: float(sum(map(Decimal, map(str, v))) / 32) for k, v in series_of.items() if k < 60}
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "k long, x double").repartition(5)
        got = {r["k"]: r["m"] for r in df.groupBy("k").agg(aggregates.steady_mean(F.col("x")).alias("m")).collect()}
        assert {k: got[k] for k in want} == want
        assert got[100] in (5 / 3, 0.0) and got[101] == 1.5 and got[102] is None and math.isnan(got[103]) and got[104] == pytest.approx(1 / 3, abs=1e-15)


def test_sectors_and_surges_round_exact_means(spark, tmp_path):
    """Means of 32 values that end in half a millionth: each rounds up, in whatever order the rows lie."""
    rng, rows, cells, surges = random.Random(9), [], {}, {}
    add = lambda user, kind, value: rows.append((len(rows), user, kind, value))
    mean = lambda values: float((sum(map(Decimal, map(str, values))) / 32).quantize(Decimal("1e-6"), ROUND_HALF_UP))
    for user in range(40):
        for kind in ("click", "view", "error"):
            cells[user, kind] = mean(values := [round(rng.uniform(0, 500), 2) for _ in range(32)])
            for v in values:
                add(user, kind, v)
    for user in range(100, 160):
        effort = [5.0, *(round(rng.uniform(200, 500), 2) for _ in range(30)), 5.0]
        surges[str(user)] = mean(effort)
        for v in [*[5.0] * 10, *effort, *[5.0] * 10]:
            add(user, "view", v)
    for order in (1, -1):
        (folder := tmp_path / f"sf{order}").mkdir()
        frame = pd.DataFrame(rows, columns=["event_id", "user_id", "event_type", "value"])[::order]
        frame.assign(ts=(pd.Timestamp("2024-01-01") + pd.to_timedelta(frame["event_id"], "s")).astype("datetime64[us]"), props="").to_parquet(folder / "events.parquet", index=False)
        found = {(r["user_id"], r["event_type"]): r["ratio"] for r in QUERIES["sector_grid"](spark, str(folder)).where("user_id < 100").collect()}
        assert found == cells
        assert {r["ride_id"]: r["avg"] for r in QUERIES["surge_report"](spark, str(folder)).where("ride_id >= 100").collect()} == surges


def test_median_of_lists_is_the_percentile(spark):
    rng = random.Random(6)
    rows = [(k, rng.choice((None, 1.0, rng.uniform(-9, 9)))) for k in range(300) for _ in range(k % 7)] + [(300, float("nan")), (300, 2.0), (300, 1.0), (301, float("inf")), (301, 1.0)]
    df = spark.createDataFrame(rows, "k long, x double")
    both = df.groupBy("k").agg(aggregates.gathered_median(F.col("x")).alias("a"), F.percentile("x", F.lit(0.5)).alias("b"))
    assert both.where("not (a <=> b)").count() == 0 and both.count() > 250
    # of places on a line there are very many
    assert "percentile(" not in stacked(df.withColumn("j", F.col("k")), ("k",), "j", ["x"], 3)._jdf.queryExecution().optimizedPlan().toString()
