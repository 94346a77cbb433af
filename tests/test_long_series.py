"""Series in blocks give what the same series give in one piece, and no task has a whole one."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import folds, long_series, series
from cadenza.operators.series import Series
from cadenza.plans.staging import Staging

S = Series(("k",), ("i",))


def rows(spark, n=400, seed=1, pace=lambda rng: rng.choice((0, 1, 1, 40))):
    """A hot key, some short ones and a null one; values with nulls, NaN and infinity."""
    rng = random.Random(seed)
    out = []
    for key, size in (("hot", n), ("a", 1), ("b", 2), ("c", 37), (None, 60)):
        x = 0.0
        for i in range(size):
            x += pace(rng)
            out.append((key, i, x, rng.choice((None, float("nan"), float("inf"), *(rng.gauss(50, 30) for _ in range(9)))), rng.gauss(5, 3)))
    rng.shuffle(out)
    return spark.createDataFrame(out, "k string, i long, x double, v double, y double").withColumns({"cp": F.lit(45.0), "full": F.lit(90.0) + F.when(F.col("k") == "a", 5).otherwise(0)}).repartition(3)


def blocks(spark, df, size):
    return long_series.in_blocks(df, S, Staging(spark).put, size)


def by_row(df, *columns):
    return {(r["k"], r["i"]): tuple(r[c] for c in columns) for r in df.collect()}


@pytest.mark.parametrize("size", (1, 7, 64, 10_000))
def test_frames_and_carries(spark, size):
    df = rows(spark)
    frames = lambda s: {"m": series.centred_mean(F.col("y"), s, 15), "t": series.trailing_mean(F.col("v"), s, 30), "d": series.central_derivative(F.col("y"), F.col("x"), s)}
    got = by_row(long_series.with_frames(blocks(spark, df, size), 29, 7, frames), "m", "t", "d")
    want = by_row(df.withColumns(frames(S)), "m", "t", "d")
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], nan_ok=True) for k in want)
    known = F.when(F.col("v") > 60, F.col("v"))
    out = long_series.carried(blocks(spark, df, size), sums={"s": F.col("y")}, maxima={"h": F.col("y")}, last={"l": known})
    assert set(out.columns) == {*df.columns, "s", "h", "l", "_place"}
    want = by_row(df.withColumns({"s": series.running_sum(F.col("y"), S), "h": series.running_max(F.col("y"), S), "l": series.last_known(known, S), "_place": S.place}), "s", "h", "l", "_place")
    got = by_row(out, "s", "h", "l", "_place")
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], nan_ok=True) for k in want)


@pytest.mark.parametrize("size", (1, 7, 64, 10_000))
def test_reserve(spark, size):
    df = rows(spark)
    got = by_row(long_series.long_reserve(blocks(spark, df, size), "v", "cp", "full"), "balance", "drained", "overdrawn", "tau")
    want = by_row(folds.reserve_balance(df.where("v IS NULL OR NOT isnan(v)"), S, "v", "cp", "full"), "tau")
    plain = by_row(folds.reserve_balance(df, S, "v", "cp", "full"), "balance", "drained", "overdrawn", "tau")
    assert set(got) == set(plain) and len(want) and all(got[k] == pytest.approx(plain[k], abs=1e-9, nan_ok=True) for k in plain)


PACES = {"even": lambda rng: 1.0, "ties": lambda rng: rng.choice((0, 0, 1)), "mixed": lambda rng: rng.choice((0, 1, 1, 40)), "sparse": lambda rng: rng.uniform(5, 30), "standing": lambda rng: 0.0}


@pytest.mark.parametrize("pace", sorted(PACES))
@pytest.mark.parametrize("size", (5, 50))
def test_slopes(spark, pace, size):
    df = rows(spark, pace=PACES[pace])
    got = by_row(long_series.long_slope(blocks(spark, df, size), "y", "x", 12.0, 9, 0.9, "slope"), "slope")
    want = by_row(series.range_slope(df, S, "y", "x", 12.0, 9, 0.9, "slope"), "slope")
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_states_of_fits():
    """From every state that a fit may have reached, the table of states gives what walking gives."""
    rng = np.random.default_rng(3)
    for trial in range(200):
        x = np.cumsum(rng.choice([0, 1, 3, 20], 60).astype(float))
        least, begin = int(rng.integers(1, 12)), int(rng.integers(0, 40))
        end = int(rng.integers(begin + 1, 61))
        table = series.reaches(x, 4.0, least, begin, end)
        for state in range(least + 1):
            assert table[state] == min(max(series._edges(x, 4.0, least, begin, end, begin - 1 + state)[1][-1] - (end - 1), 0), least)


def test_composition_of_clamped_maps():
    rng = np.random.default_rng(5)
    m, c = rng.uniform(0.1, 1, 33), rng.uniform(-20, 20, 33)
    low, high = np.zeros(33), rng.uniform(5, 40, 33)
    whole = long_series.composed(m, c, low, high)
    for b in rng.uniform(-10, 50, 20):
        walked = b
        for k in range(33):
            walked = min(high[k], max(low[k], m[k] * walked + c[k]))
        assert min(whole[3], max(whole[2], whole[0] * b + whole[1])) == pytest.approx(walked)


def test_no_task_has_the_whole_key(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("i"), (F.col("id") * 1.5).alias("x"), (F.col("id") % 90).cast("double").alias("v"), F.lit(45.0).alias("cp"), F.lit(90.0).alias("full"))
    b = blocks(spark, df, 500)
    aqe = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for out in (
            long_series.with_frames(b, 29, 7, lambda s: {"m": series.centred_mean(F.col("v"), s, 15)}),
            long_series.carried(b, sums={"s": F.col("v")}),
            long_series.long_reserve(b, "v", "cp", "full"),
            long_series.long_slope(b, "v", "x", 20.0, 9, 0.5, "slope"),
        ):
            plan = out._jdf.queryExecution().executedPlan().toString()
            sizes = out.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
            assert "_block" in plan and sum(sizes) == 20_000 and max(sizes) < 12_000 and sum(n > 0 for n in sizes) > 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", aqe)


def test_no_rows(spark):
    b = blocks(spark, rows(spark).limit(0), 9)
    assert long_series.long_reserve(b, "v", "cp", "full").count() == 0 and long_series.long_slope(b, "y", "x", 1.0, 3, 1.0, "slope").count() == 0
    assert long_series.carried(b, sums={"s": F.col("y")}).count() == 0
