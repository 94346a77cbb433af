"""Ways that only matter for large keys: ranks, as-of buckets, circuit groups; held against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.config import first_set
from cadenza.operators import joins, ranks, series
from cadenza.operators.folds import spaced
from cadenza.plans import compare
from cadenza.plans.staging import Staging


def test_ranks_of_a_key_that_has_most_rows_and_one_value(spark):
    rng = random.Random(1)
    rows = [("hot", 5.0)] * 3000 + [("hot", rng.random() * 10) for _ in range(500)] + [("few", float(i)) for i in range(7)] + [("one", 2.0), ("one", None), (None, 3.0), (None, 9.0)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(7)
    shares = {"low": 0.05, "mid": 0.5, "top": 1.0}
    got = {r["k"]: r for r in ranks.quantiles(df, ("k",), "x", shares, Staging(spark).put).collect()}
    plain = {r["k"]: r for r in ranks.ranked(df, ("k",), "x", {"mid": 0.5}, Staging(spark).put).collect()}
    for k in ("hot", "few", "one", None):
        x = sorted(v for key, v in rows if key == k and v is not None)
        assert all(got[k][name] == pytest.approx(np.quantile(x, share)) for name, share in shares.items())
        assert plain[k]["mid"] == x[len(x) // 2]
    assert ranks.quantiles(df.limit(0), ("k",), "x", shares, Staging(spark).put).count() == 0


@pytest.mark.parametrize("bucket", [None, lambda t: F.floor(t / 10)])
def test_asof_join_takes_the_last_by_time_and_tie(spark, bucket):
    rng = random.Random(2)
    left = [(i, rng.choice("ab"), float(rng.randrange(100))) for i in range(200)]
    right = [(rng.choice("ab"), float(rng.randrange(0, 100, 7)), i) for i in range(60)]
    a, b = spark.createDataFrame(left, "i long, k string, t double"), spark.createDataFrame(right, "k string, at double, v long")
    got = {r["i"]: r["v"] for r in joins.asof_join(a, b, ("k",), "t", "at", ["v"], tie=("v",), bucket=bucket).collect()}
    want = {i: max(((at, v) for key, at, v in right if key == k and at <= t), default=(None, None))[1] for i, k, t in left}
    assert got == want


def greedy(circuits):
    leaders, out = [], {}
    for name, lat, lon, length in sorted(circuits):
        near = lambda o, lat=lat, lon=lon, length=length: np.hypot((lon - o[2]) * 111_320 * np.cos(np.radians(o[1])), (lat - o[1]) * 111_320) < 250 and abs(o[3] - length) / max(o[3], length) < 0.12
        found = next((o for o in leaders if near(o)), None)
        if found is None:
            found = (name, lat, lon, length)
            leaders.append(found)
        out[name] = found[0]
    return out


def test_circuit_groups_do_not_end_at_region_edges(spark):
    rng = random.Random(3)
    rows = [("a", 45.4999, 7.0, 1000.0), ("b", 45.5001, 7.0, 1010.0)] + [(f"r{i:03}", 45.49 + rng.random() * 0.02, 7 + rng.random() * 0.02, 1000 + 300 * rng.random()) for i in range(120)]
    df = spark.createDataFrame(rows, "ride_id string, lat double, lon double, lap_len double")
    out = compare.circuit_groups(df).collect()
    got = {r["ride_id"]: r["circuit_id"] for r in out}
    assert got == greedy(rows) and got["a"] == got["b"]
    assert [r["races"] for r in out] == sorted((r["races"] for r in out), reverse=True)


def plain_slopes(x, y, half, least, limit):
    """The rule as it is told: edges that walk along, and a far edge that stays."""
    out, lo, hi, n = [], 0, 0, len(x)
    for i in range(n):
        while lo < i and x[i] - x[lo] > half:
            lo += 1
        hi = max(hi, i)
        while hi < n - 1 and x[hi + 1] - x[i] <= half:
            hi += 1
        while hi - lo + 1 < least and (lo > 0 or hi < n - 1):
            lo, hi = max(lo - 1, 0), min(hi + 1, n - 1)
        dx, v = x[lo : hi + 1] - x[i], y[lo : hi + 1]
        spread = len(dx) * (dx @ dx) - dx.sum() ** 2
        out.append(np.clip((len(dx) * (dx @ v) - dx.sum() * v.sum()) / spread, -limit, limit) if len(dx) >= 3 and abs(spread) > 1e-9 else 0.0)
    return np.array(out)


@pytest.mark.parametrize("pace", [0.0, 3.0, 12.0, 40.0])
def test_slopes_follow_the_walking_edges(pace):
    rng = np.random.default_rng(int(pace))
    x = np.cumsum(np.where(rng.random(400) < 0.2, 0.0, pace * rng.random(400)))
    y = np.cumsum(rng.normal(0, 1, 400))
    assert series.slopes(x, y, 30, 9, 0.25) == pytest.approx(plain_slopes(x, y, 30, 9, 0.25), abs=1e-9)


def test_spacing_goes_on_from_the_last_kept():
    assert spaced([0, 3, 5, None, 10, 11], 4) == [True, False, True, False, True, False]
    assert spaced([12, 15], 4, 10.0) == [False, True]


def test_settings_are_finite(spark):
    df = spark.createDataFrame([(float("nan"), float("inf"), 3.0), (0.0, None, float("nan")), (None, None, None)], "a double, b double, c double")
    assert [r[0] for r in df.select(first_set(F.col("a"), F.col("b"), F.col("c"))).collect()] == [3.0, 0.0, 0.0]


def test_corner_matrix_has_every_corner(spark):
    turns = spark.createDataFrame([("x", n, 1.0) for n in range(1, 20)], "ride_id string, number int, loss_v double")
    assert compare.turn_matrix(turns).first()["19"] == pytest.approx(3.6)


def test_rides_of_events_stay_bounded(spark):
    """However many events there are, each ride has as many seconds, far from the longest that are analysed."""
    from cadenza.config import ModelConfig
    from cadenza.queries import rides

    sizes = {}
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        found = rides.rides_of_events(spark, f"/root/testdata/{sf}")[1].groupBy("ride_id").count().collect()
        sizes[sf] = (len(found), max(r["count"] for r in found))
    assert all(longest <= rides.SECONDS < ModelConfig().max_samples for _, longest in sizes.values())
    assert sizes["sf0.1"][0] == 10 * sizes["sf0.01"][0]


def test_rides_on_one_circuit_meet_leaders_only(spark):
    """Ten thousand rides on one circuit: each meets one leader, once to follow and once to join."""
    from cadenza.plans import compare

    df = spark.range(10_000).selectExpr("concat('r', id) ride_id", "45 + (id % 7) / 1e6 lat", "7 + (id % 5) / 1e6 lon", "1000D lap_len")
    met, inner = [], compare._meet
    compare._meet = lambda rides, leaders: (met.append(inner(rides, leaders).count()), inner(rides, leaders))[1]
    try:
        out = compare.circuit_groups(df)
        assert out.select("circuit_id", "races").distinct().collect() == [("r0", 10_000)]
    finally:
        compare._meet = inner
    assert sum(met) == 2 * 9_999


def test_circuits_without_place_or_length_lead_themselves(spark):
    from cadenza.plans import compare

    rows = [("a", None, 7.0, 1000.0), ("b", 45.0, 7.0, None), ("c", 45.0, 7.0, float("nan")), ("d", 45.0, 7.0, 0.0), ("e", 45.0, 7.0, 1000.0), ("f", 45.0, 7.0, 1100.0), ("g", 89.99999, 7.0, 1000.0)]
    df = spark.createDataFrame(rows, "ride_id string, lat double, lon double, lap_len double")
    assert {r["ride_id"]: r["circuit_id"] for r in compare.circuit_groups(df).collect()} == {"a": "a", "b": "b", "c": "c", "d": "d", "e": "e", "f": "e", "g": "g"}
    assert compare.circuit_groups(df.limit(0)).count() == 0
