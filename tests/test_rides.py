"""The report on races whose truth is known. All rides go through one report, as they would at scale."""

import math

import pytest
from pyspark.sql import functions as F

from cadenza.config import ModelConfig
from cadenza.plans import calibrate, compare, prepare, race_window, summary, weather
from cadenza.plans.analyze import analyze, register, settings_of
from cadenza.plans.tables import WEATHER
from cadenza.sources.synthetic import Truth, as_tables, circuit, race

CONFIG = ModelConfig(wind_source="fit", mass=79.5, crr=0.0042)


def padded(rows):
    """Five minutes of warm-up before and four of cool-down after the race, on the circuit."""
    soft = lambda part, watts: [{**r, "v": 6.0, "watts": watts} for r in part]
    lap = rows[100:290]
    before, after = soft([lap[i // 2 % len(lap)] for i in range(300)], 90), soft([lap[i // 2 % len(lap)] for i in range(240)], 80)
    out, dist = [], 0.0
    for k, r in enumerate([*before, *rows[:-25], *after]):
        out.append({**r, "t": float(k), "dist": dist})
        dist += r["v"]
    return out


@pytest.fixture(scope="module")
def races():
    full = race()
    return {
        "demo": full,
        "half": race(Truth(laps=13, seed=7)),
        "padded": padded(full),
        "no-gps": [{k: v for k, v in r.items() if k not in ("lat", "lon")} for r in full[:900]],
        "drift": [{**r, "alt": r["alt"] + 60 * r["t"] / len(full)} for r in full],
        "hr": [{**r, "hr": 150 + 20 * r["t"] / len(full), "cad": 88.0, "watts": 220.0} for r in full],
        "short": full[:3],
    }


@pytest.fixture(scope="module")
def report(spark, races):
    rides, samples = as_tables(spark, races)
    found = analyze(samples, rides, config=CONFIG, window=True)
    return {k: v for k, v in found.items()} | {"rides": rides, "samples": samples}


def one(report, table, ride="demo"):
    return report[table].where(F.col("ride_id") == ride).collect()


def test_rides_that_are_too_short_are_rejected(report):
    assert [(r["ride_id"], r["reason"]) for r in prepare.rejected(report["samples"]).collect()] == [("short", "too few samples")]
    assert not one(report, "grid", "short")


def test_laps(report):
    laps = one(report, "laps")
    assert abs(len(laps) - 25) <= 2
    length = sorted(r["distance"] for r in laps)[len(laps) // 2]
    assert abs(length - circuit(Truth())[-1][0]) < 60
    assert all(a["i1"] == b["i0"] for a, b in zip(sorted(laps, key=lambda r: r["lap"]), sorted(laps, key=lambda r: r["lap"])[1:]))


def test_mean_lap_closes(report):
    line = sorted(one(report, "mean_lap"), key=lambda r: r["j"])
    step = line[0]["lap_len"] / line[0]["n"]
    assert math.hypot(line[-1]["x"] - line[0]["x"], line[-1]["y"] - line[0]["y"]) < 3 * step
    assert abs(sum(r["curvature"] for r in line) * step) == pytest.approx(2 * math.pi, rel=0.1)


def test_corners(report):
    turns = one(report, "turns")
    assert len(turns) == 4 and {t["dir"] for t in turns} == {"right"} and {t["type"] for t in turns} == {"square"}
    assert all(abs(t["turned"] - 90) < 20 and 0.75 < t["radius"] / Truth().corner < 1.25 for t in turns)
    assert all(t["passes"] >= 20 and t["loss_v"] > 1 and t["exit_kj_total"] == pytest.approx(t["exit_kj"] * t["passes"]) for t in turns)
    assert sorted(t["number"] for t in turns) == [1, 2, 3, 4]


def test_calibration(report):
    wind = one(report, "wind")[0]
    apart = abs((wind["dir_from"] - Truth().wind_from + 180) % 360 - 180)
    assert wind["ok"] and apart < 60 and abs(wind["speed"] - Truth().wind) < 2
    assert abs(wind["cda"] - Truth().cda) < 0.09


def test_leak_and_sectors(report):
    totals = one(report, "sector_totals")
    assert max(t["laps_worst"] for t in totals) >= 9
    assert {c["lap"] for c in one(report, "sector_cells")} == {r["lap"] for r in one(report, "laps")}


def test_surges(report):
    s, surges = one(report, "summary")[0], one(report, "surges")
    assert abs(s["surges"] - 8) <= 4
    assert s["surges"] + s["corner_exit_surges"] == s["all_surges"] == len(surges)
    assert all(x["match_kj"] >= 1 for x in surges)


def test_reserve_is_bounded(report):
    low, high = report["series"].where("ride_id = 'demo'").agg(F.min("balance"), F.max("balance")).first()
    assert 0 <= low <= high <= 21_500


def test_race_window(report):
    w = {r["ride_id"]: r for r in report["race_window"].collect()}
    assert w["demo"]["found"] and w["demo"]["race_laps"] >= 23
    assert not w["no-gps"]["found"] and w["no-gps"]["basis"] == "whole recording"
    p = w["padded"]
    assert p["found"] and abs(p["i0"] - 300) < 150 and p["warmup_seconds"] > 100 and p["race_laps"] >= 20
    kinds = [r["kind"] for r in sorted(one(report, "phases", "padded"), key=lambda r: r["i0"])]
    assert kinds == sorted(kinds, key=["approach", "warmup", "race", "cooldown", "home"].index)
    moved = race_window.adjust_window(report["race_window"], report["lap_info"], 2, -1).where("ride_id = 'demo'").first()
    assert (moved["first_lap"], moved["last_lap"]) == (w["demo"]["first_lap"] + 2, w["demo"]["last_lap"] - 1)
    assert race_window.worth_trimming(report["race_window"]).count() == len(w)


def test_distances_to_a_line_by_two_radii(spark):
    """The near radius only saves pairs: points near, far, beyond both and of a ride without a line."""
    line = spark.createDataFrame([("a", j, 45.0, 7.0, 2.0 * j, 0.0) for j in range(200)], "ride_id string, j long, lat double, lon double, x double, y double")
    points = spark.createDataFrame([(r, i, 45.0 + 7 * i % 260 / 111_320, 7.0 + 3 * i / 80_000) for r in "ab" for i in range(150)], "ride_id string, i long, lat double, lon double")
    one, two = ({(r["ride_id"], r["i"]): r["d"] for r in race_window.distance_to_line(points, line, 3, 180.0, "d", close).collect()} for close in (None, 25.0))
    assert one == two and len(one) == 300 and {d is None for (ride, _), d in one.items() if ride == "b"} == {True}
    known = [d for d in one.values() if d is not None]
    assert min(known) < 25 < max(known) < 180 and len(known) < 150


def test_degraded_rides(report):
    s = one(report, "summary", "no-gps")[0]
    assert s["laps"] == 0 and s["lap_source"] == "none" and s["turns"] == 0 and s["np"] > 0
    assert any("positions are missing" in f["body"] for f in one(report, "findings", "no-gps"))
    assert not one(report, "summary", "drift")[0]["elevation"]["trustworthy"]
    assert one(report, "summary")[0]["elevation"]["trustworthy"]


def test_heart_rate(report):
    assert not one(report, "hr")
    hr = one(report, "hr", "hr")[0]
    assert 5 < hr["decoupling"] < 15 and hr["max"] <= 170
    assert one(report, "summary", "hr")[0]["cadence"]["rpm"] == pytest.approx(88)


def test_shape_fitness_headings_finale(report):
    assert one(report, "shape")[0]["trend"] == "building"
    fit, low = one(report, "fitness")[0], summary.check_fitness(report["summary"], report["settings"].withColumn("cp", F.lit(100.0))).where("ride_id = 'demo'").first()
    assert fit["impossible"] == (fit["np"] > fit["cp"]) and low["impossible"] and not low["ok"] and low["suggested_cp"] > fit["np"]
    assert len(one(report, "headings")) == 16
    assert one(report, "finale")[0]["basis"] == "last 3 laps"


def test_compare(spark, report):
    rows = {r["ride_id"]: r for r in report["compare"].collect()}
    assert set(rows) >= {"demo", "half", "no-gps"} and rows["no-gps"]["circuit"] is None
    groups = {r["ride_id"]: r["circuit_id"] for r in compare.circuit_groups(report["circuit"]).collect()}
    assert groups["demo"] == groups["half"]
    assert ("demo", "half") in {(r["a"], r["b"]) for r in compare.same_circuit_pairs(report["circuit"]).collect()}
    assert compare.turn_matrix(report["turns"]).where("ride_id = 'demo'").first()["4"] > 0
    names = register({"laps": report["laps"]})
    assert spark.sql(f"SELECT count(*) AS n FROM {names[0]} WHERE ride_id = 'demo'").first()["n"] == len(one(report, "laps"))


def test_findings_speak_only_of_what_is_there(report):
    kinds = {f["ord"]: f for f in one(report, "findings")}
    assert 1 in kinds and 4 in kinds and 8 not in kinds
    assert "%" not in kinds[1]["body"] or "%%" not in kinds[1]["body"]


def test_measured_wind(spark, races):
    """Weather at 350 and 10 degrees passes through north, and calibration with it recovers the drag area."""
    factor = weather.shelter_factor(0.1)
    site = lambda name, dirs, speed: [(name, 3600.0 * k, 24.0, 62.0, 1009.0, speed, d, None, None, None) for k, d in enumerate(dirs)]
    wx = spark.createDataFrame(site("x", (Truth().wind_from, Truth().wind_from), Truth().wind / factor) + site("north", (350.0, 10.0), 4.0), WEATHER)
    at = weather.at_times(spark.createDataFrame([("north", 1800.0), ("north", -9e5), ("north", 9e9)], "site string, s double"), wx, "s").orderBy("s").collect()
    assert at[1]["wx_n"] < 0 and abs(at[1]["wx_e"]) < 1e-9
    assert at[0]["wx_e"] == pytest.approx(-4 * math.sin(math.radians(350))) and at[2]["wx_e"] == pytest.approx(-4 * math.sin(math.radians(10)))
    config = ModelConfig(mass=79.5, crr=0.0042)
    rides, samples = as_tables(spark, {"demo": races["demo"]}, start_time=10.0)
    rides = rides.withColumn("site", F.lit("x"))
    grid = prepare.prepare(samples, rides, config).persist()
    settings = settings_of(rides, weather.ride_density(grid, rides, wx, config), config)
    wind = calibrate.resolve_wind(weather.with_wind(grid, rides, wx, config).join(settings, "ride_id"), config).first()
    assert wind["source"] == "weather" and wind["speed"] == pytest.approx(Truth().wind, abs=1e-6) and abs(wind["cda"] - Truth().cda) < 0.07
    sky = weather.conditions(spark.createDataFrame([("demo", "x", 10.0, 2400.0)], "ride_id string, site string, start_s double, end_s double"), wx).first()
    assert sky["wind_dir"] == pytest.approx(Truth().wind_from) and sky["temp"] == pytest.approx(24)

