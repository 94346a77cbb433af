"""Live operators over several triggers, and the search of laps."""

import random
import statistics
from datetime import datetime, timedelta

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadenza.config import ModelConfig
from cadenza.plans import laps
from cadenza.queries import ORACLES, QUERIES, circuits
from cadenza.streaming.history import live_history, live_within

START = datetime(2024, 5, 1, 12)


def stream(spark, folder, parts, schema):
    for k, rows in enumerate(parts):
        spark.createDataFrame([(key, START + timedelta(seconds=s), v) for key, s, v in rows], schema).coalesce(1).write.parquet(str(folder / "in" / f"{k:03d}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder / "in"))


def to_end(df, folder):
    df.writeStream.format("parquet").option("checkpointLocation", str(folder / "state")).option("path", str(folder / "out")).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(str(folder / "out")).collect()


def test_history_rates_and_stops(spark, tmp_path):
    """A ring of 10 s, rates over 3 s, stops after 8 s: one seen when a sample comes later, one when its timer fires, none for a key that goes on."""
    schema = "k string, at timestamp, v double"
    parts = [
        [("a", s, 100.0 + s) for s in range(5)] + [("b", 0, 1.0)],
        [("a", s, 100.0 + s) for s in range(5, 8)] + [("b", 4, None), ("b", 8, 3.0)],
        [("a", 20, 200.0), ("b", 12, 5.0), ("b", 16, 7.0), ("b", 20, 9.0)],
        [("b", s, 1.0) for s in range(24, 80, 4)],
    ]
    out = to_end(live_history(stream(spark, tmp_path, parts, schema), "k", "at", "v", span=10.0, rate=3.0, stop=8.0, late="2 seconds"), tmp_path)
    start = int(START.timestamp() * 1e6) if START.tzinfo else int((START - datetime(1970, 1, 1)).total_seconds() * 1e6)
    rows = {(r["k"], (r["at"] - start) / 1e6, r["kind"]): r for r in out}
    assert len(rows) == len(out)
    assert [(k, s) for k, s, kind in sorted(rows) if kind == "stop"] == [("a", 15.0), ("a", 28.0)]
    assert rows["a", 7.0, "sample"]["mean"] == pytest.approx(103.5) and rows["a", 7.0, "sample"]["rate"] == pytest.approx(1.0) and rows["a", 0.0, "sample"]["rate"] == 0
    assert rows["a", 20.0, "sample"]["n"] == 1 and rows["b", 8.0, "sample"]["mean"] == pytest.approx(2.0) and rows["b", 4.0, "sample"]["rate"] == 0


def test_history_of_samples_close_together_equals_sql(spark, tmp_path):
    """Rates over a few milliseconds, and samples of one time; in a series of its own one of these has no value."""
    rng = random.Random(5)
    rows = [(k, START + timedelta(seconds=1000 * k, microseconds=rng.randrange(200_000)), round(rng.uniform(0, 500), 2)) for k in range(300) for _ in range(3)]
    rows += [(400, START, 1.0), (400, START, 4.0), (400, START + timedelta(seconds=2), 7.0)]
    (tmp_path / "sf").mkdir()
    frame = pd.DataFrame([(n, ts, k, "view", v, "") for n, (k, ts, v) in enumerate(rows)], columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    frame.astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "sf" / "events.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/sf/events.parquet'")
    columns = ["user_id", "at_us", "kind", "mean", "rate", "n"]
    ours = QUERIES["stream_history"](spark, str(tmp_path / "sf")).select(*columns).collect()
    theirs = duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES['stream_history']})").fetchall()
    assert sorted(map(tuple, ours)) == sorted(theirs)
    out = to_end(live_history(stream(spark, tmp_path, [[("a", 0, 1.0), ("a", 0, None), ("a", 1, 3.0)]], "k string, at timestamp, v double"), "k", "at", "v"), tmp_path)
    assert sorted((r["mean"], r["n"]) for r in out if r["kind"] == "sample") == [(1.0, 1), (1.0, 1), (2.0, 2)]


def test_streams_joined_within_times(spark, tmp_path):
    schema = "k string, at timestamp, v double"
    left = stream(spark, tmp_path / "l", [[("a", 0, 1.0), ("a", 50, 2.0)], [("b", 60, 3.0), ("a", 100, 4.0), ("a", 300, 5.0)]], schema)
    right = stream(spark, tmp_path / "r", [[("a", 45, 0.0), ("a", 46, 0.0)], [("b", 75, 0.0), ("a", 290, 0.0)]], schema)
    out = to_end(live_within(left, right, "k", "at", "20 SECONDS", "10 SECONDS", late="1 minute"), tmp_path)
    assert sorted(r["v"] for r in out) == [2.0, 3.0, 5.0]


def test_laps_are_found_without_python(spark):
    grid = circuits.circuit_rides(spark, "/root/testdata/sf0.001").where("ride_id = '0'")
    tracked = laps.tracks(grid, ModelConfig())
    plan = laps.anchor_laps(laps.passes(tracked, tracked.where("rank < 8"), ModelConfig()), ModelConfig())._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_passes_of_an_anchor_are_thinned_once(spark):
    """Laps of anchors with many passes, as a plain loop finds them; the loop over all passes stands once in the plan."""
    rng, rows, want = random.Random(8), [], {}
    for anchor, (n, scatter) in enumerate(((200, 20), (90, 250), (3, 0), (2, 0), (120, 900))):
        at, marks = 0.0, []
        for i in range(n):
            at += rng.choice((5.0, 650.0 + rng.uniform(0, scatter)))
            rows.append(("r", anchor, i, at))
            if not marks or at - marks[-1][1] > ModelConfig().min_lap_metres:
                marks.append((i, at))
        pairs = [(a[0], b[0], b[1] - a[1]) for a, b in zip(marks, marks[1:])]
        sizes = [p[2] for p in pairs]
        if len(pairs) >= 2 and statistics.pstdev(sizes, mid := statistics.median(sizes)) / mid <= laps.SCATTER:
            want[anchor] = [p[:2] for p in pairs if 0.7 * mid < p[2] < 1.4 * mid]
    found = laps.anchor_laps(spark.createDataFrame(rows, "ride_id string, anchor long, i long, dist double"), ModelConfig())
    assert {r["anchor"]: [(p["i0"], p["i1"]) for p in r["laps"]] for r in found.collect()} == {k: v for k, v in want.items() if len(v) >= 2}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") <= 2


def test_laps_from_a_placed_line(spark):
    """A line a few metres off the road: laps begin where the ride is nearest to it; one far off gives those found by search."""
    grid = circuits.circuit_rides(spark, "/root/testdata/sf0.001").where("ride_id = '0'").cache()
    at = grid.where("i = 40").first()
    found = {}
    for name, lat, lon in (("near", at["lat"] + 0.00005, at["lon"]), ("far", at["lat"] + 1, at["lon"]), ("none", None, None)):
        rides = spark.createDataFrame([("0", lat, lon)], "ride_id string, anchor_lat double, anchor_lon double")
        found[name] = sorted((r["lap"], r["i0"], r["i1"], r["source"]) for r in laps.detect_laps(grid, rides, None).collect())
    assert found["far"] == found["none"] and {r[3] for r in found["none"]} == {"gps"} and {r[3] for r in found["near"]} == {"manual"}
    assert min(abs(r[1] - 40) for r in found["near"]) <= 1 and len(found["near"]) >= 5
    length = [r["d"] for r in grid.select("i", "dist").join(spark.createDataFrame([(r[1], r[2]) for r in found["near"]], "a long, b long"), F.col("i") == F.col("a")).selectExpr("dist d").collect()]
    assert all(abs((y - x) - circuits.LAP) < 30 for x, y in zip(sorted(length), sorted(length)[1:]))
