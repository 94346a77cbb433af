import json
import struct

import pytest
from pyspark.sql import functions as F

from cadenza.sources import activities, fit, osm, store, streams, synthetic, weather

EPOCH = 1_100_000_000


def definition(local, number, fields, big=False):
    order = ">" if big else "<"
    return bytes([0x40 | local, 0, int(big)]) + struct.pack(order + "HB", number, len(fields)) + b"".join(bytes(f) for f in fields)


def fit_file(records=300, cut=0):
    semi = lambda d: round(d / fit.SEMICIRCLE)
    body = definition(0, 20, [(253, 4, 0x86), (0, 4, 0x85), (1, 4, 0x85), (2, 2, 0x84), (78, 4, 0x86), (5, 4, 0x86), (73, 4, 0x86), (7, 2, 0x84), (3, 1, 2)])
    for i in range(records):
        watts = 0xFFFF if i == 7 else 200 + i % 50
        body += bytes([0]) + struct.pack("<IiiHIIIHB", EPOCH + i, semi(45 + i * 1e-4), semi(7.0), 0xFFFF, round((100 + 500) * 5), i * 1000, 10_000, watts, 0xFF)
    body += definition(1, 19, [(253, 4, 0x86), (9, 4, 0x86)], big=True)
    for at in (100, 200):
        body += bytes([1]) + struct.pack(">II", EPOCH + at, at * 1000)
    body = body[: len(body) - cut] if cut else body
    size = len(body) + cut
    return bytes([14, 0x10]) + struct.pack("<HI4sH", 2100, size, b".FIT", 0) + body + b"\0\0"


def test_fit_round_trip(spark, tmp_path):
    (tmp_path / "my_race.fit").write_bytes(fit_file())
    (tmp_path / "short.fit").write_bytes(fit_file(100, cut=500))
    (tmp_path / "none.fit").write_bytes(b"not a fit file at all")
    messages = fit.read_messages(spark, str(tmp_path))
    assert messages.where("message = 'error'").count() == 1
    assert messages.where("truncated").select("path").distinct().count() == 1
    rides, samples = fit.rides_of(messages.where("path like '%my_race%'"))
    ride = rides.first()
    assert ride["name"] == "my race" and ride["lap_times"] == [100.0, 200.0] and ride["start_time"] == EPOCH + fit.EPOCH
    rows = samples.orderBy("t").collect()
    assert len(rows) == 300
    assert rows[5]["lat"] == pytest.approx(45.0005, abs=1e-6) and rows[5]["v"] == 10 and rows[5]["alt"] == 100 and rows[5]["dist"] == 50
    assert rows[7]["watts"] is None and rows[8]["watts"] == 208 and rows[8]["hr"] is None


def test_fit_packed_times(spark, tmp_path):
    body = definition(0, 20, [(253, 4, 0x86), (7, 2, 0x84)]) + bytes([0]) + struct.pack("<IH", 1000 * 32 + 30, 100)
    body += definition(1, 20, [(7, 2, 0x84)]) + bytes([0x80 | 1 << 5 | 31]) + struct.pack("<H", 101) + bytes([0x80 | 1 << 5 | 1]) + struct.pack("<H", 102)
    data = bytes([12, 0x10]) + struct.pack("<HI4s", 2100, len(body), b".FIT") + body + b"\0\0"
    assert [m[1]["timestamp"] - 32000 for m in fit.messages_of(data)] == [30, 31, 33]
    assert len(list(fit.messages_of(data * 2))) == 6


def developer_file():
    """A field of a developer's own, described before it is used."""
    name = b"core_temp\0" + b"\0" * 6
    body = definition(0, 206, [(0, 1, 2), (1, 1, 2), (2, 1, 2), (3, 16, 7)]) + bytes([0, 0, 5, 0x84]) + name
    body += bytes([0x60 | 1, 0, 0]) + struct.pack("<HB", 20, 2) + bytes((253, 4, 0x86)) + bytes((7, 2, 0x84)) + bytes([1]) + bytes((5, 2, 0))
    for i in range(3):
        body += bytes([1]) + struct.pack("<IHH", EPOCH + i, 200 + i, 370 + i)
    return bytes([12, 0x10]) + struct.pack("<HI4s", 2100, len(body), b".FIT") + body + b"\0\0"


def test_fit_as_a_format(spark, tmp_path):
    from cadenza.sources import fit_source

    fit_source.register(spark)
    for name, data in {"race": fit_file(), "short": fit_file(100, cut=500), "none": b"not a fit file", "chained": fit_file(10) * 2, "own": developer_file()}.items():
        (tmp_path / f"{name}.fit").write_bytes(data)
    (tmp_path / "other.txt").write_text("no")
    rows = spark.read.format("fit").load(str(tmp_path))
    plain = fit.read_messages(spark, str(tmp_path), keep=tuple(fit.MESSAGES.values()))
    count = lambda df: {(r["path"].rsplit("/")[-1], r["message"], r["truncated"]): r["count"] for r in df.groupBy("path", "message", "truncated").count().collect()}
    assert count(rows) == count(plain) and count(rows)["chained.fit", "record", False] == 20 and count(rows)["short.fit", "record", True] > 50
    assert rows.rdd.getNumPartitions() == 5
    records = rows.where("message = 'record'")
    watts = {(r["path"], r["seq"]): r["watts"] for r in records.collect()}
    assert watts == {(r["path"].removeprefix("file:"), r["seq"]): r["w"] for r in plain.where("message = 'record'").selectExpr("path", "seq", "fields['watts'] w").collect()}
    own = records.where(F.col("path") == str(tmp_path / "own.fit"))
    assert [r["developer"] for r in own.orderBy("seq").collect()] == [{"core_temp": 370.0 + i} for i in range(3)]
    slim = spark.read.format("fit").schema("message string, watts double").option("messages", "record, lap").load(str(tmp_path))
    assert {r["message"] for r in slim.collect()} == {"record", "lap"}
    assert slim.columns == ["message", "watts"] and slim.groupBy("message").count().where("message = 'lap'").first()["count"] == plain.where("message = 'lap'").count()
    assert [r["error"] for r in rows.where("message = 'error'").collect()] == ["no .FIT signature"]
    (tmp_path / "empty").mkdir()
    assert spark.read.format("fit").load(str(tmp_path / "empty")).count() == 0


def stream_json():
    n = 40
    lat, lon = [45 + i * 1e-4 for i in range(n)], [7 + i * 1e-4 for i in range(n)]
    return n, lat, lon, {"time": list(range(n)), "watts": [200 + i for i in range(n)], "distance": [10.0 * i for i in range(n)]}


def test_stream_shapes(spark, tmp_path):
    n, lat, lon, base = stream_json()
    listed = [{"type": k, "data": v} for k, v in base.items()]
    write = lambda name, value: (tmp_path / f"{name}.json").write_text(json.dumps(value))
    write("parallel", [*listed, {"type": "latlng", "data": lat, "data2": lon}])
    write("pairs", {**{k: {"data": v} for k, v in base.items()}, "latlng": {"data": [list(p) for p in zip(lat, lon)]}})
    write("separate", {"streams": {**base, "lat": lat, "lng": lon}, "name": "Named", "start_date": "2026-06-07T17:30:00"})
    write("zeros", [*listed, {"type": "latlng", "data": [0.0] * n, "data2": [0.0] * n}])
    write("own", {"t": base["time"], "watts": base["watts"], "dist": base["distance"], "lat": lat, "lon": lon, "cp": 280, "startTime": 1.5e9, "name": "Own"})
    write("powerless", [{"type": "time", "data": base["time"]}])
    write("empty", [])
    rides, samples, rejected = streams.read_streams(spark, str(tmp_path))
    assert {(r["file"], r["reason"]) for r in rejected.collect()} == {("powerless.json", "no power"), ("empty.json", "no time stream")}
    found = {r["name"]: r for r in rides.collect()}
    assert set(found) == {"parallel", "pairs", "Named", "zeros", "Own"}
    assert found["Own"]["cp"] == 280 and found["Named"]["start_time"] == 1780853400
    places = samples.join(rides.select("ride_id", "name"), "ride_id").groupBy("name").agg(F.count("lat").alias("k"), F.count(F.lit(1)).alias("n"), F.max("lon").alias("lon"), F.sum("watts").alias("w")).collect()
    assert {r["name"]: (r["k"], r["n"]) for r in places} == {x: (0 if x == "zeros" else n, n) for x in found}
    assert all(r["lon"] == pytest.approx(lon[-1]) for r in places if r["name"] != "zeros") and len({r["w"] for r in places}) == 1


def test_activities(spark, tmp_path):
    rows = [
        {"id": "1", "name": "Crit", "type": "Ride", "race": True, "stream_types": ["latlng", "watts"], "tags": ["hard", "group ride"], "start_date_local": "2026-06-07T17:30:00", "icu_average_watts": 231},
        {"id": "2", "type": "VirtualRide", "sub_type": "race", "stream_types": ["watts"], "tags": None, "start_date_local": "2026-06-09T17:30:00", "average_watts": 0},
        {"id": "3", "name": "Run", "type": "Run", "source": "Strava", "start_date_local": "2026-07-09T17:30:00"},
    ]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    s = activities.summaries(activities.read_activities(spark, str(tmp_path), newest="2026-06-30"))
    assert s.count() == 2 and len(s.columns) >= 24
    assert [r["id"] for r in s.where(activities.activity_filter(race=True, power=True, gps=True)).collect()] == ["1"]
    assert [r["id"] for r in s.where(activities.activity_filter(tags=["hard", "x"], name="CRI")).collect()] == ["1"]
    every = {r["id"]: r for r in activities.summaries(activities.read_activities(spark, str(tmp_path))).collect()}
    assert every["2"]["is_race"] and every["2"]["name"] == "Untitled" and every["2"]["has_power"] and every["3"]["api_blocked"] and not every["3"]["is_ride"]
    assert [(r["tag"], r["count"]) for r in activities.tag_counts(s).collect()] == [("group ride", 1), ("hard", 1)]


def test_map(spark, tmp_path):
    line = [{"lat": 45.12345678, "lon": 7.0}, {"lat": 45.2, "lon": 7.1}]
    tags = [{"highway": "primary", "name": "Main"}, {"highway": "proposed"}, {"building": "yes"}, {"natural": "water"}, {"leisure": "park"}, {"shop": "x"}]
    (tmp_path / "site.json").write_text(json.dumps({"elements": [{"tags": t, "geometry": line} for t in tags] + [{"tags": {"building": "yes"}, "geometry": line[:1]}]}))
    ways = osm.read_ways(spark, str(tmp_path))
    assert {r["kind"]: r["ways"] for r in osm.way_counts(ways).collect()} == {"road": 1, "building": 1, "water": 1, "area": 1}
    road = ways.where("kind = 'road'").first()
    assert (road["cls"], road["name"], road["pts"][0]["lat"]) == ("major", "Main", 45.123457)
    box = spark.createDataFrame([(45.0, 7.0, 45.01, 7.01), (45.0, 7.0, 46.0, 8.0)], "south double, west double, north double, east double")
    assert [r["query"] is None for r in osm.overpass_query(box).orderBy("north").collect()] == [False, True]


def test_weather_file(spark, tmp_path):
    hourly = {"time": ["2026-06-07T17:00", "2026-06-07T18:00", "2026-06-07T19:00"], **{v: [1.0, 2.0, 3.0] for v in weather.VARIABLES.values()}}
    hourly["wind_speed_10m"] = [5.0, None, 6.0]
    (tmp_path / "site.json").write_text(json.dumps({"latitude": 45, "longitude": 7, "elevation": 90, "hourly": hourly}))
    rows = weather.read_weather(spark, str(tmp_path)).orderBy("time").collect()
    assert [(r["site"], r["time"], r["wind_speed"]) for r in rows] == [("site", 1780851600.0, 5.0), ("site", 1780858800.0, 6.0)]


def files_of(path):
    return {f for f in path.rglob("*.parquet")}


def test_store(spark, tmp_path):
    path = str(tmp_path / "rides")
    rows = synthetic.race(synthetic.Truth(laps=1))
    first, samples = synthetic.as_tables(spark, {"x": rows, "y": rows[:50]})
    store.put(first, samples, path)
    before = files_of(tmp_path)
    again, short = synthetic.as_tables(spark, {"y": rows[:20]}, start_time=9.0)
    store.put(again, short, path)
    assert before < files_of(tmp_path)  # what was there is not written again
    assert [r["ride_id"] for r in store.rides(spark, path).collect()] == ["y", "x"]
    assert store.get(spark, path, "y")[1].count() == 20
    assert store.get(spark, path, "x")[1].count() == len(rows)
    assert store.samples(spark, path).count() == len(rows) + 20
    store.remove(spark, path, "y")
    assert [r["ride_id"] for r in store.rides(spark, path).collect()] == ["x"] and store.get(spark, path, "y")[1].count() == 0
    store.put(again, short, path)
    assert [r["ride_id"] for r in store.rides(spark, path).collect()] == ["y", "x"]
    store.compact(spark, path)
    assert len({f.parent for f in files_of(tmp_path)}) == 2
    assert [r["ride_id"] for r in store.rides(spark, path).collect()] == ["y", "x"] and store.samples(spark, path).count() == len(rows) + 20


def test_two_writers_lose_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    rows = synthetic.race(synthetic.Truth(laps=1))[:30]
    path = str(tmp_path / "rides")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: store.put(*synthetic.as_tables(spark, {f"r{k}": rows, "both": rows[: k + 1]}), path), range(4)))
    assert {r["ride_id"] for r in store.rides(spark, path).collect()} == {"r0", "r1", "r2", "r3", "both"}
    sizes = {r["ride_id"]: r["count"] for r in store.samples(spark, path).groupBy("ride_id").count().collect()}
    assert sizes.pop("both") in (1, 2, 3, 4) and set(sizes.values()) == {30}


def test_a_stream_is_ingested_once(spark, tmp_path):
    rows = synthetic.race(synthetic.Truth(laps=1))[:30]
    rides, samples = synthetic.as_tables(spark, {"a": rows, "b": rows[:10]})
    path, split = str(tmp_path / "store"), lambda df: (rides.join(df.select("ride_id").distinct(), "ride_id", "left_semi"), df)
    for k, one in enumerate(("a", "b")):
        samples.where(F.col("ride_id") == one).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    save = store.ingest(path, "live", split)
    stream.writeStream.foreachBatch(save).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    before = files_of(tmp_path / "store")
    save(samples, 0)  # the first trigger once more, as after a lost driver
    assert files_of(tmp_path / "store") == before and {r["ride_id"] for r in store.rides(spark, path).collect()} == {"a", "b"}
    assert store.samples(spark, path).count() == 40


def test_mixed_folder(spark, tmp_path):
    from cadenza.sources.files import read_rides

    (tmp_path / "one.FIT").write_bytes(fit_file())
    (tmp_path / "two.json").write_text(json.dumps({"t": [0, 1, 2], "watts": [100, 200, 300], "startTime": 5}))
    (tmp_path / "bad.json").write_text("{}")
    rides, samples, rejected = read_rides(spark, str(tmp_path))
    assert {r["name"] for r in rides.collect()} == {"one", "two"} and samples.select("ride_id").distinct().count() == 2
    assert [r["file"] for r in rejected.collect()] == ["bad.json"]


def test_cached_answers(spark):
    df = spark.createDataFrame([(42.545, -71.615, 86_400 * 3 + 1800, 86_400 * 3 + 7200)], "lat double, lon double, a long, b long")
    assert df.select(weather.cache_key(F.col("lat"), F.col("lon"), F.col("a"), F.col("b"))).first()[0] in ("42.55_-71.62_1970-01-03_1970-01-04", "42.54_-71.61_1970-01-03_1970-01-04", "42.55_-71.61_1970-01-03_1970-01-04", "42.54_-71.62_1970-01-03_1970-01-04")
