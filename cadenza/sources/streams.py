"""JSON files of activity streams in any of their three shapes, by VARIANT paths.

1. An own export: an object with ``t`` and channels as arrays.
2. A list of ``{type, data, data2}``; ``data2`` holds longitudes.
3. An object by type, maybe under ``streams``, of arrays or ``{data | samples | values}``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions.text import name_of_file, ride_id, zoned_iso

#: Channels and the stream types that carry them, first come first.
STREAMS = {"alt": ("altitude",), "v": ("velocity_smooth",), "watts": ("watts", "fixed_watts"), "hr": ("heartrate",), "cad": ("cadence",), "dist": ("distance",), "temp": ("temp",)}
_LIST = "array<struct<type string, data variant, data2 variant, values variant>>"


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _full(a: Column) -> Column:
    return F.when(F.size(a) > 0, a)


def _or_empty(name: str) -> Column:
    """A channel that is absent must not make the zipped rows null."""
    return F.coalesce(name, F.array().cast("array<double>"))


def listed(v: Column) -> Column:
    """The streams of a document in shape 2, null of others."""
    return _get(v, "$", _LIST)


def stream(v: Column, items: Column, name: str, kind: str = "array<double>", second: bool = False) -> Column:
    """A stream of a document in shape 2 or 3, null if it has none."""
    part = "data2" if second else "data"
    listed = F.get(F.filter(items, lambda x: x["type"] == name), F.lit(0))
    found = [_get(listed[part], "$", kind)] + ([] if second else [_get(listed["values"], "$", kind)])
    for root in ("$.streams", "$"):
        found += [_get(v, f"{root}.{name}.{p}", kind) for p in ((part,) if second else ("data", "samples", "values"))]
        found += [] if second else [_get(v, f"{root}.{name}", kind)]
    return F.coalesce(*map(_full, found))


def read_streams(spark: SparkSession, path: str, activities: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rides, samples, rejected) of JSON files under a path, one ride a file.

    ``rejected`` names files without a time stream or without power. With
    ``activities`` (from ``activities.summaries``), files named by an activity's id get its settings.
    """
    text = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path).select(F.col("value"), F.col("_metadata.file_name").alias("file"))
    v = F.col("doc")
    docs = text.withColumn("doc", F.try_parse_json("value")).drop("value")
    docs = docs.withColumn("items", listed(v))
    own = _full(_get(v, "$.t", "array<double>"))
    items = F.col("items")
    channel = {c: F.coalesce(*(stream(v, items, s) for s in names)) for c, names in STREAMS.items()}
    pairs = stream(v, items, "latlng", "array<array<double>>")
    parallel_lat, parallel_lon = stream(v, items, "latlng"), stream(v, items, "latlng", second=True)
    lat = F.coalesce(F.when(parallel_lon.isNotNull(), parallel_lat), F.transform(pairs, lambda p: F.get(p, F.lit(0))), stream(v, items, "lat"), stream(v, items, "latitude"))
    lon = F.coalesce(F.when(parallel_lat.isNotNull(), parallel_lon), F.transform(pairs, lambda p: F.get(p, F.lit(1))), stream(v, items, "lng"), stream(v, items, "lon"), stream(v, items, "longitude"))
    is_own = own.isNotNull()
    pick = lambda c, other: F.when(is_own, _full(_get(v, f"$.{c}", "array<double>"))).otherwise(other)
    parsed = docs.select("file", "doc", F.coalesce(own, stream(v, items, "time")).alias("t"), pick("lat", lat).alias("lat"), pick("lon", lon).alias("lon"), *(pick(c, x).alias(c) for c, x in channel.items()), is_own.alias("own"))
    reason = F.when(F.col("t").isNull(), "no time stream").when(F.col("watts").isNull() & ~F.col("own"), "no power")
    parsed = parsed.withColumn("reason", reason)
    rejected = parsed.where("reason is not null").select("file", "reason")
    good = parsed.where("reason is null")
    text_of = lambda *names: F.coalesce(*(F.nullif(_get(v, f"$.{n}", "string"), F.lit("")) for n in names))
    number = lambda *names: F.coalesce(*(_get(v, f"$.{n}", "double") for n in names))
    iso = text_of("start_date", "start_date_local")
    start = F.coalesce(number("startTime"), F.unix_micros(F.try_to_timestamp(zoned_iso(iso))) / 1e6)
    source = F.when(F.col("own"), F.coalesce(text_of("source"), F.lit("json"))).otherwise("icu")
    rides = good.select(
        "file", F.coalesce(text_of("name"), name_of_file(F.col("file"))).alias("name"), source.alias("source"), F.when(~F.col("own"), text_of("id")).alias("source_id"), start.alias("start_time"), F.lower(F.coalesce(text_of("sport", "type"), F.lit("ride"))).alias("sport"),
        number("ftp", "icu_ftp").alias("ftp"), number("weightKg", "icu_weight").alias("weight_kg"), number("cp", "icu_pm_cp").alias("cp"), number("wPrime", "icu_pm_w_prime").alias("w_prime"),
        F.coalesce(_get(v, "$.lapTimes", "array<double>"), F.array().cast("array<double>")).alias("lap_times"),
    )
    if activities is not None:
        a = activities.select(F.col("id").alias("_id"), F.col("name").alias("_name"), F.col("start_utc").alias("_start"), *(F.col(c).alias(f"_{c}") for c in ("ftp", "weight_kg", "cp", "w_prime")))
        rides = rides.withColumn("_key", F.coalesce("source_id", F.regexp_replace("file", r"\.json$", ""))).join(a, F.col("_key") == F.col("_id"), "left")
        rides = rides.withColumns({"source_id": F.coalesce("source_id", "_id"), "name": F.coalesce("_name", "name"), "start_time": F.coalesce("start_time", F.unix_micros(F.try_to_timestamp(zoned_iso(F.col("_start")))) / 1e6), **{c: F.coalesce(c, f"_{c}") for c in ("ftp", "weight_kg", "cp", "w_prime")}}).select(*rides.columns)
    rides = rides.withColumn("ride_id", ride_id(F.col("source"), F.col("source_id"), F.col("start_time"), F.concat_ws("-", "name", F.regexp_replace("file", r"\.json$", ""))))
    nothing = F.lit(None).cast("double")
    rides = rides.withColumns({c: nothing for c in ("crop_start", "crop_end", "anchor_lat", "anchor_lon")})
    series = good.select("file", "lat", "lon", "t", *channel).join(rides.select("file", "ride_id"), "file")
    zipped = series.select("ride_id", F.posexplode(F.arrays_zip(*(_or_empty(c).alias(c) for c in ("t", "lat", "lon", *channel)))).alias("seq", "p")).select("ride_id", F.col("seq").cast("long").alias("seq"), "p.*").where("t is not null")
    return rides.drop("file"), sound_places(zipped), rejected


def sound_places(samples: DataFrame) -> DataFrame:
    """samples with places out of range or at 0, 0 as null, and all of a ride's where fewer than ten or a twentieth are left."""
    whole = Window.partitionBy("ride_id")
    fine = F.coalesce((F.abs("lat") <= 90) & (F.abs("lon") <= 180) & ~((F.col("lat") == 0) & (F.col("lon") == 0)), F.lit(False))
    df = samples.withColumn("_fine", fine)
    enough = F.sum(F.col("_fine").cast("int")).over(whole) >= F.greatest(F.lit(10.0), 0.05 * F.count(F.lit(1)).over(whole))
    df = df.withColumn("_fine", F.col("_fine") & enough)
    return df.withColumns({c: F.when(F.col("_fine"), F.col(c)) for c in ("lat", "lon")}).drop("_fine")
