"""Text, tags, JSON and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.config import first_set
from cadenza.functions import text
from cadenza.functions.geo import corner_kind
from cadenza.plans.findings import reserve_state
from cadenza.queries.registry import query, table
from cadenza.sources import activities, streams
from cadenza.sources.activities import tag_counts
from cadenza.sources.osm import road_class


@query("""
SELECT c_custkey, 'file-' || CAST(c_custkey * 1000 AS VARCHAR) || '-' || regexp_replace(substring(regexp_replace(lower(c_name || ' ' || c_mktsegment || ' (x)'), '[^a-z0-9]+', '-', 'g'), 1, 32), '-+$', '') AS id FROM customer
""")
def slug_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ride ids from names and start times."""
    name = F.concat_ws(" ", "c_name", "c_mktsegment", F.lit("(x)"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.ride_id(F.lit("file"), F.lit(None).cast("string"), F.col("c_custkey") * 1000, name).alias("id"))


@query("""
SELECT p_partkey, coalesce(nullif(trim(regexp_replace(regexp_replace(replace(p_name, ' ', '_-') || CASE WHEN p_partkey % 3 = 0 THEN '.fit' ELSE '' END, '\\.[^.]+$', ''), '[_-]+', ' ', 'g')), ''), 'Race') AS name FROM part
""")
def strip_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names from file names."""
    file = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_-")), F.when(F.col("p_partkey") % 3 == 0, ".fit").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", text.name_of_file(file).alias("name"))


@query("""
WITH t AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Z' ELSE '+02:00' END AS iso FROM events)
SELECT event_id, CASE WHEN regexp_matches(iso, '([zZ]|[+-]\\d{2}:?\\d{2})$') THEN iso ELSE iso || 'Z' END AS iso FROM t
""")
def iso_fixup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times without a zone count as UTC."""
    zone = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, "Z").otherwise("+02:00")
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone)
    return table(spark, sf_dir, "events").select("event_id", text.zoned_iso(iso).alias("iso"))


@query("""
WITH r AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://example.org/activities/i' || page_id WHEN 1 THEN 'i' || page_id ELSE url END AS ref FROM pages)
SELECT page_id, coalesce(nullif(regexp_extract(ref, '(?i)activit(?:y|ies)/([a-z0-9]+)', 1), ''), nullif(regexp_extract(trim(ref), '(?i)^(i?\\d+)$', 1), '')) AS id FROM r
""")
def activity_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity ids in addresses or by themselves."""
    k = F.col("page_id") % 3
    ref = F.when(k == 0, F.concat(F.lit("https://example.org/activities/i"), F.col("page_id").cast("string"))).when(k == 1, F.concat(F.lit("i"), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", text.activity_ref(ref).alias("id"))


@query("""
SELECT event_id, CASE WHEN s >= 3600 THEN CAST(s // 3600 AS VARCHAR) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') ELSE CAST(s % 3600 // 60 AS VARCHAR) END || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock
FROM (SELECT event_id, CAST(floor(value * 40 + 0.5) AS BIGINT) AS s FROM events)
""")
def clock_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds as h:mm:ss or m:ss."""
    return table(spark, sf_dir, "events").select("event_id", text.clock(F.col("value") * 40).alias("clock"))


@query("""
SELECT tag, count(*) AS count FROM (SELECT unnest([event_type, 'k' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS VARCHAR), event_type || '/' || CAST(hour(ts) AS VARCHAR)]) AS tag FROM events) GROUP BY tag
""")
def tag_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags in arrays, counted."""
    k = F.get_json_object("props", "$.k").cast("long") % 10
    tags = F.array(F.col("event_type"), F.concat(F.lit("k"), k.cast("string")), F.concat_ws("/", "event_type", F.hour("ts").cast("string")))
    return tag_counts(table(spark, sf_dir, "events").select(tags.alias("tags")))


@query("""
WITH a AS (SELECT doc_id, ['Ride', 'virtualride', 'Run', 'GravelRide', 'Swim'][doc_id % 5 + 1] AS kind, doc_id % 2 = 0 AS race, n_chars > 200 AS power, doc_id % 7 > 0 AS gps, [lang, source] AS tags, coalesce(text, '') AS name FROM documents)
SELECT doc_id, lower(kind) IN ('ride', 'virtualride', 'gravelride') AS is_ride FROM a WHERE race AND power AND gps AND list_has_any(tags, ['en', 'de', 'src1']) AND contains(lower(name), 'the')
""")
def activity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activities that pass flags, any of several tags and part of a name, and which of them are rides."""
    k = F.col("doc_id")
    kinds = F.array(*map(F.lit, ("Ride", "virtualride", "Run", "GravelRide", "Swim")))
    a = table(spark, sf_dir, "documents").select(
        "doc_id", F.element_at(kinds, (k % 5 + 1).cast("int")).alias("kind"), (k % 2 == 0).alias("is_race"), (F.col("n_chars") > 200).alias("has_power"), (k % 7 > 0).alias("has_gps_stream"),
        F.array("lang", "source").alias("tags"), F.coalesce("text", F.lit("")).alias("name"),
    )
    chosen = a.where(activities.activity_filter(race=True, power=True, gps=True, tags=["en", "de", "src1"], name="The"))
    return chosen.select("doc_id", text.is_ride(F.col("kind")).alias("is_ride"))


@query("SELECT event_id, CASE WHEN event_id % 5 < 4 THEN CAST(json_extract(props, '$.k') AS DOUBLE) END AS k FROM events")
def json_shape_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream from JSON of each shape that the reader knows, by the reader's own rule; one shape has none."""
    k = F.get_json_object("props", "$.k")
    shapes = ('{"k": [%s, 1]}', '{"streams": {"k": {"data": [%s, 1]}}}', '[{"type": "other", "data": [9]}, {"type": "k", "data": [%s]}]', '{"k": {"samples": [%s]}}', '{"none": [%s]}')
    shape = F.element_at(F.array(*(F.format_string(s, k) for s in shapes)), (F.col("event_id") % 5 + 1).cast("int"))
    docs = table(spark, sf_dir, "events").select("event_id", F.try_parse_json(shape).alias("doc"))
    found = streams.stream(F.col("doc"), streams.listed(F.col("doc")), "k")
    return docs.select("event_id", F.get(found, F.lit(0)).alias("k"))


_VALUES = ("primary", "tertiary_link", "residential", "cycleway", "proposed", "service")


@query("""
WITH w AS (SELECT ['primary', 'tertiary_link', 'residential', 'cycleway', 'proposed', 'service'][p_partkey % 6 + 1] AS v, p_type FROM part),
c AS (SELECT p_type, CASE WHEN v = 'primary' THEN 'major' WHEN v = 'tertiary_link' THEN 'medium' WHEN v IN ('residential', 'service') THEN 'minor' WHEN v = 'cycleway' THEN 'path' END AS cls FROM w)
SELECT p_type, cls, count(*) AS n FROM c WHERE cls IS NOT NULL GROUP BY p_type, cls
""")
def road_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roads by class; unknown kinds are left out."""
    v = F.element_at(F.array(*map(F.lit, _VALUES)), (F.col("p_partkey") % 6 + 1).cast("int"))
    c = table(spark, sf_dir, "part").select("p_type", road_class(v).alias("cls")).where("cls is not null")
    return c.groupBy("p_type", "cls").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT c_custkey, round(CASE WHEN o <> 0 AND isfinite(o) THEN o WHEN f <> 0 THEN f WHEN d <> 0 THEN d WHEN isfinite(o) THEN o WHEN f IS NOT NULL THEN f ELSE 0 END, 6) AS cp
FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN CAST(0 AS DOUBLE) WHEN 1 THEN c_acctbal WHEN 2 THEN CAST('NaN' AS DOUBLE) WHEN 3 THEN CAST('Infinity' AS DOUBLE) END AS o,
             CASE c_nationkey % 3 WHEN 1 THEN CAST(0 AS DOUBLE) WHEN 2 THEN c_acctbal / 2 END AS f, CASE WHEN c_custkey % 7 < 5 THEN CAST(250 AS DOUBLE) END AS d FROM customer)
""")
def config_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first finite setting that is not zero, else the first that is finite."""
    k, n, b = F.col("c_custkey") % 5, F.col("c_nationkey") % 3, F.col("c_acctbal")
    o = F.when(k == 0, F.lit(0.0)).when(k == 1, b).when(k == 2, F.lit(float("nan"))).when(k == 3, F.lit(float("inf")))
    f = F.when(n == 1, F.lit(0.0)).when(n == 2, b / 2)
    d = F.when(F.col("c_custkey") % 7 < 5, F.lit(250.0))
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(first_set(o, f, d), 6).alias("cp"))


@query("""
SELECT p_partkey, CASE WHEN p_size * 4 >= 140 THEN 'hairpin' WHEN p_size * 4 >= 60 THEN 'square' WHEN p_size * 4 >= 35 THEN 'sweeper' ELSE 'kink' END AS corner,
       CASE WHEN p_size / 50 > 0.5 THEN 'good' WHEN p_size / 50 > 0.25 THEN 'warning' WHEN p_size / 50 > 0.08 THEN 'serious' ELSE 'critical' END AS reserve FROM part
""")
def state_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of corners by angle and of reserves by how full they are."""
    return table(spark, sf_dir, "part").select("p_partkey", corner_kind(F.col("p_size") * 4).alias("corner"), reserve_state(F.col("p_size").cast("double"), F.lit(50.0)).alias("reserve"))


