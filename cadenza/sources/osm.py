"""Map geometry in saved answers of the Overpass service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.geo import haversine_km

#: Road classes and the highway values they stand for.
ROADS = {
    "major": "motorway motorway_link trunk trunk_link primary primary_link",
    "medium": "secondary secondary_link tertiary tertiary_link",
    "minor": "residential unclassified living_street service road",
    "path": "footway path cycleway track bridleway steps pedestrian corridor",
}
MOST_KM, CACHE_DAYS = 15.0, 60
ELEMENT = "elements array<struct<tags: map<string,string>, geometry: array<struct<lat: double, lon: double>>>>"


def road_class(highway: Column) -> Column:
    """Class of a highway value, null for those that are not drawn."""
    return F.create_map(*(F.lit(x) for kind, values in ROADS.items() for value in values.split() for x in (value, kind)))[highway]


def read_ways(spark: SparkSession, path: str) -> DataFrame:
    """``site, kind, cls, name, pts``: roads, buildings, water and areas of at least two points, rounded to 1e-6 degrees."""
    raw = spark.read.schema(ELEMENT).option("multiLine", "true").json(path)
    e = raw.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("site"), F.explode("elements").alias("e"))
    tag = lambda k: F.col("e.tags")[k]
    cls = road_class(tag("highway"))
    kind = (
        F.when(tag("highway").isNotNull(), F.when(cls.isNotNull(), "road")).when(tag("building").isNotNull(), "building")
        .when((tag("natural") == "water") | (tag("waterway") == "riverbank"), "water").when(tag("leisure").isNotNull(), "area")
    )
    pts = F.transform("e.geometry", lambda p: F.struct(F.round(p["lat"], 6).alias("lat"), F.round(p["lon"], 6).alias("lon")))
    ways = e.where(F.size("e.geometry") >= 2).select("site", kind.alias("kind"), F.when(kind == "road", cls).when(kind == "area", tag("leisure")).alias("cls"), F.when(kind == "road", tag("name")).alias("name"), pts.alias("pts"))
    return ways.where("kind is not null")


def way_counts(ways: DataFrame) -> DataFrame:
    """Ways and points of each kind."""
    return ways.groupBy("site", "kind").agg(F.count(F.lit(1)).alias("ways"), F.sum(F.size("pts")).alias("points"))


def overpass_query(box: DataFrame) -> DataFrame:
    """box (``south, west, north, east``) with the ``query`` to ask, null where its diagonal is too long."""
    bounds = F.format_string("%.5f,%.5f,%.5f,%.5f", "south", "west", "north", "east")
    wanted = ('"highway"', '"building"', '"natural"="water"', '"waterway"="riverbank"', '"leisure"~"^(park|pitch|track)$"')
    parts = F.concat(*(x for k in wanted for x in (F.lit(f"way[{k}]("), bounds, F.lit(");"))))
    diagonal = haversine_km(F.col("south"), F.col("west"), F.col("north"), F.col("east"))
    return box.withColumns({"diagonal_km": diagonal, "query": F.when(diagonal <= MOST_KM, F.concat(F.lit("[out:json][timeout:25];("), parts, F.lit(");out geom;")))})
