"""Names, ids, times and predicates on the columns of activity lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The activity types that count as rides.
RIDE_TYPES = ("Ride", "VirtualRide", "GravelRide", "MountainBikeRide", "EBikeRide", "Velomobile")


def slug(name: Column) -> Column:
    """Lower case with runs of other characters than letters and digits as one dash, 32 characters at most."""
    return F.regexp_replace(F.substring(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), 1, 32), "-+$", "")


def ride_id(source: Column, source_id: Column, start: Column, name: Column) -> Column:
    """``icu-<id>`` for activities of the service, else source, start and slug."""
    stamp = F.coalesce(start.cast("long").cast("string"), F.lit("0"))
    return F.when((source == "icu") & source_id.isNotNull(), F.concat(F.lit("icu-"), source_id)).otherwise(F.regexp_replace(F.concat_ws("-", source, stamp, slug(name)), "-+$", ""))


def name_of_file(file: Column, default: str = "Race") -> Column:
    """File name without extension, dashes and underscores as blanks."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(F.regexp_replace(file, r"\.[^.]+$", ""), "[_-]+", " ")), F.lit("")), F.lit(default))


def zoned_iso(value: Column) -> Column:
    """ISO time with ``Z`` where it names no zone."""
    return F.when(value.rlike(r"(?:[zZ]|[+-]\d{2}:?\d{2})$"), value).otherwise(F.concat(value, F.lit("Z")))


def is_ride(kind: Column) -> Column:
    return F.coalesce(kind.rlike("(?i)^(?:" + "|".join(RIDE_TYPES) + ")$"), F.lit(False))


def activity_ref(text: Column) -> Column:
    """The id in an activity's address, or a bare id."""
    in_url = F.nullif(F.regexp_extract(text, r"(?i)activit(?:y|ies)/([a-z0-9]+)", 1), F.lit(""))
    bare = F.nullif(F.regexp_extract(F.trim(text), r"(?i)^(i?\d+)$", 1), F.lit(""))
    return F.coalesce(in_url, bare)


def clock(seconds: Column) -> Column:
    """``h:mm:ss`` or ``m:ss``; a dash where there is no time."""
    s = F.floor(seconds + 0.5).cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    long = F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(r))
    short = F.concat(m.cast("string"), F.lit(":"), two(r))
    return F.when(seconds.isNull() | F.isnan(seconds.cast("double")), F.lit("—")).when(h > 0, long).otherwise(short)
