"""Binary FIT activity files: one task a file, decoded to rows of messages, the rest in SQL.

The table of messages keeps numbers and strings in maps, so that every field
of the profile and every developer field reaches Spark; rides, samples and
laps are projections of it. Checksums are not verified; a file that ends early
gives the messages before its end, marked ``truncated``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions.text import name_of_file, ride_id
from cadenza.plans.tables import CHANNELS

#: Seconds from 1970 to the format's epoch; degrees in a semicircle unit.
EPOCH, SEMICIRCLE = 631_065_600, 180 / 2_147_483_648
#: Base types by number: struct code and the value that stands for none.
BASE_TYPES = (
    ("B", 0xFF), ("b", 0x7F), ("B", 0xFF), ("h", 0x7FFF), ("H", 0xFFFF), ("i", 0x7FFFFFFF), ("I", 0xFFFFFFFF), ("s", 0), ("f", None), ("d", None),
    ("B", 0), ("H", 0), ("I", 0), ("B", 0xFF), ("q", None), ("Q", None), ("Q", 0),
)
#: Messages by number.
MESSAGES = {0: "file_id", 12: "sport", 18: "session", 19: "lap", 20: "record", 21: "event", 23: "device_info", 34: "activity", 206: "field_description", 207: "developer_data_id"}
_SEMI = 1 / SEMICIRCLE
#: Fields of each message: number, name, and where needed divisor, offset and precedence.
PROFILE = {
    "file_id": {0: ("type",), 1: ("manufacturer",), 2: ("product",), 3: ("serial_number",), 4: ("time_created",), 5: ("number",), 8: ("product_name",)},
    "sport": {0: ("sport",), 1: ("sub_sport",), 3: ("name",)},
    "record": {
        0: ("lat", _SEMI), 1: ("lon", _SEMI), 2: ("alt", 5, 500), 3: ("hr",), 4: ("cad",), 5: ("dist", 100), 6: ("v", 1000), 7: ("watts",), 9: ("grade", 100), 13: ("temp",),
        30: ("lr_balance",), 53: ("frac_cad", 128), 73: ("v", 1000, 0, 1), 78: ("alt", 5, 500, 1), 253: ("timestamp",),
    },
    "lap": {
        2: ("start_time",), 3: ("start_lat", _SEMI), 4: ("start_lon", _SEMI), 5: ("end_lat", _SEMI), 6: ("end_lon", _SEMI), 7: ("elapsed", 1000), 8: ("timer", 1000), 9: ("distance", 100), 11: ("calories",),
        13: ("avg_speed", 1000), 14: ("max_speed", 1000), 15: ("avg_hr",), 16: ("max_hr",), 17: ("avg_cad",), 19: ("avg_power",), 20: ("max_power",), 21: ("ascent",), 22: ("descent",), 24: ("trigger",), 253: ("timestamp",), 254: ("index",),
    },
    "session": {
        2: ("start_time",), 3: ("start_lat", _SEMI), 4: ("start_lon", _SEMI), 5: ("sport",), 6: ("sub_sport",), 7: ("elapsed", 1000), 8: ("timer", 1000), 9: ("distance", 100), 11: ("calories",), 14: ("avg_speed", 1000),
        15: ("max_speed", 1000), 16: ("avg_hr",), 17: ("max_hr",), 18: ("avg_cad",), 20: ("avg_power",), 21: ("max_power",), 22: ("ascent",), 23: ("descent",), 34: ("np",), 48: ("work",), 253: ("timestamp",),
    },
    "event": {0: ("event",), 1: ("event_type",), 3: ("data",), 253: ("timestamp",)},
    "activity": {0: ("total_timer_time", 1000), 1: ("num_sessions",), 2: ("type",), 3: ("event",), 4: ("event_type",), 5: ("local_timestamp",), 253: ("timestamp",)},
    "field_description": {0: ("developer_data_index",), 1: ("field_definition_number",), 2: ("fit_base_type_id",), 3: ("field_name",), 8: ("units",), 14: ("native_mesg_num",), 15: ("native_field_num",)},
    "developer_data_id": {1: ("application_id",), 3: ("developer_data_index",)},
}
SPORTS = {0: "generic", 1: "running", 2: "cycling", 5: "swimming"}
#: Files of more chained parts than this are broken.
MOST_PARTS = 32


class FitError(ValueError):
    """Not a FIT file."""


def field_value(data: bytes, at: int, size: int, base: int, order: str) -> float | str | None:
    """A field's value; of an array the first, unscaled by its caller; None where it is marked invalid."""
    code, invalid = BASE_TYPES[base & 0x1F] if base & 0x1F < len(BASE_TYPES) else BASE_TYPES[13]
    if code == "s":
        return data[at : at + size].split(b"\0", 1)[0].decode("latin-1") or None
    try:
        value = struct.unpack_from(order + code, data, at)[0]
    except struct.error:
        return None
    return None if value == invalid else float(value)


def is_array(size: int, base: int) -> bool:
    code = BASE_TYPES[base & 0x1F][0] if base & 0x1F < len(BASE_TYPES) else "B"
    return code != "s" and size >= 2 * struct.calcsize(code)


class Part:
    """One part of a (chained) file: its definitions, and its messages in order."""

    def __init__(self, data: bytes, start: int, end: int) -> None:
        self.data, self.at, self.end = data, start, end
        self.kinds: dict[int, tuple] = {}
        self.developer: dict[tuple[int, int], tuple[str, int]] = {}
        self.clock: int | None = None

    def byte(self) -> int:
        self.at += 1
        return self.data[self.at - 1]

    def define(self, head: int) -> None:
        self.at += 1
        order = "<" if self.byte() == 0 else ">"
        number = struct.unpack_from(order + "H", self.data, self.at)[0]
        self.at += 2
        triples = lambda n: [(self.byte(), self.byte(), self.byte()) for _ in range(n)]
        fields = triples(self.byte())
        own = triples(self.byte()) if head & 0x20 else []
        self.kinds[head & 0x0F] = (MESSAGES.get(number), order, fields, own)

    def message(self, kind: tuple) -> tuple[str | None, dict, dict]:
        name, order, fields, own = kind
        values: dict[str, float | str | None] = {}
        ranks: dict[str, int] = {}
        for number, size, base in fields:
            spec = PROFILE.get(name, {}).get(number)
            if spec:
                label, divisor, offset, rank = (*spec, *(1, 0, 0)[len(spec) - 1 :])
                value = field_value(self.data, self.at, size, base, order)
                if isinstance(value, float) and not is_array(size, base):
                    value = value / divisor - offset
                before = values.get(label)
                if label not in values or value is not None and (before is None or rank > ranks[label]):
                    values[label], ranks[label] = value, rank
            self.at += size
        extra = {}
        for number, size, source in own:
            described = self.developer.get((source, number))
            if described and (value := field_value(self.data, self.at, size, described[1], order)) is not None:
                extra[described[0]] = value
            self.at += size
        return name, values, extra

    def __iter__(self) -> Iterator[tuple[str, dict, dict]]:
        try:
            while self.at < self.end:
                head = self.byte()
                if head & 0xC0 == 0x40:
                    self.define(head)
                    continue
                packed = bool(head & 0x80)
                kind = self.kinds.get(head >> 5 & 3 if packed else head & 0x0F)
                if kind is None:
                    return
                if packed and self.clock is not None:
                    self.clock += (head - self.clock) & 0x1F
                name, values, extra = self.message(kind)
                if packed:
                    if self.clock is not None:
                        values.setdefault("timestamp", float(self.clock))
                elif isinstance(values.get("timestamp"), float):
                    self.clock = int(values["timestamp"])
                if name == "field_description":
                    key = tuple(int(values.get(k) or 0) for k in ("developer_data_index", "field_definition_number"))
                    base = values.get("fit_base_type_id")
                    self.developer[key] = (str(values.get("field_name") or f"dev_{key[0]}:{key[1]}"), 2 if base is None else int(base))
                if name:
                    yield name, values, extra
        except (IndexError, struct.error):
            return


def header(data: bytes, at: int) -> tuple[int, int] | None:
    """Size of the header at a place and of the data after it."""
    if at + 12 > len(data) or data[at] not in (12, 14) or data[at + 8 : at + 12] != b".FIT":
        return None
    return data[at], struct.unpack_from("<I", data, at + 4)[0]


def messages_of(data: bytes) -> Iterator[tuple[str, dict, dict, bool]]:
    """Messages of all parts of a file: name, fields, developer fields, whether the file ends early."""
    at, parts = 0, 0
    while (head := header(data, at)) and parts < MOST_PARTS:
        size, length = head
        stop = at + size + length
        for name, values, extra in Part(data, at + size, min(stop, len(data))):
            yield name, values, extra, stop > len(data)
        at, parts = stop + 2, parts + 1
    if not parts:
        raise FitError("no .FIT signature")


MESSAGE = "path string, seq long, message string, fields map<string,double>, texts map<string,string>, developer map<string,double>, truncated boolean"


def read_messages(spark: SparkSession, path: str, keep: tuple[str, ...] = ("record", "lap", "session", "event", "file_id", "sport", "field_description"), glob: str = "*.fit") -> DataFrame:
    """All messages of FIT files, one row each. Files that are none give one row with the message ``error``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")
    names = ["path", "seq", "message", "fields", "texts", "developer", "truncated"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.float64()), pa.map_(pa.string(), pa.string()), pa.map_(pa.string(), pa.float64()), pa.bool_()]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows: list[tuple] = []
                try:
                    for seq, (name, values, extra, cut) in enumerate(messages_of(content)):
                        if name in keep:
                            numbers = {k: v for k, v in values.items() if isinstance(v, float)}
                            texts = {k: v for k, v in values.items() if isinstance(v, str)}
                            rows.append((file, seq, name, numbers, texts, {k: v for k, v in extra.items() if isinstance(v, float)}, cut))
                except FitError as e:
                    rows.append((file, 0, "error", {}, {"message": str(e)}, {}, False))
                for a in range(0, len(rows), 10_000):
                    part = list(zip(*rows[a : a + 10_000]))
                    yield pa.RecordBatch.from_arrays([pa.array([list(v.items()) for v in c] if pa.types.is_map(k) else list(c), k) for c, k in zip(part, kinds)], names=names)

    return files.mapInArrow(decode, MESSAGE)


def rides_of(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rides, samples) of a table of FIT messages; records without a time are left out."""
    number = lambda k: F.col("fields")[k]
    records = messages.where("message = 'record'").withColumn("at", number("timestamp")).where("at is not null")
    start = records.groupBy("path").agg(F.min("at").alias("t0"))
    of = lambda kind, *columns: messages.where(F.col("message") == kind).groupBy("path").agg(*columns)
    first = lambda c: F.min_by(c, "seq")
    sport = of("sport", first(F.col("texts")["name"]).alias("_name"), first(number("sport")).alias("_sport"))
    sessions = of("session", first(F.struct(*(number(k).alias(k) for k in ("sport", "distance", "elapsed", "timer", "avg_power", "max_power", "np", "ascent", "calories")))).alias("totals"))
    device = of("file_id", first(number("manufacturer")).alias("device"))
    ends = messages.where("message = 'lap'").withColumn("at", number("timestamp")).where("at is not null").groupBy("path").agg(F.sort_array(F.collect_list("at")).alias("_ends"))
    rides = start
    for side in (sport, sessions, device, ends):
        rides = rides.join(side, "path", "left")
    file = F.regexp_extract("path", "([^/]+)$", 1)
    begin = F.col("t0") + EPOCH
    guess = name_of_file(F.url_decode(file))
    dated = F.when(guess.rlike(r"^\d+$"), F.concat(F.lit("Race "), F.date_format(F.timestamp_seconds(begin), "yyyy-MM-dd"))).otherwise(guess)
    name = F.coalesce("_name", dated)
    code = F.coalesce("totals.sport", "_sport")
    kind = F.coalesce(*(F.when(code == k, v) for k, v in SPORTS.items()), F.lit("cycling"))
    nothing: Column = F.lit(None).cast("double")
    rides = rides.withColumns({"start_time": begin, "name": name, "sport": kind, "source": F.lit("fit"), "source_id": F.lit(None).cast("string")})
    rides = rides.withColumn("ride_id", ride_id(F.col("source"), F.col("source_id"), F.col("start_time"), F.col("name")))
    laps = F.coalesce(F.transform("_ends", lambda x: x - F.col("t0")), F.array().cast("array<double>"))
    keys = rides.select("path", "ride_id", "t0")
    rides = rides.select("ride_id", "name", "source", "source_id", "start_time", "sport", *(nothing.alias(c) for c in ("ftp", "weight_kg", "cp", "w_prime")), laps.alias("lap_times"), *(nothing.alias(c) for c in ("crop_start", "crop_end", "anchor_lat", "anchor_lon")), "totals", "device", "path")
    samples = records.join(keys, "path").select("ride_id", F.row_number().over(Window.partitionBy("ride_id").orderBy("at", "seq")).cast("long").alias("seq"), (F.col("at") - F.col("t0")).alias("t"), *(number(c).alias(c) for c in CHANNELS))
    return rides, samples


def read_fit(spark: SparkSession, path: str, glob: str = "*.fit") -> tuple[DataFrame, DataFrame]:
    """(rides, samples) of FIT files under a path."""
    return rides_of(read_messages(spark, path, glob=glob))
