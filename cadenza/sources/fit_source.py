"""FIT files as a data source: ``spark.read.format("fit").load(folder)``.

One partition a file. A file's messages are decoded one after the other and sent in batches, so no task holds more than the
file's bytes and a batch. The option ``messages`` names those that are kept (``record,lap``); a schema given to the reader
names the columns that are made; by default these are all numbers and texts of the profile, and developer fields by name.
Filters are not pushed by themselves: Spark 4.1 keeps what it once pushed to a Python source for every later query on the
same DataFrame, which would then lack rows.

The files are opened by workers, from any store that Arrow's file systems know. ``fit.read_messages`` reads those that only
Spark can open.

Defined cases: what is no FIT file is one row of the message ``error``; a file that ends early gives the messages before its
end, marked ``truncated``; chained parts follow each other; a folder without files gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fnmatch import fnmatch
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, MapType, StringType, StructType

from cadenza.sources.fit import PROFILE, FitError, messages_of

TEXTS = ("product_name", "name", "field_name", "units")
NUMBERS = tuple(dict.fromkeys(spec[0] for fields in PROFILE.values() for spec in fields.values() if spec[0] not in TEXTS))
SCHEMA = "path string, seq long, message string, truncated boolean, " + ", ".join(f"`{n}` double" for n in NUMBERS) + ", " + ", ".join(f"{n} string" for n in TEXTS) + ", developer map<string,double>, error string"
ROWS = 10_000


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"[a-z][a-z0-9+.-]+:", uri) and not uri.startswith("file:"):
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), unquote(urlparse(uri).path) if uri.startswith("file:") else uri


class FitReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.uri, self.glob, self.schema = options["path"], options.get("pathGlobFilter", "*.fit"), schema
        self.messages = set(options["messages"].replace(" ", "").split(",")) if "messages" in options else None

    def partitions(self) -> list[InputPartition]:
        files, path = _store(self.uri)
        info = files.get_file_info(path)
        found = [info] if info.type == pafs.FileType.File else files.get_file_info(pafs.FileSelector(path, recursive=True))
        names = sorted(f.path for f in found if f.type == pafs.FileType.File and fnmatch(f.base_name.lower(), self.glob.lower()))
        return [InputPartition(p) for p in names] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path = partition.value
        if path is None:
            return
        schema = to_arrow_schema(self.schema)
        with _store(self.uri)[0].open_input_stream(path) as stream:
            data = stream.read()
        rows: list[dict] = []
        try:
            for seq, (message, values, extra, cut) in enumerate(messages_of(data)):
                if self.messages is None or message in self.messages:
                    rows.append({"path": path, "seq": seq, "message": message, "truncated": cut, "values": values, "developer": extra})
                    if len(rows) == ROWS:
                        yield self._batch(rows, schema)
                        rows = []
        except FitError as e:
            if self.messages is None or "error" in self.messages:
                rows.append({"path": path, "seq": 0, "message": "error", "truncated": False, "values": {}, "developer": {}, "error": str(e)})
        if rows:
            yield self._batch(rows, schema)

    def _batch(self, rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
        columns = []
        for field, kind in zip(self.schema.fields, schema):
            if isinstance(field.dataType, MapType):
                values = [[(k, v) for k, v in r["developer"].items() if isinstance(v, float)] for r in rows]
            elif field.name in ("path", "seq", "message", "truncated", "error"):
                values = [r.get(field.name) for r in rows]
            else:
                wanted = float if isinstance(field.dataType, DoubleType) else str if isinstance(field.dataType, StringType) else object
                values = [v if isinstance(v := r["values"].get(field.name), wanted) else None for r in rows]
            columns.append(pa.array(values, kind.type))
        return pa.RecordBatch.from_arrays(columns, schema=schema)


class FitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fit"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FitReader:
        return FitReader(self.options, schema)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(FitSource)
