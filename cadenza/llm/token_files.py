"""Token ids in Arrow files of fixed-size lists.

Documents are range-partitioned and sorted by id; each partition becomes one
shard: an Arrow IPC file whose record batches hold ``ids: fixed_size_list[L]``
and ``mask: fixed_size_list<bool>[L]``, and next to it an Arrow file with the
place of each document. All rows have equal length, so sequence ``i`` of a
memory-mapped shard is found by division and read without a copy. The
last row of a shard is padded, with its mask off.

Ids are written as unsigned 16-bit numbers where the vocabulary allows it,
else as 32-bit ones. Every attempt of a task writes files of its own names;
only those of the attempt that Spark commits are listed in the shard table.

Defined cases: null and empty texts have the end id only; texts of any length
are encoded whole; documents with equal ids, repeated rows among them, all
stand, ordered by a hash of their text; a null id comes first; an empty table
makes no shard; only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import LOWER_TABLE, batch_cuts, new_folder, stage

BATCH_ROWS = 512
#: Words that a worker keeps with their ids, about 200 bytes each.
CACHE_WORDS = 1_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable
    Latin-1 bytes for themselves, the others from U+0100 on in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Encoder(dict):
    """Ids of texts by a tokenizer of the ``tokenizers`` library that drops
    white space and lower-cases; a store of parts met before, by their bytes.

    Only a tokenizer that is defined by FAST (and a BPE model without chance)
    takes this way; any other encodes whole texts by the library. Such a one
    never joins what white space parts, so a text's ids are those of its parts. A part of Latin letters, digits and ASCII signs without
    apostrophes falls into runs of letters, single digits and runs of signs,
    which its pre-tokenizer and normaliser leave as they are: these go straight
    to the library's model. Other parts go to the library, and so do whole
    texts that may hold added tokens.
    """

    #: The pieces of the tokenizer's own pattern, as far as ASCII signs and Latin letters go.
    PIECE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
    SIMPLE = re.compile(f"(?:{PIECE.pattern})+")
    #: The normaliser and pre-tokenizer that the short way stands for.
    FAST = {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
    }

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        spec = json.loads(self.library.to_str())
        self.fast = all(spec[k] == v for k, v in self.FAST.items()) and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
        self.vocab_size = self.library.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.vocab_size <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.added = [t.content.encode().lower() for t in self.library.get_added_tokens_decoder().values()]
        self.marks = {t[:2] for t in self.added}
        self.letters = dict(enumerate(byte_letters()))

    def __missing__(self, part: bytes) -> bytes:
        text = part.decode("utf-8").lower()
        if not self.SIMPLE.fullmatch(text):
            ids = self._library(part.decode("utf-8"))
        elif len(pieces := self.PIECE.findall(text)) > 1:
            ids = b"".join([self[x.encode()] for x in pieces])
        else:
            ids = array(self.code, [t.id for t in self.model.tokenize(text if text.isascii() else text.encode().decode("latin-1").translate(self.letters))]).tobytes()
        self[part] = ids
        return ids

    def _library(self, text: str) -> bytes:
        return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes of ``dtype``."""
        out = []
        for text in texts:
            if len(self) > CACHE_WORDS:
                self.clear()
            if not self.fast:
                out.append(self._library(text or ""))
                continue
            raw = (text or "").encode("utf-8", "replace").translate(LOWER_TABLE)
            if any(m in raw for m in self.marks) and any(a in raw for a in self.added):
                out.append(self._library(text))
            else:
                out.append(b"".join(map(self.__getitem__, raw.split())))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"[a-z][a-z0-9+.-]+:", uri) and not uri.startswith("file:"):
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), unquote(urlparse(uri).path) if uri.startswith("file:") else uri


def open_shard(uri: str) -> pa.RecordBatchFileReader:
    """A reader of a shard; memory-mapped where the file is local."""
    fs, path = _file_system(uri)
    return pa.ipc.open_file(pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path))


def read_sequence(shard: pa.RecordBatchFileReader, i: int, batch_rows: int = BATCH_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Sequence i of a shard and its mask; the ids are a view of the file."""
    batch, row = shard.get_batch(i // batch_rows), i % batch_rows
    width = batch.schema.field("ids").type.list_size
    ids = batch.column("ids").flatten().slice(row * width, width)
    return ids.to_numpy(zero_copy_only=True), batch.column("mask").flatten().slice(row * width, width).to_numpy(zero_copy_only=False)


class _ShardWriter:
    """Fills rows of ``length`` ids and writes them batch by batch."""

    def __init__(self, uri: str, length: int, dtype: np.dtype, pad: int) -> None:
        self.fs, path = _file_system(uri)
        if isinstance(self.fs, pafs.LocalFileSystem):
            self.fs.create_dir(os.path.dirname(path), recursive=True)
        self.length, self.pad, self.dtype = length, pad, dtype
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = self.fs.open_output_stream(path)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[bytes] = []
        self.n = self.rows = 0
        self.most = BATCH_ROWS * length

    def _write(self, ids: np.ndarray, real: int) -> None:
        lists = pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length)
        mask = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(ids)) < real), self.length)
        self.writer.write_batch(pa.RecordBatch.from_arrays([lists, mask], schema=self.schema))
        self.rows += len(ids) // self.length

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.n += len(ids) // self.dtype.itemsize
        if self.n >= self.most:
            every = np.frombuffer(b"".join(self.held), self.dtype)
            full = len(every) // self.most * self.most
            for at in range(0, full, self.most):
                self._write(every[at : at + self.most], self.most)
            self.held, self.n = [every[full:].tobytes()], len(every) - full

    def close(self) -> None:
        every = np.frombuffer(b"".join(self.held), self.dtype)
        if len(every):
            self._write(np.concatenate([every, np.full(-len(every) % self.length, self.pad, self.dtype)]), len(every))
        self.writer.close()
        self.sink.close()


SHARDS = "shard int, path string, n_docs long, n_tokens long, n_rows long"
DOCS = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("n_tokens", pa.int64())])


def write_token_files(docs: DataFrame, folder: str | None = None, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 2, length: int = 1024, pad_id: int = 0) -> DataFrame:
    """Write shards under ``folder`` (by default a new one in the shared
    folder) and return the table of shards in ascending order of ids:
    ``shard, path, n_docs, n_tokens, n_rows, start``."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    tokenizer = tokenizer or default_tokenizer()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(tokenizer)
        end = np.array([end_id], tok.dtype).tobytes()
        task = TaskContext.get()
        name = f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}"
        shard, places, place, n_docs = None, None, 0, 0
        for batch in batches:
            for a, b in batch_cuts(batch, 500):
                part = batch.slice(a, b - a)
                if shard is None:
                    shard = _ShardWriter(f"{name}.arrow", length, tok.dtype, pad_id)
                    sink = shard.fs.open_output_stream(_file_system(f"{name}.docs.arrow")[1])
                    places = pa.ipc.new_file(sink, DOCS)
                sizes = []
                for ids in tok.encode(part.column("text").to_pylist()):
                    shard.add(ids + end)
                    sizes.append((len(ids) + len(end)) // tok.dtype.itemsize)
                starts = place + np.cumsum([0, *sizes])
                place = int(starts[-1])
                n_docs += len(sizes)
                places.write_batch(pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(starts[:-1], pa.int64()), pa.array(sizes, pa.int64())], schema=DOCS))
        if shard is not None:
            shard.close()
            places.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([task.partitionId()], pa.int32()), "path": [f"{name}.arrow"], "n_docs": [n_docs], "n_tokens": [place], "n_rows": [shard.rows]})

    shards = stage(rows.mapInArrow(write, SHARDS), "shards")
    # one row a shard, however many documents
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def read_token_files(shards: DataFrame) -> DataFrame:
    """Each document from the files: ``doc_id, start, n_tokens, ids_crc32`` —
    the number of ids before it in all shards, its ids and their CRC-32 as
    little-endian 32-bit numbers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _read_shard(row["path"], row["start"])

    n = max(1, min(shards.count(), 100_000))
    return shards.repartition(n, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _read_shard(path: str, start: int) -> Iterator[pa.RecordBatch]:
    shard = open_shard(path)
    views: dict[int, np.ndarray] = {}

    def view(i: int) -> np.ndarray:
        if i not in views:
            if len(views) > 4:
                views.pop(next(iter(views)))
            views[i] = shard.get_batch(i).column("ids").flatten().to_numpy(zero_copy_only=True)
        return views[i]

    width = shard.schema.field("ids").type.list_size * BATCH_ROWS
    places = open_shard(re.sub(r"\.arrow$", ".docs.arrow", path))
    for i in range(places.num_record_batches):
        docs = places.get_batch(i)
        sums = []
        for at, n in zip(docs.column("place").to_numpy().tolist(), docs.column("n_tokens").to_numpy().tolist()):
            value, end = 0, at + n
            while at < end:
                stop = min(end, (at // width + 1) * width)
                value = zlib.crc32(view(at // width)[at % width : at % width + stop - at].astype("<u4").tobytes(), value)
                at = stop
            sums.append(value)
        yield pa.RecordBatch.from_arrays([docs.column("doc_id"), pa.array(docs.column("place").to_numpy() + start, pa.int64()), docs.column("n_tokens"), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
