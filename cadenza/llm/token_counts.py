"""Token counts by a whole-token shortcut.

A SentencePiece BPE model joins two symbols only where its vocabulary has what
they make. So a text falls apart, without any change of its tokens, wherever no
vocabulary string could reach across: before a blank that follows something
else, and around line feeds. That is read off the vocabulary (``prove``), not
assumed; a model for which it does not hold gets whole texts.

Each such part either is a vocabulary string that was proved to encode alone as
one token, and is counted by looking it up, or is given to the library to be
merged. Nothing is shuffled.

Defined cases: null and empty texts have no tokens; texts of any length are
counted whole, in stretches; strings of special tokens inside texts are text,
as the library takes them; bytes that are no UTF-8 are counted as the library
does; repeated rows and null ids have rows of their own; an empty table gives
no rows; only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import batch_cuts

#: What the model writes for a blank.
BLANK = "▁"
#: A run of blanks and what follows it, or a line feed and what follows it.
PARTS = re.compile(rb" +[^ \n]*|\n[^ \n]*")
#: Bytes of a text that are split at once; a stretch ends before a blank that follows something else.
STRETCH = 1 << 20
EDGE = re.compile(rb"(?<=[^ ]) ")
#: Merged parts that a task keeps with their counts, and the longest of them in bytes.
CACHE_PARTS, CACHE_BYTES = 300_000, 64


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def library(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


def prove(path: str) -> dict[bytes, int] | None:
    """Tokens of each part that is a vocabulary string and encodes alone: one, and one for the line feed if it begins with one.

    None if texts of this model may not be split: if a vocabulary string holds a blank after something else, or a
    line feed, or if the model changes texts before encoding them (but for the blank that it puts in front).
    """
    model = library(path)
    strings = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    kept = " a  bﬁＡ① É\t\r\n\x00 \n  <s> "
    if any("\n" in s or BLANK in s.lstrip(BLANK) for s in strings) or model.normalize(kept) != BLANK + kept.replace(" ", BLANK) or any("\n" in s for s in model.encode("a\nb", out_type=str)):
        return None
    feed = len(model.encode("\n\n")) - len(model.encode("\n"))
    blank = len(model.encode("\n")) - feed
    whole = {b" ": blank, b"\n": feed}
    for text, tokens in zip(strings, model.encode([s.removeprefix(BLANK).replace(BLANK, " ") if s.startswith(BLANK) else "\n" + s for s in strings])):
        raw = text.replace(BLANK, " ").encode()
        if text.startswith(BLANK):
            if len(tokens) == 1:
                whole[raw] = 1
        elif len(tokens) == blank + feed + 1:
            whole[b"\n" + raw] = feed + 1
    return whole


class Counts(dict):
    """Tokens of parts: the proved ones, and those that the library merged and that are short enough to keep."""

    def __init__(self, path: str, whole: dict[bytes, int] | None) -> None:
        super().__init__(whole or {})
        self.model, self.whole = library(path), whole
        self.most = len(self) + CACHE_PARTS

    def __missing__(self, part: bytes) -> int:
        if part[:1] == b"\n":
            n = len(self.model.encode(part)) - self.whole[b" "]
        else:
            n = len(self.model.encode(part[1:]))  # the library puts the first blank in front
        if len(part) <= CACHE_BYTES:
            self[part] = n
        return n

    def count(self, text: bytes | None) -> int:
        if not text:
            return 0
        if self.whole is None:
            return len(self.model.encode(text))
        if len(self) > self.most:
            self.clear()
            self.update(self.whole)
        text = b" " + text.replace(BLANK.encode(), b" ")
        total = at = 0
        while at < len(text):
            edge = EDGE.search(text, at + STRETCH)
            end = edge.start() if edge else len(text)
            total += sum(map(self.__getitem__, PARTS.findall(text, at, end)))
            at = end
        return total


def count_tokens(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", model: str | None = None, limit: int = 4096) -> DataFrame:
    """Bytes and tokens of every text, and whether it has more than ``limit`` tokens: ``(doc_id, n_bytes, n_tokens, over_limit)``.

    ``model`` is the path of a SentencePiece model, on every executor. What the driver proves once is broadcast; it
    has at most one entry for each vocabulary string.
    """
    path = model or default_model()
    whole = docs.sparkSession.sparkContext.broadcast(prove(path))
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(path, whole.value)
        for batch in batches:
            for a, b in batch_cuts(batch, 1000):
                texts = batch.column(1).slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(t.as_py() or b"") for t in texts], pa.int64()), pa.array([counts.count(t.as_py()) for t in texts], pa.int64())],
                    ["doc_id", "n_bytes", "n_tokens"],
                )

    rows = docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`").cast("binary")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
