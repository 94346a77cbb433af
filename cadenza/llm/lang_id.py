"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Document frequencies come from all documents of the learning fold. The
regression is fitted by follow-the-regularised-leader with elastic-net
penalties on a bounded sample of them (``per_language`` expected documents of
each language, by a hash of id and text; equal ones of a language count once
there), and calibrated by a temperature on a fifth of that sample.

Defined cases: a null text or one without letters (Unicode's L categories) is
``und`` with score 0; rows with a null label or a null id are predicted but not
learned from; with no labelled rows every language is ``und``; an empty table
gives no rows; texts of any length count whole; repeated rows have equal
predictions; of equally likely languages the first by name wins; only the
named columns are read, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import batch_cuts, hash64, map_arrow
from cadenza.llm.ftrl import fit_multinomial, softmax, temperature

BUCKETS = 1 << 15
_MIX = hash64(np.arange(3, dtype=np.uint64), 11).astype(np.uint32) | np.uint32(1)


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 1- to 3-grams of lower-cased characters and how often each occurs."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    with np.errstate(over="ignore"):
        one = (c + np.uint32(1)) * _MIX[0]
        two = (one[:-1] ^ one[:-1] >> np.uint32(15)) * _MIX[1] + one[1:]
        three = (two[:-1] ^ two[:-1] >> np.uint32(13)) * _MIX[2] + one[2:]
    counts = np.zeros(BUCKETS, np.int64)
    for x in (one, two, three):
        with np.errstate(over="ignore"):
            x = (x ^ x >> np.uint32(16)) * np.uint32(0x45D9F3B)
        counts += np.bincount(x >> np.uint32(17), minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, counts[found]


def tf_idf(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, count = ngram_counts(text)
    value = np.log1p(count) * idf[found]
    return found, value / max(1e-12, float(np.sqrt(value @ value)))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


class Model:
    """Languages, IDF, weights (buckets, languages) and temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, heat: float) -> None:
        self.languages, self.idf, self.weights, self.heat = languages, idf.astype(np.float32), weights.astype(np.float32), heat

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0
        found, value = tf_idf(text, self.idf)
        p = softmax((value @ self.weights[found]).astype(np.float64) / self.heat)
        best = int(np.argmax(p))
        return self.languages[best], float(min(1.0, p[best]))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 500, held_out: int = 2, alpha: float = 1.0, l1: float = 0.05, l2: float = 1.0, epochs: int = 4) -> Model:
    """Learn from rows outside the fold ``held_out``; ``per_language`` bounds the expected sample of each language."""
    rows = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    rows = rows.where(F.col("l").isNotNull() & F.col("t").isNotNull() & (fold(F.col("i")) != held_out))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, by_lang, n = np.zeros(BUCKETS, np.int64), {}, 0
        for batch in batches:
            for t, name in zip(batch.column("t").to_pylist(), batch.column("l").to_pylist()):
                total[ngram_counts(t)[0]] += 1
                by_lang[name] = by_lang.get(name, 0) + 1
                n += 1
        found = np.flatnonzero(total)
        names = [""] * len(found) + list(by_lang)
        yield pa.RecordBatch.from_arrays([pa.array([*found.tolist(), *[-1] * len(by_lang)], pa.int32()), pa.array(names), pa.array([*total[found].tolist(), *by_lang.values()], pa.int64())], names=["bucket", "lang", "n"])

    # at most BUCKETS rows and one for each language reach the driver
    sums = rows.select("t", "l").mapInArrow(frequencies, "bucket int, lang string, n long").groupBy("bucket", "lang").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    frequency, sizes = np.zeros(BUCKETS), {}
    for bucket, name, n in zip(*(sums[c] for c in ("bucket", "lang", "n"))):
        if bucket < 0:
            sizes[name] = n
        else:
            frequency[bucket] = n
    idf = np.log((1 + sum(sizes.values())) / (1 + frequency)) + 1
    languages = sorted(sizes)
    if not languages:
        return Model([], idf, np.zeros((BUCKETS, 0)), 1.0)
    share = F.create_map(*(F.lit(x) for name in languages for x in (name, min(1.0, per_language / sizes[name]))))
    draw = F.pmod(F.xxhash64("i", "t", F.lit(41)), F.lit(1 << 30)) / F.lit(1 << 30)
    # a row that is repeated all over is drawn with all its copies, so these are made one before they leave their tasks
    sample = rows.where(draw < share[F.col("l")]).dropDuplicates(["i", "l", "t"]).select("i", "l", "t")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in batch_cuts(batch, 200):
                part = batch.slice(a, b - a)
                x = [tf_idf(t, idf) for t in part.column("t").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("i"), part.column("l"), pa.array([c.astype(np.int32).tobytes() for c, _ in x], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in x], pa.binary())], names=["i", "l", "c", "v"])

    got = sample.mapInArrow(features, "i long, l string, c binary, v binary").toArrow().sort_by([("i", "ascending"), ("l", "ascending"), ("c", "ascending"), ("v", "ascending")]).to_pydict()
    x = [(np.frombuffer(c, np.int32), np.frombuffer(v, np.float32).astype(np.float64)) for c, v in zip(got["c"], got["v"])]
    y = np.array([languages.index(name) for name in got["l"]], np.int64)
    check = hash64(np.array(got["i"], np.int64).view(np.uint64), 5) % np.uint64(5) == 0
    keep = np.flatnonzero(~check)
    weights = fit_multinomial([x[i] for i in keep], y[keep], len(languages), BUCKETS, alpha, l1, l2, epochs).T
    logits = np.array([v @ weights[c] for (c, v), out in zip(x, check) if out]).reshape(-1, len(languages))
    return Model(languages, idf, weights, temperature(logits, y[check]))


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", held_out: int = 2) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [own.predict(t) for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

        return each

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(fold(F.col(doc_id)) == held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    return map_arrow(rows, make, rows.select("doc_id", "held_out", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema, rows=500)
