"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades: 0 for bad, 1 for good but toxic, 2 for good and clean. One weight of
each hashed feature is shared by all grades; ordered thresholds part them.
Features are the words of a text, the shapes of its tokens and which share of
its 3-word stretches it has said before. The model is fitted on all ratings: they
are dealt into parts of about ``most`` ids by a hash of the id, a task fits one
part after the other, and the model is the mean of the parts' models, each
counted as often as it has ratings. A fifth of all ratings is held out from a
first such model and sets the threshold of selection.

Defined cases: null and empty texts have the bias feature only and get the
grade that it implies; texts of any length count whole; unrated, null-rated and
unmatched rows are not learned from (an unknown quality is no grade, whatever
else is known); with no ratings nothing is rejected; repeated ratings of an id
count once, with the lowest grade, and an id on several rows is learned with
the least of their texts; equal texts get equal grades, ties included; an empty
table gives no rows. ``score`` replaces columns that clash with its results,
``select_documents`` keeps all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import WORD_TABLE, batch_cuts, discard, hash64, map_arrow, packed, prefix_sums, range_sorted, stage, word_hashes
from cadenza.llm.ftrl import fit_ordinal

BUCKETS = 1 << 24
LEVELS = 3
#: Signs stand for themselves, A for capitals, a for other letters, 9 for digits.
SHAPE_TABLE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 57 if 48 <= c <= 57 else c for c in range(256))
_RUN = np.zeros(256, bool)
_RUN[[65, 97, 57]] = True
#: Buckets of the features that are not hashed.
BIAS, REPEATS, FIRST_HASHED = 0, 1, 2


def _shapes(raw: bytes) -> bytes:
    """Token shapes with runs of a letter or digit class as one."""
    x = np.frombuffer(raw.translate(SHAPE_TABLE), np.uint8)
    return x[np.concatenate([[True], (x[1:] != x[:-1]) | ~_RUN[x[1:]]])].tobytes() if len(x) else b""


def _repeated(hashes: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Share of each text's 3-word stretches that stand in it before."""
    if len(hashes) < 3:
        return np.zeros(n)
    with np.errstate(over="ignore"):
        three = hash64(hash64(hashes[:-2], 3) + hashes[1:-1], 4) + hashes[2:]
    inside = row[:-2] == row[2:]
    three, own = three[inside], row[:-2][inside]
    order = np.lexsort((three, own))
    again = (three[order][1:] == three[order][:-1]) & (own[order][1:] == own[order][:-1])
    return np.bincount(own[order][1:][again], minlength=n) / np.maximum(np.bincount(own, minlength=n), 1)


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse features of texts: rows (ascending), buckets, values."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    rows, buckets, values = [np.arange(len(texts))], [np.zeros(len(texts), np.int64)], [np.ones(len(texts))]
    for salt, encoded in ((0, [r.translate(WORD_TABLE) for r in raw]), (1, [_shapes(r) for r in raw])):
        hashes, first = word_hashes(encoded)
        row = np.repeat(np.arange(len(texts)), np.diff(first))
        total = np.diff(first)
        if not salt:
            share = _repeated(hashes, row, len(texts))
            some = np.flatnonzero(share)
            rows.append(some)
            buckets.append(np.full(len(some), REPEATS))
            values.append(4 * share[some])
        bucket = ((hashes ^ np.uint64(salt * 0x5BD1E995)) % np.uint64(BUCKETS - FIRST_HASHED)).astype(np.int64) + FIRST_HASHED
        key, count = np.unique(row * BUCKETS + bucket, return_counts=True)
        rows.append(key // BUCKETS)
        buckets.append(key % BUCKETS)
        values.append(np.sqrt(count / total[key // BUCKETS]) * 2 if salt else np.ones(len(key)))
    row, bucket, value = map(np.concatenate, (rows, buckets, values))
    order = np.argsort(row, kind="stable")
    return row[order], bucket[order], value[order]


class Model:
    """Buckets with a weight other than 0, their weights, the ordered thresholds, and the least P(grade >= 2) of documents to keep."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, cuts: np.ndarray, least: float = 0.0) -> None:
        self.buckets, self.weights, self.cuts, self.least = buckets, weights, cuts, least

    def tails(self, texts: list[str | None]) -> np.ndarray:
        """(texts, LEVELS - 1): P(grade >= 1), P(grade >= 2)."""
        return self.tails_of(*features(texts), len(texts))

    def tails_of(self, row: np.ndarray, bucket: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """Those of n texts by their features."""
        score = np.zeros(n)
        if len(self.buckets):
            at = np.minimum(np.searchsorted(self.buckets, bucket), len(self.buckets) - 1)
            hit = np.flatnonzero(self.buckets[at] == bucket)
            score += np.bincount(row[hit], value[hit] * self.weights[at[hit]], minlength=n)
        return 1 / (1 + np.exp(np.clip(self.cuts - score[:, None], -40, 40)))


def grade(quality: Column, toxic: Column) -> Column:
    """The graded rating of two 0/1 ratings; null where they do not tell it."""
    return F.when(quality == 0, 0).when(quality == 1, F.when(toxic == 1, 1).when(toxic == 0, 2))


def least_tail(tail: np.ndarray, best: np.ndarray, clean: float = 0.995) -> float:
    """The threshold on P(highest grade) by held-out ratings: above 1/2, where lower grades are likelier than
    not, the one with the fewest wrong decisions; lower if it would reject more of the highest grade than 1 - ``clean``. ``least_of`` finds it in tables."""
    order = np.argsort(tail, kind="stable")
    tail, best = tail[order], best[order]
    # rejecting the first i: the best among them, and the others that stay
    wrong = np.concatenate([[0], np.cumsum(best)]) + np.concatenate([(~best).sum() - np.cumsum(np.concatenate([[0], ~best]))])
    lost = np.concatenate([[0], np.cumsum(best)])
    wrong = np.where(lost <= (1 - clean) * best.sum(), wrong, len(tail) + 1)
    i = len(wrong) - 1 - int(np.argmin(wrong[::-1]))
    if i == 0:
        return 0.0
    return float(tail[i - 1] + (tail[i] if i < len(tail) else 1.0)) / 2


def least_of(held: DataFrame, clean: float = 0.995) -> float:
    """``least_tail`` of rows (``tail``, ``best``) over all tasks; equal tails are not parted."""
    counts = range_sorted(held.groupBy("tail").agg(F.sum(F.col("best").cast("long")).alias("best"), F.count(F.lit(1)).alias("n")), F.col("tail"))
    best, n = counts.agg(F.coalesce(F.sum("best"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    sums = prefix_sums(counts, [], [F.col("tail")], {"best_before": "best", "n_before": "n"}, "_task")
    lost, gone = F.col("best_before") + F.col("best"), F.col("n_before") + F.col("n")
    # rejecting all up to a tail: the best among them, and the others that stay
    wrong = lost + (F.lit(n - best) - (gone - lost))
    found = sums.where((lost <= (1 - clean) * best) & (wrong <= n - best)).agg(F.max(F.struct((-wrong).alias("right"), "tail"))).first()[0]
    last = found and found["tail"]
    after = counts.where(F.col("tail") > last).agg(F.min("tail")).first()[0] if found else None
    discard(counts)
    return (last + (1.0 if after is None else after)) / 2 if found else 0.0


#: What a part of the ratings gives: its models (``TRAINED`` without the ratings held out, ``WHOLE`` with them) and the features of those held out.
TRAINED, WHOLE, HELD = 0, 1, 2
PARTS = "kind int, n long, c array<int>, v array<double>, cuts array<double>"
#: Documents, rated or not, among which a task finds the rated ones.
DOCS_A_TASK = 50_000


def fit(docs: DataFrame, ratings: DataFrame, doc_id: str = "doc_id", text: str = "text", rating: Column | None = None, most: int = 6000, alpha: float = 1.0, l1: float = 10.0, l2: float = 0.1, epochs: int = 10) -> Model:
    """Fit on all ratings (``doc_id`` and ``rating``, a grade from 0 to 2), in parts of about ``most``."""
    rating = grade(F.col("quality"), F.col("toxic")) if rating is None else rating
    rated = ratings.select(F.col(doc_id).cast("long").alias("i"), rating.cast("int").alias("g")).where("i is not null and g is not null").groupBy("i").agg(F.min("g").alias("g"))
    parts = max(1, round(rated.count() / most))
    texts = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t")).where("i is not null")
    # texts are dealt once, to tasks of one part each; only where a part's rated texts lie strewn among too many others are they dealt again
    spread = max(1, -(-texts.count() // (parts * DOCS_A_TASK)))
    part = F.pmod(F.xxhash64("i", F.lit(43)), F.lit(parts))
    task = (part * spread + F.pmod(F.xxhash64("i", F.lit(44)), F.lit(spread))).cast("int")
    texts, rated = (x.withColumn("task", task).repartitionById(parts * spread, F.col("task")) for x in (texts, rated))
    dealt = texts.groupBy("task", "i").agg(F.min("t").alias("t")).join(rated.hint("merge"), ["task", "i"]).withColumn("part", part)
    if spread > 1:
        dealt = dealt.repartitionById(parts, F.col("part").cast("int"))
    dealt = dealt.select("part", "i", "t", "g").sortWithinPartitions("part", "i")

    def learned(i: list[int], g: list[int], c: list[np.ndarray], v: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        buckets, inverse = np.unique(np.concatenate(c), return_inverse=True)
        x = list(zip(np.split(inverse, np.cumsum([len(a) for a in c])[:-1]), v))
        grades = np.array(g)
        check = hash64(np.array(i, np.int64).view(np.uint64), 6) % np.uint64(5) == 0

        def out(kind: list[int], n: list[int], c: list[np.ndarray], v: list[np.ndarray], cuts: list[np.ndarray | None]) -> pa.RecordBatch:
            columns = [pa.array(kind, pa.int32()), pa.array(n, pa.int64()), pa.array(c, pa.list_(pa.int32())), pa.array(v, pa.list_(pa.float64())), pa.array(cuts, pa.list_(pa.float64()))]
            return pa.RecordBatch.from_arrays(columns, names=["kind", "n", "c", "v", "cuts"])

        for kind, own in ((TRAINED, np.flatnonzero(~check)), (WHOLE, np.arange(len(x)))):
            if len(own):
                weights, cuts = fit_ordinal([x[k] for k in own], grades[own], LEVELS, len(buckets), alpha, l1, l2, epochs)
                used = np.flatnonzero(weights)
                yield out([kind], [len(own)], [buckets[used]], [weights[used]], [cuts])
        held = np.flatnonzero(check)
        for at in range(0, len(held), 200):
            some = held[at : at + 200]
            yield out([HELD] * len(some), grades[some].tolist(), [c[k] for k in some], [v[k] for k in some], [None] * len(some))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own = None, ([], [], [], [])
        for batch in batches:
            for a, b in batch_cuts(batch, 200):
                piece = batch.slice(a, b - a)
                row, bucket, value = features(piece.column("t").to_pylist())
                first = np.searchsorted(row, np.arange(piece.num_rows + 1))
                for k, (p, i, g) in enumerate(zip(*(piece.column(c).to_pylist() for c in ("part", "i", "g")))):
                    if p != part and own[0]:
                        yield from learned(*own)
                        own = ([], [], [], [])
                    part = p
                    inside = slice(first[k], first[k + 1])
                    # kept as 32-bit numbers: a part's features are all that a task holds
                    for column, x in zip(own, (i, g, bucket[inside].astype(np.int32), value[inside].astype(np.float32))):
                        column.append(x)
        if own[0]:
            yield from learned(*own)

    done = stage(dealt.mapInArrow(learn, PARTS), "quality")

    def mean(kind: int) -> Model | None:
        """The mean model of the parts, by exact sums, so that their order does not tell."""
        n, *cuts = done.where(F.col("kind") == kind).agg(F.sum("n"), *(F.sum((F.col("cuts")[j] * F.col("n")).cast("decimal(38,18)")) for j in range(LEVELS - 1))).first()
        if not n:
            return None
        one = done.where(F.col("kind") == kind).select("n", F.explode(F.arrays_zip("c", "v")).alias("x"))
        got = one.groupBy("x.c").agg(F.sum((F.col("x.v") * F.col("n")).cast("decimal(38,18)")).cast("double").alias("v")).orderBy("c").toArrow()
        return Model(got.column("c").to_numpy().astype(np.int64), got.column("v").to_numpy() / n, np.array([float(x) / n for x in cuts]))

    model, trained = mean(WHOLE), mean(TRAINED)
    if model and trained:
        shared = docs.sparkSession.sparkContext.broadcast(trained)

        def tails(batch: pa.RecordBatch) -> pa.RecordBatch:
            c, v = batch.column("c"), batch.column("v")
            row = np.repeat(np.arange(batch.num_rows), c.value_lengths().to_numpy())
            tail = shared.value.tails_of(row, c.flatten().to_numpy(), v.flatten().to_numpy(), batch.num_rows)[:, -1]
            return pa.RecordBatch.from_arrays([pa.array(tail), pa.array(batch.column("n").to_numpy() == LEVELS - 1)], names=["tail", "best"])

        model.least = least_of(map_arrow(done.where(F.col("kind") == HELD).select("n", "c", "v"), lambda: tails, "tail double, best boolean"))
    discard(done)
    return model or Model(np.empty(0, np.int64), np.empty(0), np.array([-40.0, -40.0]))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with ``expected_grade``, ``p_good`` and ``p_clean``: the tail probabilities of grades 1 and 2."""
    names = ["expected_grade", "p_good", "p_clean"]
    kept = [c for c in docs.columns if c not in names]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            tails = own.tails(batch.column(text).to_pylist())
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(v) for v in (tails.sum(1), tails[:, 0], tails[:, 1]))], names=[*kept, *names])

        return each

    return map_arrow(docs.select(*kept), make, docs.select(*kept, *(F.lit(0.0).alias(c) for c in names)).schema, rows=200)


def select_documents(docs: DataFrame, model: Model, text: str = "text", least: float | None = None) -> DataFrame:
    """Documents whose probability of the highest grade is ``least`` or more, by default the model's own threshold."""
    rows = packed(docs).withColumn("text", F.col("_row")[text])
    return score(rows, model).where(F.col("p_clean") >= (model.least if least is None else least)).select("_row.*")
