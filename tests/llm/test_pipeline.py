"""Each stage of the corpus pipeline against plain Python on what the stage before kept."""

import random
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, "tests/llm")
from test_near_dups import brute  # noqa: E402
from test_text_operators import plain_hits, plain_words  # noqa: E402

import corpus_pipeline as pipeline  # noqa: E402
from cadenza.llm import mixing, quality, token_files  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, step in pipeline.STAGES:
        docs.append(pipeline.stage(step(spark, docs[-1], SF), "test"))
    return docs


def test_stages_keep_the_columns(stages):
    assert all(d.columns == stages[0].columns for d in stages[:-1])
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]


def test_quality_stage(spark, stages):
    model = quality.fit(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r["doc_id"] for r in stages[0].collect() if model.tails([r["text"]])[0, 1] >= model.least}
    assert {r["doc_id"] for r in stages[1].collect()} == want


def test_near_dup_stage(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    want = brute(rows, 5, 80, 100)
    assert {r["doc_id"] for r in stages[2].collect()} == {i for i, c in want.items() if i == c}


def test_decontamination_stage(spark, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {}
    for name, text in items:
        w = plain_words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            grams.setdefault(tuple(w[i : i + n]), name)
    kept = {r["doc_id"] for r in stages[3].collect()}
    for r in stages[2].collect():
        w = plain_words(r["text"])
        hit = set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
        assert (r["doc_id"] in kept) != (len(hit) > 0 and 20 * len(hit) >= len(w))
    some = random.Random(0).choice(items)
    assert plain_hits(plain_words(some[1]), [some])[0] > 0


def test_mix_stage(stages):
    mix = mixing.mix_sources(stages[3])
    words = stages[4].agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert words == mix.agg(F.sum("taken")).first()[0]


def test_token_stage_and_run(spark, stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_files.default_tokenizer())
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 2]
    key = lambda i, t: (i, len(ids(t)), zlib.crc32(np.array(ids(t), "<u4").tobytes()))
    want = sorted(key(r["doc_id"], r["text"]) for r in stages[4].collect())
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in stages[5].collect()) == want
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in pipeline.run(spark, SF).collect()) == want


CLASHES = ("size", "taken", "_id", "_row", "_at", "key", "p_good", "n_words", "component_id", "epochs")


def odd_documents(spark):
    """Documents of the driver's table, 20 rows of null id, ids with several texts, repeated rows, nulls in all columns, and columns named as ours."""
    base = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    clean = [r for r in base if r["text"] and 200 < len(r["text"]) < 2000]
    rows = base[:150]
    rows += [{**r, "doc_id": None} for r in clean[:20]]
    rows += [{**clean[30], "text": r["text"]} for r in clean[31:35]] + [clean[40]] * 3
    rows += [{"doc_id": 10_001, "text": None, "lang": None, "source": None, "n_chars": None}, {"doc_id": None, "text": "", "lang": "en", "source": None, "n_chars": 0}]
    rows += [{**clean[50], "doc_id": 10_002, "text": " ".join(r["text"] for r in clean)}]  # very long
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema.simpleString()[7:-1].replace(":", " ")
    df = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert "doc_id" in schema
    return pipeline.stage(df.withColumns({c: F.lit(i) for i, c in enumerate(CLASHES)}), "odd")


def same_rows(a, b):
    assert sorted(map(repr, a)) == sorted(map(repr, b))


def test_stages_on_odd_documents_against_plain_python(spark):
    docs = odd_documents(spark)
    columns = docs.columns
    steps = [docs]
    for name, step in pipeline.STAGES:
        steps.append(pipeline.stage(step(spark, steps[-1], SF), "odd"))
    assert all(d.columns == columns for d in steps[:-1])
    rows = [[r.asDict() for r in d.collect()] for d in steps]
    # quality: the model's word on each text alone
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    same_rows(rows[1], [r for r in rows[0] if model.tails([r["text"]])[0, 1] >= model.least])
    assert len(rows[1]) > 100 and sum(r["doc_id"] is None for r in rows[1]) > 10
    # near duplicates: one row of each group of rows; it has the group's least id
    numbered = [(i, r["text"]) for i, r in enumerate(rows[1])]
    groups = {}
    for i, c in brute(numbered, 5, 80, 100).items():
        groups.setdefault(c, []).append(rows[1][i])
    assert len(rows[2]) == len(groups)
    least = lambda g: min((r["doc_id"] for r in g if r["doc_id"] is not None), default=None)
    assert sorted(map(str, (r["doc_id"] for r in rows[2]))) == sorted(str(least(g)) for g in groups.values())
    assert all(any(r in g for g in groups.values()) for r in rows[2])
    # decontamination: rows under the limit stay; words outside hit windows of 13 stay in order
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = []
    for r in rows[2]:
        w = plain_words(r["text"])
        hit = hit_places(w, items)
        if not (hit and 20 * len(hit) >= len(w)):
            want.append((r["doc_id"], [x for i, x in enumerate(w) if i not in long_runs(hit)]))
    same_rows(want, [(r["doc_id"], plain_words(r["text"])) for r in rows[3]])
    before = {r["text"] for r in rows[2]}
    assert all(r["n_chars"] == len(r["text"]) for r in rows[3] if r["text"] not in before)
    # mixing: every source's words, and whole copies of rows but for one cut a source
    size = lambda t: len((t or "").split())
    taken = mixing.mix_sources(steps[3]).groupBy("source").agg(F.sum("taken").alias("n")).collect()
    got = {}
    for r in rows[4]:
        got[r["source"]] = got.get(r["source"], 0) + size(r["text"])
    assert {r["source"]: r["n"] for r in taken if r["n"]} == got
    whole = {repr({**r, "n_chars": None}) for r in rows[3]}
    cut = [r for r in rows[4] if repr({**r, "n_chars": None}) not in whole]
    assert len(cut) <= len(got) and all(any((s["text"] or "").startswith(r["text"]) and s["doc_id"] == r["doc_id"] for s in rows[3]) for r in cut)
    # all again: nothing changes but, among equal rows, their order
    again = docs
    for (name, step), first in zip(pipeline.STAGES, rows[1:]):
        again = pipeline.stage(step(spark, again, SF), "odd")
        same_rows([r.asDict() for r in again.collect()], first)


def hit_places(words, items, window=13):
    grams = {}
    for _, text in items:
        w = plain_words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            grams.setdefault(n, set()).add(tuple(w[i : i + n]))
    return {p for n, known in grams.items() for i in range(len(words) - n + 1) if tuple(words[i : i + n]) in known for p in range(i, i + n)}


def long_runs(places, least=13):
    out, run = set(), []
    for p in sorted(places) + [-1]:
        if run and p != run[-1] + 1:
            out |= set(run) if len(run) >= least else set()
            run = []
        run.append(p)
    return out


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, step in pipeline.STAGES:
        docs = pipeline.stage(step(spark, docs, SF), "empty")
        assert docs.count() == 0
