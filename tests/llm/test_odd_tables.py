"""Every operator on one odd table: nulls in all columns, empty and very long texts, repeated rows and ids, names that clash, and no rows at all."""

import pytest
from pyspark.sql import functions as F

from cadenza.llm import chat, common, decontam, flac, html_text, lang_id, mixing, near_dups, pii, quality, token_files

LONG = "Some words that go on and on, to no end at all. " * 8000
TEXTS = [(1, "a plain text of some words"), (1, "another text with one id"), (2, None), (3, ""), (4, LONG), (None, "no id here"), (None, None), (5, "twice"), (5, "twice"), (6, "½ \u0000 ퟿ é 漢 😀 <b>"), (7, " \t\n ")]
CLASHES = ("n_words", "media", "pcm", "p_good", "size", "taken", "spans", "mask", "component_id", "_row", "_at", "text2", "start", "held_out", "score", "url2")


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    df = df.withColumns({"lang": F.when(F.col("doc_id") > 2, "en").when(F.col("doc_id") == 1, "fr"), "source": F.when(F.col("doc_id") > 3, "s"), **{c: F.lit("clash") for c in CLASHES}})
    return common.stage(df, "odd")


def benchmark(spark):
    return spark.createDataFrame([(1, "go on and on to no end at all some words that go on and on"), (2, None), (None, "twice"), (3, "")], "item_id long, text string")


def ratings(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (4, 1, 1), (5, None, 1), (None, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "flac": lambda s, d: flac.decode_column(flac.encode_column(d)),
    "match": lambda s, d: decontam.match_benchmark(d, benchmark(s)),
    "language": lambda s, d: lang_id.predict(d, lang_id.fit(d)),
    "quality": lambda s, d: quality.score(d, quality.fit(d, ratings(s))),
    "mix": lambda s, d: mixing.mix_sources(d),
    "pii": lambda s, d: pii.detect(d, redacted=True),
    "tokens": lambda s, d: token_files.read_token_files(token_files.write_token_files(d)),
    "html": lambda s, d: html_text.extract(d, page_id="doc_id", url="source", html="text"),
    "near": lambda s, d: near_dups.near_duplicates(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_every_row_has_a_result(spark, odd, name):
    run = OPERATORS[name]
    rows = run(spark, odd).collect()
    assert len(rows) == len(TEXTS)
    ids = "page_id" if name == "html" else "doc_id"
    assert sorted(str(r[ids]) for r in rows) == sorted(str(i) for i, _ in TEXTS)
    assert sorted(map(repr, rows)) == sorted(map(repr, run(spark, odd).collect()))
    assert run(spark, odd.limit(0)).count() == 0


FILTERS = {
    "select": lambda s, d: quality.select_documents(d, quality.fit(d, ratings(s))),
    "drop": lambda s, d: near_dups.drop_near_duplicates(d),
    "cut": lambda s, d: decontam.decontaminate(d, benchmark(s), max_span=12),
    "apply": lambda s, d: mixing.apply_mix(d),
}


@pytest.mark.parametrize("name", sorted(FILTERS))
def test_filters_keep_all_columns(spark, odd, name):
    out = FILTERS[name](spark, odd)
    assert out.columns == odd.columns and out.schema.simpleString() == odd.schema.simpleString()
    rows = out.collect()
    assert rows and all(r[c] == "clash" for r in rows for c in CLASHES)
    if name == "drop":
        assert sorted(str(r["doc_id"]) for r in rows if r["text"] == "twice") == ["5"] and len(rows) == len(TEXTS) - 1
    if name == "cut":
        assert {r["doc_id"] for r in rows} >= {1, 2, 3, 6, 7, None} and 5 not in {r["doc_id"] for r in rows}
    assert FILTERS[name](spark, odd.limit(0)).count() == 0


def test_chat_of_odd_rows(spark):
    rows = [(None, None, None, None), (1, None, "user", LONG), (1, 2, "assistant", ""), (1, 2, "assistant", ""), (2, 1, "system", "alone")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("speaker", "segment", "conv", "number", "head", "body")})
    out = {(r["conv_id"], r["speaker"]): r for r in chat.rotate_perspectives(df).collect()}
    assert set(out) == {(None, "unknown"), (1, "user"), (1, "assistant")} and out[1, "assistant"]["n_target"] == 2 and len(out[1, "user"]["text"]) > len(LONG)


def test_batches_are_bounded_by_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"t": ["x" * 9_000_000, "y" * 9_000_000, None, "z" * 20_000_000, "", "w"]})
    cuts = list(common.batch_cuts(batch, 100))
    assert cuts == [(0, 1), (1, 3), (3, 4), (4, 6)] and list(common.batch_cuts(batch, 1)) == [(i, i + 1) for i in range(6)]
