"""Held-out accuracy of the classifiers, personal data against plain patterns, tokens against the library, pages."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import html_text, lang_id, pii, quality, token_files
from cadenza.llm.ftrl import temperature
from cadenza.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_on_the_held_out_fold(spark, docs):
    out = QUERIES["op3_language"](spark, SF).join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id").collect()
    held = [r for r in out if r["held_out"] and r["lang"] and r["n"] and r["n"] > 40]
    assert len(held) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)


def test_language_query_against_plain_python(spark):
    """Document frequencies by counting strings, and each prediction by itself, over the whole table."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    learned = [r for r in rows.values() if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    seen = np.zeros(lang_id.BUCKETS)
    for r in learned:
        t = f" {r['text'].lower()} "
        # a text's buckets are those of its n-grams, each by itself (blanks stand around a text)
        seen[sorted({int(b) for b in lang_id.ngram_counts(r["text"])[0]})] += 1
        assert lang_id.ngram_counts(r["text"])[1].sum() == 3 * len(t) - 3
    model = lang_id.fit(docs)
    assert np.allclose(model.idf, np.log((1 + len(learned)) / (1 + seen)) + 1, rtol=1e-6)
    got = QUERIES["op3_language"](spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        name, score = model.predict(rows[r["doc_id"]]["text"])
        assert r["lang_pred"] == name and abs(r["score"] - score) < 1e-9


@pytest.mark.parametrize("text", ["½ ² Ⅷ ①", "123 !?", "", None, "  "])
def test_texts_without_letters(text):
    model = lang_id.Model(["en"], np.ones(lang_id.BUCKETS), np.ones((lang_id.BUCKETS, 1)), 1.0)
    assert model.predict(text) == ("und", 0.0) and model.predict("é")[0] == "en"


def test_language_sample_is_bounded_where_rows_repeat(spark):
    one = spark.range(3000).select(F.lit(4).cast("long").alias("doc_id"), F.lit("the same words again").alias("text"), F.lit("en").alias("lang"))
    docs = one.union(spark.createDataFrame([(i, f"nous avons vu {i}", "fr") for i in range(40)], "doc_id long, text string, lang string"))
    model = lang_id.fit(docs, per_language=100_000)
    assert {r["lang_pred"] for r in lang_id.predict(docs, model).where("doc_id > 4").collect()} == {"fr"}


def test_quality_query_against_plain_python(spark):
    """Each document's grade by itself: weights added up over a dictionary of its features."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist()))
    got = {r["doc_id"]: r for r in QUERIES["op4_quality"](spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        _, buckets, values = quality.features([r["text"]])
        score = sum(weight.get(int(b), 0.0) * v for b, v in zip(buckets, values))
        good, clean = (1 / (1 + np.exp(c - score)) for c in model.cuts)
        assert abs(got[r["doc_id"]]["expected_grade"] - good - clean) < 1e-6 and got[r["doc_id"]]["kept"] == (clean >= model.least)


@pytest.mark.parametrize(("q", "t", "want"), [(0, 0, 0), (0, 1, 0), (0, None, 0), (1, 0, 2), (1, 1, 1), (1, None, None), (None, 1, None), (None, 0, None)])
def test_grades(spark, q, t, want):
    df = spark.createDataFrame([(q, t)], "q int, t int")
    assert df.select(quality.grade(F.col("q"), F.col("t"))).first()[0] == want


def test_threshold_of_selection():
    rng = np.random.default_rng(3)
    best = rng.random(4000) < 0.76
    tail = np.clip(np.where(best, rng.normal(0.95, 0.05, 4000), rng.normal(0.3, 0.2, 4000)), 0, 1)
    least = quality.least_tail(tail, best)
    assert (tail[best] >= least).mean() >= 0.995 and (tail[~best] >= least).mean() < 0.1
    assert quality.least_tail(np.array([]), np.array([], bool)) == 0.0


def test_repeated_stretches():
    texts = ["a b c a b c", "one two three four", "x " * 50, "", None]
    values = [quality.features([t]) for t in texts]
    share = [dict(zip(b.tolist(), v.tolist())).get(quality.REPEATS, 0.0) / 4 for _, b, v in values]
    assert share[0] == pytest.approx(1 / 4) and share[1] == 0 and share[2] == pytest.approx(47 / 48) and share[3] == share[4] == 0


def test_language_cases(spark, docs):
    rows = [(1, None, "de"), (2, "", "de"), (3, "123 !?", None), (4, "hello", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = lang_id.fit(docs)
    out = {r["doc_id"]: r for r in lang_id.predict(df, model).collect()}
    assert [out[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and out[4]["lang_pred"] in model.languages
    bare = lang_id.fit(df.where("lang is null"))
    assert {r["lang_pred"] for r in lang_id.predict(df, bare).collect()} == {"und"}
    assert lang_id.predict(df.limit(0), model).count() == 0
    assert (model.weights == 0).mean() > 0.3  # the l1 penalty leaves the weights sparse


def test_temperature_cools_overconfident_scores():
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 3, 400)
    logits = 8.0 * (np.eye(3)[np.where(rng.random(400) < 0.7, labels, (labels + 1) % 3)])
    assert temperature(logits, labels) > 2


def test_quality_orders_the_ratings(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    model = quality.fit(docs, labels.where(half))
    assert (np.diff(model.cuts) > 0).all()
    out = quality.score(docs, model).join(labels.where(~half), "doc_id").collect()
    good, bad = ([r["p_good"] for r in out if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert all(r["p_clean"] <= r["p_good"] and abs(r["expected_grade"] - r["p_good"] - r["p_clean"]) < 1e-9 for r in out)
    kept = quality.select_documents(docs, model)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_quality_fit_shuffles_texts_once(spark, docs, monkeypatch):
    """Texts go to the tasks of their parts at once; a second deal, where few documents are rated, gives the same model."""
    labels, plans, staged = spark.read.parquet(f"{SF}/labels.parquet"), [], quality.stage
    monkeypatch.setattr(quality, "stage", lambda df, tag: plans.append(df._jdf.queryExecution().executedPlan().toString()) or staged(df, tag))
    one = quality.fit(docs, labels, most=100)
    assert plans[0].index("SortMergeJoin") < plans[0].index("Exchange")
    monkeypatch.setattr(quality, "DOCS_A_TASK", 50)
    plans.clear()
    two = quality.fit(docs, labels, most=100)
    assert plans[0].index("SortMergeJoin") > plans[0].index("Exchange")
    assert all((getattr(one, c) == getattr(two, c)).all() for c in ("buckets", "weights", "cuts")) and one.least == two.least


def test_quality_cases(spark):
    docs = spark.createDataFrame([(1, "good words here"), (2, None), (3, ""), (1, "good words here"), (4, "x" * 300_000)], "doc_id long, text string").withColumn("p_good", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, None), (9, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.score(docs, quality.fit(docs, labels)).count() == 5
    nothing = quality.fit(docs, labels.limit(0))
    assert quality.select_documents(docs, nothing).count() == 5
    assert quality.score(docs.limit(0), nothing).count() == 0


TEXT = "mail a.b+c@x-y.co.uk, @x.y, a@b ip 10.0.0.1 999.1.1.1 1.2.3.4.5 card 4111 1111 1111 1111 or 4111-1111-1111-1112 tel +44 (20) 7946-0958 +1 é 😀 d@e.fr +12345678901234567"


def plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    cards = ((m, re.sub("[ -]", "", m[0])) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text))
    out += [("card", *m.span()) for m, d in cards if 13 <= len(d) <= 19 and pii.luhn(d)]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


@pytest.mark.parametrize("text", [TEXT, "", "a@b.c@d.e x@y.z.", "1" * 50 + ".2.3.4", "0" * 16, "a@@b.c", "+1--------9"])
def test_base_spans_against_plain_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_personal_data_over_all_documents(spark, docs):
    rows = QUERIES["op7_pii"](spark, SF).join(docs.select("doc_id", "text"), "doc_id").collect()
    for r in rows:
        base = plain_spans(r["text"] or "")
        assert r["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r["spans"].split(","))
        assert r["n_email"] == sum(k == "email" for k, _, _ in base)


def test_trees_tell_loose_candidates_apart():
    trees, thresholds = pii.trained()
    rows = pii._examples(600, 99)
    x, y = np.array([pii.candidate_features(*r[:4]) for r in rows]), np.array([r[4] for r in rows])
    chosen = trees.predict(x) >= np.array([thresholds[r[1]] for r in rows])
    assert (chosen & y).sum() / chosen.sum() > 0.9 and (chosen & y).sum() / y.sum() > 0.7


def test_redaction(spark):
    df = spark.createDataFrame([(1, "write to a@b.de now"), (2, None), (3, "")], "doc_id long, text string").withColumn("spans", F.lit("clash"))
    out = {r["doc_id"]: r for r in pii.detect(df, redacted=True).collect()}
    assert out[1]["redacted"] == "write to [EMAIL] now" and out[2]["spans"] == "" and out[3]["n_card"] == 0
    assert pii.detect(df.limit(0)).count() == 0


def test_token_query_against_the_library(spark):
    """Place, length and checksum of every document in the files of the query."""
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(token_files.default_tokenizer())
    start, want = 0, {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want[r["doc_id"]] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = QUERIES["op8_token_files"](spark, sf).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got} == want


def test_other_tokenizers_go_by_the_library(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    other = Tokenizer(models.WordLevel({"[UNK]": 0, "A": 1, "a": 2, "b": 3}, unk_token="[UNK]"))
    other.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    other.save(str(tmp_path / "other.json"))
    assert np.frombuffer(token_files.Encoder(str(tmp_path / "other.json")).encode(["A a b c"])[0], "<u2").tolist() == [1, 2, 3, 0]


def test_tokens_against_the_library(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_files.default_tokenizer())
    extra = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "It's <|endoftext|> İstanbul ﬁ ½ don't Ǆ 😀 x"), (10**6 + 3, "ab c d\x85e 'S é1ß <|START"), (10**6 + 3, "tie")]
    every = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    shards = token_files.write_token_files(every, length=128)
    out = sorted(token_files.read_token_files(shards).collect(), key=lambda r: (r["start"]))
    texts = {}
    for r in every.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    at, seen = 0, set()
    for r in out:
        ids = [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts[r["doc_id"]]]
        match = [x for x in ids if (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) == (r["n_tokens"], r["ids_crc32"])]
        assert match and r["start"] == at
        at += r["n_tokens"]
        seen.add(r["doc_id"])
    assert len(out) == every.count() and [r["doc_id"] for r in out] == sorted(r["doc_id"] for r in out)
    path = shards.orderBy("shard").first()["path"]
    shard = token_files.open_shard(path)
    ids, mask = token_files.read_sequence(shard, 1)
    assert len(ids) == 128 and mask.all() and ids.base is not None
    assert token_files.read_token_files(token_files.write_token_files(every.limit(0))).count() == 0


PAGES = [
    ("<html><head><title>no</title></head><body><nav>menu</nav><article><h1>Title</h1><p>One &amp; two\n three.</p><aside>ad</aside><p>Four<br>five</p></article><footer>foot</footer></body></html>", "Title\n\nOne & two three.\n\nFour five"),
    ("<body><div class='cookie-banner'>We use cookies</div><div><p>" + "Long text here. " * 10 + "</p><p>short end.</p></div><div id=comments><p>" + "Reader says. " * 20 + "</p></div></body>", ("Long text here. " * 10).strip() + "\n\nshort end."),
    ("<p>unclosed <b>bold<p>next &#233;&nbsp;x<script>var a='<p>no</p>'</script>", "unclosed bold\n\nnext é x"),
    (None, ""), ("", ""), ("plain", "plain"), ("<script>never closed", ""),
]


@pytest.mark.parametrize(("html", "want"), PAGES)
def test_pages(html, want):
    assert html_text.main_text(html) == want


def test_page_table(spark):
    df = spark.createDataFrame([(i, "u", h) for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert {r["page_id"]: r["n_chars"] for r in html_text.extract(df).collect()} == {i: len(w) for i, (_, w) in enumerate(PAGES)}
    assert html_text.extract(df.limit(0)).count() == 0
