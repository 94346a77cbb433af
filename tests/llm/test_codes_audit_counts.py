"""Vector codes, the filter audit and token counts against brute force, with odd rows."""

import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import filter_audit, token_counts, vector_codes
from cadenza.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


# token counts


@pytest.fixture(scope="module")
def model():
    return token_counts.library(token_counts.default_model())


def test_token_counts_of_the_table(spark, model):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op13_token_counts"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = len(model.encode(docs[r["doc_id"]]))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(docs[r["doc_id"]].encode()), n > 4096)


def test_token_counts_of_odd_strings(model, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(token_counts, "STRETCH", 9)
    monkeypatch.setattr(token_counts, "CACHE_PARTS", 50)
    counts = token_counts.Counts(token_counts.default_model(), token_counts.prove(token_counts.default_model()))
    some = [" ", "  ", "\n", "▁", "a", "th", "the", " The", "é", "漢", "\x00", "\t", "\r", "<s>", "</s>", "<unk>", "<0x0A>", "ﬁ", "😀", "1", "."]
    for _ in range(5000):
        text = "".join(rng.choice(some) for _ in range(rng.randint(0, 14)))
        assert counts.count(text.encode()) == len(model.encode(text)), text
        raw = bytes(rng.choice((32, 10, 97, 0xE2, 0x96, 0x81, 0xF0, 0xC3)) for _ in range(rng.randint(0, 9)))
        assert counts.count(raw) == len(model.encode(raw)), raw


def test_what_is_proved_encodes_alone(model):
    whole = token_counts.prove(token_counts.default_model())
    ones = [k for k in random.Random(1).sample(sorted(whole), 500) if k[:1] == b" " and len(k) > 1]
    assert len(ones) > 100 and all(whole[k] == 1 == len(model.encode(k[1:])) for k in ones)


def test_a_model_that_is_not_proved_takes_whole_texts(model):
    counts = token_counts.Counts(token_counts.default_model(), None)
    assert counts.count("a b\nc".encode()) == len(model.encode("a b\nc")) and not counts


def test_token_counts_of_odd_rows(spark, model):
    rows = [(1, None), (1, ""), (None, "no id"), (2, "x" * 3_000_000), (3, "word " * 400_000), (4, "same"), (4, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("n_tokens", "n_bytes", "over_limit")})
    out = token_counts.count_tokens(df).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in out) == sorted((str(i), len(t or ""), len(model.encode(t or ""))) for i, t in rows)
    assert token_counts.count_tokens(df.limit(0)).count() == 0


# filter audit


def plain_audit(docs, labels):
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    rows = []
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {c for c, x in zip("ABCD", (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), re.search(r"[#$%&*|]", text))) if x}
        if i is not None and any((t or "") == text and j is not None and j < i for j, t, _ in docs):
            fails.add("E")
        rows.append((lang or "", fails, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == part]
        shares = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                shares[f] += len(gone)
                failing = sum(f in r[0] for r in own)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(r[0] == {f} for r in own), sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shares[order[step - 1]])
    return out


def test_audit_against_brute_force(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(("aa", "Bb", "CC", "d#", "é", f"w{rng.randint(0, 400)}")) for _ in range(rng.choice((0, 3, 120, 300)))) for _ in range(150)]
    texts += [None, "", " \t\v\f\r\n", "one " * 200, "a b " * 120, " ".join(f"x{i}" for i in range(200)), "A" + "b" * 9, "A" + "b" * 8, " ".join(f"u{i}" for i in range(100))] * 2
    docs = [(rng.choice((None, *range(60))), t, rng.choice((None, "", "en", "fr", "de"))) for t in texts] * 2
    docs += [(1000 + i, f"lone {i}", f"l{i}") for i in range(70)]
    labels = [(rng.choice((None, *range(60))), rng.choice((0, 1, None)), rng.choice((0, 1, None))) for _ in range(50)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("part", "mask", "first", "good", "toxic", "copy", "n")})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("clash"))
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    found = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in names] for r in filter_audit.audit(df, marks).collect()}
    assert found == plain_audit(docs, labels)
    assert filter_audit.audit(df.limit(0), marks.limit(0)).count() == 0
    assert filter_audit.audit(df, marks.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_long_texts_are_measured_in_stretches(monkeypatch):
    texts = [b"word other #" * 9, b"A b\tC " * 20, b"x" * 50, b" " * 40, " ".join(f"é{i}" for i in range(130)).encode()]
    whole = [filter_audit.failures(t) for t in texts]
    monkeypatch.setattr(filter_audit, "STRETCH", 5)
    assert [filter_audit.failures(t) for t in texts] == whole


def test_tasks_hand_on_their_parts(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "PARTS_HELD", 1)
    rows = spark.range(5000).selectExpr("cast(id % 7 as string) part", "cast(id % 32 as int) mask", "id % 3 = 0 good", "id % 5 = 0 toxic")
    found = {(r["part"], r["subset"]): (r["n"], r["good"], r["toxic"]) for r in filter_audit.subset_counts(rows).collect()}
    for part in range(7):
        for subset in range(32):
            own = [i for i in range(5000) if i % 7 == part and not i % 32 & subset]
            assert found[str(part), subset] == (len(own), sum(i % 3 == 0 for i in own), sum(i % 5 == 0 for i in own))


# vector codes


def plain_codes(vectors, entries=256, rounds=4):
    """With Python's integers: vectors are (id, components, label), all kept, in order of their ids."""
    from fractions import Fraction

    whole = [[int(Fraction(x) * 1024 // 1) for x in v] for _, v, _ in vectors]
    part = len(whole[0]) // 4
    cut = [[w[k * part : (k + 1) * part] for w in whole] for k in range(4)]
    books = [[list(x) for x in c[:entries]] for c in cut]
    distance = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    for r in range(rounds + 1):
        nearest = [[min((distance(x, c), e) for e, c in enumerate(book)) for x in rows] for rows, book in zip(cut, books)]
        if r < rounds:
            for k, book in enumerate(books):
                for e in range(len(book)):
                    own = [x for x, (_, at) in zip(cut[k], nearest[k]) if at == e]
                    if own:
                        book[e] = [sum(c) // len(own) for c in zip(*own)]
    codes = ["".join(f"{nearest[k][i][1]:02x}" for k in range(4)) for i in range(len(whole))]
    errors = [sum(nearest[k][i][0] for k in range(4)) for i in range(len(whole))]
    return codes, errors, hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()


@pytest.mark.parametrize(("kind", "entries"), [("near", 256), ("near", 7), ("ties", 20), ("large", 9), ("huge", 9)])
def test_codes_against_brute_force(spark, kind, entries):
    rng = random.Random(entries)
    draw = {"near": lambda: rng.gauss(0, 0.2), "ties": lambda: rng.randint(-1, 1) / 1024, "large": lambda: rng.gauss(0, 1) * 2.0 ** rng.randint(0, 20), "huge": lambda: rng.gauss(0, 1) * 2.0 ** rng.randint(0, 100)}[kind]
    rows = [(3 * i, [float(np.float32(draw())) for _ in range(8)], rng.choice((None, 1, 2))) for i in range(300)]
    bad = [(1, None, 1), (2, [0.0] * 7 + [None], 1), (4, [0.0] * 7 + [float("nan")], 1), (5, [float("inf")] + [0.0] * 7, None), (7, [0.0] * 4, 1), (-8, [], 1), (-9, [0.0] * 3, 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("clash") for c in ("code", "error", "n", "place")}).repartition(5)
    codes, errors, digest = plain_codes(rows, entries)
    found = {r["vec_id"]: r for r in vector_codes.compress(df, entries=entries).collect()}
    assert sorted(found) == [r[0] for r in rows]
    most = (1 << 63) - 1
    for (i, _, label), code, error in zip(rows, codes, errors):
        same = [e for e, r in zip(errors, rows) if r[2] == label]
        assert (found[i]["code"], found[i]["error"], found[i]["codebooks_sha256"]) == (code, error if error <= most else None, digest)
        if all(e <= most for e in same):
            assert found[i]["label_error"] == (sum(same) if sum(same) <= most else None)


def test_exponion_leaves_distances_out():
    rng = np.random.default_rng(1)
    book = rng.integers(-10_000, 10_000, (64, 2)).astype(object)
    x = book[rng.integers(0, 64, 5000)].astype(np.float64) + rng.integers(-300, 300, (5000, 2))
    all_pairs = ((x[:, None, :] - book.astype(float)[None]) ** 2).sum(axis=2)
    at = np.argmin(all_pairs, axis=1)
    start = np.where(rng.random(5000) < 0.9, at, rng.integers(0, 64, 5000))
    best, error, tried = vector_codes.exponion(x, start, book)
    assert (best == at).all() and (error == all_pairs.min(axis=1)).all() and tried < 0.35 * all_pairs.size


def test_codes_of_odd_tables(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert vector_codes.compress(spark.createDataFrame([], kind)).count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1), (2, [], 2)], kind)).count() == 0
    rows = [(None, [1.0] * 4, None), (None, [2.0] * 4, 1), (5, [1.0] * 4, 1), (5, [1.0] * 4, 1)]
    out = vector_codes.compress(spark.createDataFrame(rows, kind)).collect()
    assert len(out) == 4 and {r["error"] for r in out} == {0} and len({r["codebooks_sha256"] for r in out}) == 1
    assert sorted((str(r["vec_id"]), r["code"]) for r in out) == [("5", "00000000"), ("5", "00000000"), ("None", "00000000"), ("None", "03030303")]
