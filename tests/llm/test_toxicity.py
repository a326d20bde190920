from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus_fixtures import make, tables  # noqa: F401
from hostvane.llm import toxicity as T
from hostvane.llm.queries import QUERIES

MASK = (1 << 64) - 1
FACTOR = [int(f) for f in T.FACTORS]


def words_of(text):
    cut = re.sub("[ -ⁿ　-〿\u0080-¿]", " ", (text or "").lower())
    return re.findall("[0-9a-z\u0080-\U0010ffff]+", cut)


def word_hash(word):
    h = sum((b + 1) * pow(FACTOR[0], k, 1 << 64) for k, b in enumerate(word.encode())) & MASK
    h = (h ^ h >> 32) * FACTOR[1] & MASK
    return h ^ h >> 29


def column(x):
    x = (x ^ x >> 29) * FACTOR[3] & MASK
    return x >> 64 - T.COLUMN_BITS


def brute_columns(text):
    h = [word_hash(w) for w in words_of(text)]
    out, run = set(), [(x * FACTOR[1] + 1) & MASK for x in h]
    out.update(map(column, run))
    for n in range(2, T.RUN + 1):
        run = [(run[i] * FACTOR[2] + h[i + n - 1] * FACTOR[4] + n) & MASK for i in range(len(h) - n + 1)]
        out.update(map(column, run))
    for k in T.SKIPS:
        out.update(column(((h[i] * FACTOR[0] & MASK ^ h[i + k + 1]) * FACTOR[2] + 100 + k) & MASK) for i in range(len(h) - k - 1))
    return sorted(out)


TEXTS = [
    "", None, "One", "one, TWO! three-four", "a b c d e f g a b c", "  \n\t", "Ünïcode “quoted” wörds… don’t", "日本語、です。", "x" * 3000 + " y",
    " ¿qué? ", "!", "a" + " " * 50 + "b", "é",
]


def split(texts, **options):
    text, col = T.columns_of(texts, **options)
    return [col[text == k].tolist() for k in range(len(texts))]


def test_columns_against_brute_force():
    assert split(TEXTS) == [brute_columns(t) for t in TEXTS]
    assert split([]) == []
    keep = np.zeros(1 << T.COLUMN_BITS, dtype=bool)
    keep[brute_columns("one, TWO! three-four")[::2]] = True
    assert split(TEXTS, keep=keep)[3] == brute_columns("one, TWO! three-four")[::2]


def test_long_texts_in_parts_have_the_same_columns():
    rng = random.Random(1)
    for _ in range(20):
        text = " ".join(rng.choice(["aa", "b", "ccc!", "“d”", "", "longer-word", "e" * 90]) for _ in range(400))
        for limit in (30, 100, 1000):
            assert split(["x y", text, "z"], limit=limit)[1] == brute_columns(text)


def test_ftrl_against_plain_python():
    rng = random.Random(2)
    rows = [np.array(sorted(rng.sample(range(40), 6))) for _ in range(120)]
    bad = np.array([int(r[0] < 4) for r in rows], dtype=bool)
    model = T.ftrl(rows, bad)
    z, n, bz, bn = {}, {}, 0.0, 0.0
    draw = np.random.default_rng(0)

    def weight(c):
        own = z.get(c, 0.0)
        if abs(own) <= T.L1:
            return 0.0
        return -(own - math.copysign(T.L1, own)) / ((T.BETA + math.sqrt(n[c])) / T.ALPHA + T.L2)

    for _ in range(T.EPOCHS):
        for i in draw.permutation(len(rows)):
            bias = -bz / ((T.BETA + math.sqrt(bn)) / T.ALPHA)
            w = {c: weight(c) for c in rows[i]}
            g = 1 / (1 + math.exp(-(sum(w.values()) + bias))) - bad[i]
            for c in rows[i]:
                z[c] = z.get(c, 0.0) + g - (math.sqrt(n.get(c, 0.0) + g * g) - math.sqrt(n.get(c, 0.0))) / T.ALPHA * w[c]
                n[c] = n.get(c, 0.0) + g * g
            bz += g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / T.ALPHA * bias
            bn += g * g
    want = {c: weight(c) for c in z if weight(c)}
    assert want and dict(zip(model.columns.tolist(), model.weights.tolist())) == pytest.approx(want, rel=1e-5)
    assert model.bias == pytest.approx(-bz / ((T.BETA + math.sqrt(bn)) / T.ALPHA))


def corpus(n=600):
    rng = random.Random(3)
    words = [f"word{k}" for k in range(200)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.choice([5, 40, 200]))]
        if toxic := rng.random() < 0.15:
            for _ in range(rng.choice([1, 3])):
                text[rng.randrange(len(text))] = rng.choice(["Nasty!", "vile", "you rotten one"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_planted_texts_and_odd_rows(make, spark):  # noqa: F811
    rows, labels = corpus()
    odd = [(5000, None), (5001, ""), (None, "so vile and nasty"), (5002, "word1 " * 60_000 + "nasty vile"), (5003, "such a vile thing"), (5003, "such a fine thing")]
    told = spark.createDataFrame([(i, 1, t, "x") for i, t in labels] + [(None, 1, 1, "x"), (3, 1, None, "x")], "doc_id long, quality int, toxic int, text string")
    got = T.rate(make(rows + odd), told).collect()
    assert len(got) == len(rows + odd) and {r.predicted == (r.score >= 0.3) for r in got} == {True}
    truth = dict(labels)
    seen = [(truth[r.doc_id], r.predicted) for r in got if r.doc_id is not None and r.doc_id < 600]
    assert sum(a == b for a, b in seen) / len(seen) > 0.97
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert by_id[None][0].predicted == 1 and not by_id[None][0].held_out
    assert [by_id[k][0].predicted for k in (5000, 5001, 5002)] == [0, 0, 1]
    assert sorted(r.predicted for r in by_id[5003]) == [0, 1]
    # the same sums, column by column
    model = T.train(make(rows), told)
    for r in [x for x in T.rate(make(rows), told.where("doc_id % 2 = 0")).collect()][:5]:
        assert 0 < r.score < 1
    dense = model.dense()
    for _, text in rows[:40]:
        z = (dense[brute_columns(text)].sum() + model.bias) * model.slope + model.offset
        assert model.scores([text])[0] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-4)
    assert len(model.columns) < 2000  # sparse


def test_held_out_labels_teach_nothing(make, spark):  # noqa: F811
    rows, labels = corpus(200)
    told = spark.createDataFrame(labels, "doc_id long, toxic int")
    held = T.in_fold(F.col("doc_id"), 4, 2)
    turned = told.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    docs = make(rows)
    first, second = ({(r.doc_id, r.score) for r in T.rate(docs, x).collect()} for x in (told, turned))
    assert first == second


def test_without_labels(make, spark):  # noqa: F811
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in T.rate(make([(1, "a"), (2, None)]), none).collect()} == {0.5}
    assert T.rate(make([]), none).collect() == []
    clean = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert all(r.score < 0.5 for r in T.rate(make([(1, "a"), (2, None)]), clean).collect())


def test_held_out_accuracy(spark):
    """Insults of the driver's documents are told apart on documents the model has not seen."""
    sf = "/root/testdata/sf0.01"
    try:
        truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    except Exception:
        pytest.skip("driver tables are not here")
    held = [r for r in QUERIES["op12_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in truth]
    right = sum(truth[r.doc_id] == r.predicted for r in held) / len(held)
    assert len(held) > 60 and right > 0.85
