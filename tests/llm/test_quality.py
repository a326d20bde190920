from __future__ import annotations

import random

import numpy as np

from corpus_fixtures import make, tables  # noqa: F401
from hostvane.llm import quality as Q
from hostvane.llm.queries import QUERIES


def test_shapes_and_features():
    assert [Q.shape(w) for w in ("Words,", "A.B", "12%%", "", "ÄÖß")] == ["Aa,", "A.A", "9%", "", "Aa"]
    assert len(Q.features(None)) == len(Q.features("")) == 1
    assert len(Q.features("a a a a a")) < len(Q.features("a b c d e"))
    assert (np.diff(Q.features("some words, Some words")) > 0).all()


def test_descent_reaches_the_optimum():
    """The dual optimum satisfies the margin conditions of the hinge loss."""
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 30, 8)).astype(np.int32) for _ in range(60)]
    good = np.array([r[0] < 4 for r in rows])
    scale = np.ones(Q.COLUMNS)
    w, bias = Q.dual_coordinate_descent(rows, scale, good)

    def loss(w, bias):
        sign = np.where(good, 1, -1)
        cost = np.where(good, 0.5 / good.sum(), 0.5 / (~good).sum()) * len(rows) * Q.PENALTY
        z = np.array([w[r].sum() / np.sqrt(len(r)) for r in rows]) + bias
        return 0.5 * (w @ w + bias**2) + (cost * np.maximum(0, 1 - sign * z)).sum()

    base = loss(w, bias)
    for _ in range(30):
        step = np.zeros(Q.COLUMNS)
        step[:30] = rng.normal(size=30) * 0.05
        assert loss(w + step, bias + rng.normal() * 0.05) > base - 0.02 * abs(base)


def test_learns_and_survives_edges(make, spark):  # noqa: F811
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choice(["fine", "words", "here"]) for _ in range(20)) + ".") for i in range(100)]
    rows += [(200 + i, "BUY!! " * rng.randrange(3, 30)) for i in range(60)]
    rows += [(900, None), (901, ""), (902, "fine words " * 30_000), (903, "BUY!! NOW!!"), (None, "fine words here"), (0, "fine fine")]
    labels = [(i, 1, 0) for i in range(100)] + [(200 + i, 0, 0) for i in range(60)] + [(0, 1, 0), (1, None, 0), (None, 0, 1)]
    given = spark.createDataFrame(labels, "doc_id long, quality int, text int")
    got = Q.rate(make(rows), given).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert held and all(r.predicted == (r.doc_id < 200) for r in held)
    by_id = {r.doc_id: r for r in got}
    assert by_id[900].score == by_id[901].score and by_id[903].score < by_id[902].score
    none = Q.rate(make(rows), given.where("doc_id < 0")).collect()
    assert {r.score for r in none} == {0.5}
    assert Q.rate(make([]), given).collect() == []
    one = Q.rate(make(rows[:50]), given.where("quality = 1"), train_docs=10).collect()
    assert all(r.predicted == 1 for r in one)


def test_held_out_accuracy(spark, tables):  # noqa: F811
    sf = tables.replace("sf0.001", "sf0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in QUERIES["op5_quality"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert len(held) > 40 and sum(labels[r.doc_id] == r.predicted for r in held) / len(held) > 0.95
