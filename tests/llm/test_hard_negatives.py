from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from hostvane.llm import hard_negatives as H

KIND = "vec_id long, embedding array<float>, label int, anchor string, row long, rank string"


def brute(rows):
    """(vec_id, vector, label) rows, one by one, with Python's integers."""
    able = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        able.append((i, [math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for k, (i, v, label) in enumerate(able):
        if i % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, m) for n, (j, w, m) in enumerate(able) if n != k]
        for s, j, _ in sorted(x for x in scored if x[2] == label)[:5]:
            hard = sorted(x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s)[:10]
            out += [(i, j, rank, m, -s, -t) for rank, (t, m, _) in enumerate(hard, 1)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 7, "y") for r in rows], KIND)
    return sorted(map(tuple, H.mine(H.from_embeddings(df), **options).collect()))


def vectors(rng, n, size=12, labels=4):
    centres = [[rng.gauss(0, 0.3) for _ in range(size)] for _ in range(labels)]
    return [(i, [c + rng.gauss(0.1, 0.3) for c in centres[k]], k) for i, k in ((j, rng.randrange(labels)) for j in range(n))]


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = vectors(rng, 700)
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 100


@pytest.mark.parametrize("options", [{"block_anchors": 2}, {"pairs": 64}])
def test_blocks_and_pieces_give_the_same(spark, options, monkeypatch):
    rows = vectors(random.Random(2), 500)
    if "pairs" in options:
        monkeypatch.setattr(H, "PAIRS", options.pop("pairs"))
    assert mined(spark, rows, **options) == brute(rows)


def test_odd_rows(spark):
    rng = random.Random(3)
    rows = vectors(rng, 300, size=3, labels=2)
    rows += [(200, [0.5, None, 1.0], 1), (100, [float("nan"), 1.0, 1.0], 1), (0, [float("inf"), 1.0, 1.0], 0), (400, None, 1), (500, [1.0] * 3, None)]
    rows += [(None, [1.0, 1.0, 1.0], 1), (600, [], 0), (700, [0.25], 1), (800, [0.5, 0.25, 0.5, 1.0, 0.125], 0)]  # sizes differ
    rows += [(900, [0.5, 0.5, 0.5], 1)] * 3 + [(901, [0.5, 0.5, 0.5], 1)] * 40 + [(902, [0.25, 0.25, 0.25], 0)] * 40  # ties and repeats
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == [] and mined(spark, [(100, [1.0], 3)]) == []
    assert mined(spark, [(100, [-1.0], 3), (101, [1.0], 3), (102, [0.5], 4)]) == []  # a negative positive has no range


def test_large_components_are_exact_or_refused(spark):
    rng = random.Random(4)
    rows = [(i, [float(np.float32(rng.uniform(-1, 1) * 2**20)) for _ in range(8)], i % 3) for i in range(300)]
    assert mined(spark, rows) == brute(rows)
    with pytest.raises(Exception, match="64 bits"):
        mined(spark, [(100, [1e12] * 4, 1), (101, [1e12] * 4, 1)])


def test_bounds_hold_and_are_finer_below():
    rng = np.random.default_rng(5)
    for size in (1, 3, 10, 64):
        for spread in (1, 10**6, 10**9):
            v = rng.integers(-spread, spread + 1, (60, size)) + rng.integers(-spread, spread + 1, (60, 1))
            x = H.Rows(np.arange(60), np.arange(60), np.zeros(60, np.int64), v, *H.summaries(v))
            exact = v.astype(object) @ v.T.astype(object)
            widths = []
            for level in H.levels(size):
                low, high = H.bounds(x, x, level)
                assert (low <= exact.astype(np.float64)).all() and (exact.astype(np.float64) <= high).all()
                widths.append((high - low).mean())
            assert widths[-1] <= widths[0] * (1 + 1e-9)


def test_summaries_leave_little_to_score():
    """Structured vectors: most pairs end at the bounds, and what is left has every row of the answer."""
    rng = np.random.default_rng(6)
    v = np.repeat(rng.integers(-200, 200, (2000, 16)), 4, axis=1) + rng.integers(-9, 10, (2000, 64))
    rows = H.Rows(np.arange(2000), np.arange(2000), np.zeros(2000, np.int64), v, *H.summaries(v))
    a, best = rows.take(np.arange(20)), H.Best(20, 5)
    H.find_positives(a, best, rows)
    exact = v[:20] @ v.T
    np.fill_diagonal(exact, exact.min())
    want = np.sort(exact, axis=1)[:, ::-1][:, :5]
    assert (best.score.reshape(20, 5) == want).all()
    one, _ = H._refined(a, rows, lambda low, high, some=None: high >= best.bar[:, None])
    assert len(one) < 0.05 * 20 * 2000


def test_best_keeps_the_first_of_each_question():
    rng = random.Random(7)
    best, every = H.Best(5, 3), []
    for _ in range(30):
        rows = [(rng.randrange(5), rng.randrange(6), rng.randrange(9), rng.randrange(10**6)) for _ in range(rng.randrange(0, 9))]
        every += rows
        best.add(*(np.array(c, dtype=np.int64) for c in (zip(*rows) if rows else ([],) * 4)))
    want = [r for q in range(5) for r in sorted((r for r in every if r[0] == q), key=lambda r: (-r[1], r[2], r[3]))[:3]]
    assert list(zip(best.question, best.score, best.vec_id, best.row)) == want
    assert best.bar.tolist() == [sorted((r[1] for r in every if r[0] == q), reverse=True)[2] for q in range(5)]
    assert isinstance(pa.array(best.row), pa.Int64Array)
