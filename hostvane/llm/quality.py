"""Quality scores from Naive Bayes support vectors.

A text is the set of its n-grams: words, pairs of words, and runs of up to four word shapes (case, digits,
punctuation, and whether a word repeats the one before). N-grams are hashed into a fixed number of columns.
Every column is scaled by its log-count ratio between good and bad documents; a linear model with hinge loss is
fitted to the scaled indicators by dual coordinate descent, and its margin is turned into a probability on
documents kept out of the fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostvane.llm.langid import in_fold
from hostvane.llm.workers import per_worker, shared, slices, texts_of

COLUMNS = 1 << 18
TRAIN_DOCS = 20_000  # documented bound of the labelled sample
CALIBRATION = 4  # one sampled document in so many is kept for the probability
SMOOTHING = 1.0
PENALTY = 1.0
EPOCHS = 12
MIX = 0.9  # part of the fitted weights against their mean size
THRESHOLD = 0.3
SHAPES = 4
WORDS_KEPT = 200_000
# Odd factors that tell the kinds of n-grams apart.
FACTORS = [np.uint64(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)]



def shape(word: str) -> str:
    """``Words,`` is ``Aa,``, ``A.B`` is ``A.A`` and ``12%%`` is ``9%``: case, digits and punctuation, runs as one."""
    out: list[str] = []
    for c in word:
        if c.isalpha():
            c = "A" if c.isupper() else "a"
        elif c.isdigit():
            c = "9"
        if not out or out[-1] != c:
            out.append(c)
    return "".join(out[:8])


def _word_codes(words: list[str]) -> np.ndarray:
    """(hash of the word in lower case, hash of its shape) as one 64-bit number."""
    known = per_worker("quality words", dict)
    found = list(map(known.get, words))
    if None in found:
        if len(known) > WORDS_KEPT:
            known.clear()
        for k, code in enumerate(found):
            if code is None:
                w = words[k]
                found[k] = known[w] = crc32(w.lower().encode()) << 32 | crc32(shape(w).encode())
    return np.array(found, dtype=np.uint64)


def features(text: str | None) -> np.ndarray:
    """Columns of the n-grams of a whole text, each once. Every text has at least the column of the empty n-gram."""
    words = (text or "").split()
    codes = _word_codes(words)
    with np.errstate(over="ignore"):
        word, kind = codes >> np.uint64(32), codes & np.uint64(0xFFFFFFFF)
        repeats = np.zeros(len(codes), dtype=np.uint64)
        repeats[1:] = word[1:] == word[:-1]
        kind = kind * np.uint64(2) + repeats + np.uint64(1)
        parts = [np.zeros(1, np.uint64), word * FACTORS[0] + np.uint64(1)]
        parts.append((word[:-1] * FACTORS[1] ^ word[1:]) * FACTORS[2] + np.uint64(2))
        run = np.zeros(len(kind), np.uint64)
        for n in range(1, SHAPES + 1):
            run = run[: len(kind) - n + 1] * FACTORS[3] + kind[n - 1 :]
            parts.append(run * FACTORS[4] + np.uint64(2 + n))
        mixed = np.concatenate(parts)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return np.unique((mixed >> np.uint64(64 - COLUMNS.bit_length() + 1)).astype(np.int32))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, columns: np.ndarray) -> float:
        return float(self.weights[columns].sum() / np.sqrt(len(columns)) + self.bias)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        z = np.array([self.margin(features(t)) for t in texts]) * self.slope + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def log_count_ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    counts = [np.full(COLUMNS, SMOOTHING), np.full(COLUMNS, SMOOTHING)]
    for columns, label in zip(rows, good):
        counts[int(label)][columns] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, good: np.ndarray, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model over scaled indicators of unit-free length; classes weigh the same."""
    sign = np.where(good, 1.0, -1.0)
    values = [scale[c] / np.sqrt(len(c)) for c in rows]
    cost = np.where(good, 0.5 / max(good.sum(), 1), 0.5 / max((~good).sum(), 1)) * len(rows) * PENALTY
    size = np.array([v @ v + 1.0 for v in values])  # the bias is a column of ones
    dual, w, bias = np.zeros(len(rows)), np.zeros(COLUMNS), 0.0
    draw = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in draw.permutation(len(rows)):
            slack = sign[i] * (values[i] @ w[rows[i]] + bias) - 1
            new = min(max(dual[i] - slack / size[i], 0.0), cost[i])
            step = (new - dual[i]) * sign[i]
            if step:
                dual[i] = new
                w[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def probability(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through ``margins``, by Newton steps on smoothed labels."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -60, 60)))
        g = np.array([((p - target) * margins).sum() + 1e-3 * a, (p - target).sum()])
        v = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * margins**2).sum() + 1e-3, (v * margins).sum()], [(v * margins).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 0.0)), float(b)


def fit(rows: list[np.ndarray], good: np.ndarray) -> Model:
    """Fit on all but every ``CALIBRATION``-th row, which set the probability. With one class only, every text gets its share."""
    if not len(rows) or good.all() or not good.any():
        share = (good.sum() + 1) / (len(rows) + 2)
        return Model(np.zeros(COLUMNS), 0.0, 0.0, float(np.log(share / (1 - share))))
    fold = np.arange(len(rows)) % CALIBRATION == 0
    if min(good[fold].sum(), (~good)[fold].sum(), good[~fold].sum(), (~good)[~fold].sum()) == 0:
        fold = np.zeros(len(rows), dtype=bool)
    own = [r for r, out in zip(rows, fold) if not out]
    scale = log_count_ratios(own, good[~fold])
    w, bias = dual_coordinate_descent(own, scale, good[~fold])
    used = np.zeros(COLUMNS, dtype=bool)
    for r in own:
        used[r] = True
    mean = np.abs(w[used]).mean()
    model = Model(((1 - MIX) * mean + MIX * w) * scale, MIX * bias, 1.0, 0.0)
    tested = fold if fold.any() else ~fold
    margins = np.array([model.margin(r) for r, t in zip(rows, tested) if t])
    model.slope, model.offset = probability(margins, good[tested])
    return model


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole)):
        columns = [features(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns, pa.list_(pa.int32()))], ["good", "columns"])


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Learn from ``docs`` (doc_id, text) with ``labels`` (doc_id, quality).

    Of more than ``train_docs`` labelled documents, that many are taken by the hash of their id. A document with
    several labels counts as good if most of them are; null labels and ids teach nothing.
    """
    own = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") > 0.5).alias("good"))
    n = own.count()
    if n > train_docs:
        draw = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1_000_000)) / F.lit(1e6)
        own = own.where(draw < train_docs / n)  # about train_docs rows: small enough to broadcast
    taken = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(own), "doc_id")
    seen = taken.select("good", "text").mapInArrow(_featured, "good boolean, columns array<int>").toArrow()
    good = np.array(seen.column("good").to_pylist(), dtype=bool)
    columns = seen.column("columns").combine_chunks()
    rows = np.split(columns.values.to_numpy(), columns.offsets.to_numpy()[1:-1]) if len(good) else []
    order = sorted(range(len(rows)), key=lambda i: (bool(good[i]), rows[i].tobytes()))  # tasks end in any order
    order = np.random.default_rng(0).permutation(np.array(order, dtype=np.int64))
    return fit([rows[i] for i in order], good[order])


def scorer(spark, model: Model):
    """A column function: the score of a text column."""
    given = shared(spark, model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [given().scores(part) for part in texts_of(texts)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0), index=texts.index)

    return score


def rate(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text), from labels outside the held-out fold.

    Null texts count as empty; empty texts get a score like any other. Without labels every score is 0.5.
    A null doc_id is in no fold and has no label.
    """
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = F.coalesce(in_fold(F.col("doc_id"), 5, 0), F.lit(False))
    score = scorer(docs.sparkSession, train(slim, labels.where(~out), train_docs))
    rated = slim.select("doc_id", out.alias("held_out"), score("text").alias("score"))
    return rated.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
