"""Toxicity scores: logistic regression fitted by FTRL-proximal over hashed word n-grams and skip-grams.

A word is a run of letters, digits and marks beyond ASCII, in lower case. A text is the set of its words, its runs of two and
three words, and its pairs of words with one or two words between them, each hashed into a fixed number of columns.
The model goes through labelled documents one by one; every column has a learning rate of its own, which falls with the
gradients it has seen, and a weight of zero until they outweigh the L1 penalty. So the model is a short list of
columns with weights, which every worker holds.

Words are hashed from the bytes of many texts at once, and columns without a weight are dropped at once, so scoring makes
no Python object per word. Long texts are read in parts that overlap by the longest n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostvane.llm.langid import in_fold
from hostvane.llm.quality import probability
from hostvane.llm.workers import per_worker, shared, slices, texts_of

COLUMN_BITS = 22
TRAIN_DOCS = 12_000  # documented bound of the labelled sample
CALIBRATION = 4  # one sampled document in so many is kept for the probability
EPOCHS = 2
ALPHA, BETA = 0.3, 1.0  # learning rate
L1, L2 = 6.0, 1.0
THRESHOLD = 0.3
RUN = 3  # words of the longest n-gram
SKIPS = (1, 2)  # words between the two of a skip-gram
BATCH_BYTES = 1 << 20
# Odd factors that tell the kinds of n-grams apart.
FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]

U = np.uint64


def _word_bytes() -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
    return out


def _powers(n: int) -> np.ndarray:
    """1, f, f^2, ... at least ``n`` of them."""
    held = per_worker("toxicity powers", lambda: [np.ones(1, U)])
    if len(held[0]) < n:
        with np.errstate(over="ignore"):
            held[0] = np.concatenate([np.ones(1, U), np.cumprod(np.full(max(n, 256), FACTORS[0], U))])
    return held[0]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, text of every word) of UTF-8 texts in lower case."""
    raw = np.frombuffer(b"\n".join(texts), np.uint8)
    inside = _word_bytes()[raw]
    # Marks that are no letters: general punctuation, spaces and signs of Latin-1, and punctuation of Chinese and Japanese.
    for lead, second, length in ((0xE2, 0x80, 3), (0xE2, 0x81, 3), (0xE3, 0x80, 3), (0xC2, None, 2)):
        at = np.flatnonzero(raw == lead)
        if second is not None:
            at = at[at + 1 < len(raw)]
            at = at[raw[at + 1] == second]
        for k in range(length):
            inside[np.minimum(at + k, len(raw) - 1)] = False
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    starts, stops = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, U), np.zeros(0, np.int64)
    size = stops - starts
    offset = np.cumsum(size) - size
    letters = raw[inside].astype(U) + U(1)
    place = np.arange(len(letters)) - np.repeat(offset, size)
    with np.errstate(over="ignore"):
        words = np.add.reduceat(letters * _powers(int(size.max()))[place], offset)
        words = (words ^ (words >> U(32))) * FACTORS[1]
    ends = np.cumsum([len(t) + 1 for t in texts])
    return words ^ (words >> U(29)), np.searchsorted(ends, starts, side="right")


def _column(mixed: np.ndarray) -> np.ndarray:
    mixed = (mixed ^ (mixed >> U(29))) * FACTORS[3]
    return (mixed >> U(64 - COLUMN_BITS)).astype(np.int64)


def n_grams(words: np.ndarray, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(columns, texts) of every kind of n-gram; none reaches into the next text."""
    with np.errstate(over="ignore"):
        run = words * FACTORS[1] + U(1)
        yield _column(run), text
        for n in range(2, RUN + 1):
            run = run[:-1] * FACTORS[2] + words[n - 1 :] * FACTORS[4] + U(n)
            whole = text[n - 1 :] == text[: len(text) - n + 1]
            yield _column(run[whole]), text[n - 1 :][whole]
        for k in SKIPS:
            pair = (words[: -k - 1] * FACTORS[0] ^ words[k + 1 :]) * FACTORS[2] + U(100 + k)
            whole = text[k + 1 :] == text[: len(text) - k - 1]
            yield _column(pair[whole]), text[k + 1 :][whole]


REACH = max(RUN - 1, *(k + 1 for k in SKIPS))  # words before a word that share an n-gram with it


def _lead(text: bytes, cut: int) -> int:
    """A place before ``cut``, at a space or the beginning, with REACH words between."""
    width = 256
    while width < cut:
        begin = text.find(b" ", cut - width, cut)
        if begin >= 0 and len(word_hashes([text[begin:cut]])[0]) >= REACH:
            return begin
        width *= 2
    return 0


def _parts(text: bytes, limit: int) -> Iterator[bytes]:
    """A long text in parts cut at spaces; each begins with the words that n-grams with its first words need."""
    at, cut = 0, text.find(b" ", limit)
    while cut >= 0:
        yield text[at:cut]
        at, cut = _lead(text, cut), text.find(b" ", cut + limit)
    yield text[at:]


def columns_of(texts: list[str | None], keep: np.ndarray | None = None, limit: int = BATCH_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(text, column) pairs, each once and in order, of whole texts; only columns with ``keep`` if given."""
    found, held, owner, size = [], [], [], 0

    def flush() -> None:
        nonlocal held, owner, size
        words, text = word_hashes(held)
        owners = np.array(owner, dtype=np.int64)
        for columns, which in n_grams(words, text) if len(words) else ():
            if keep is not None:
                some = keep[columns]
                columns, which = columns[some], which[some]
            found.append(owners[which] << COLUMN_BITS | columns)
        held, owner, size = [], [], 0

    for k, t in enumerate(texts):
        for part in _parts((t or "").lower().encode("utf-8", "replace"), limit):
            held.append(part)
            owner.append(k)
            size += len(part)
            if size >= limit:
                flush()
    flush()
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs >> COLUMN_BITS, pairs & ((1 << COLUMN_BITS) - 1)


@dataclass
class Model:
    """Columns with a weight, their weights, and the curve that makes a sum a probability."""

    columns: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << COLUMN_BITS, np.float32)
        out[self.columns] = self.weights
        return out

    def margins(self, texts: list[str | None], dense: np.ndarray | None = None) -> np.ndarray:
        dense = self.dense() if dense is None else dense
        text, column = columns_of(texts, dense != 0)
        return np.bincount(text, dense[column], len(texts)) + self.bias

    def scores(self, texts: list[str | None], dense: np.ndarray | None = None) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(texts, dense) * self.slope + self.offset, -60, 60)))


def ftrl(rows: list[np.ndarray], bad: np.ndarray, seed: int = 0) -> Model:
    """FTRL-proximal over ``rows`` of columns. The bias is a column of its own without a penalty."""
    z, n = np.zeros(1 << COLUMN_BITS), np.zeros(1 << COLUMN_BITS)
    bias_z = bias_n = 0.0
    draw = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in draw.permutation(len(rows)):
            c = rows[i]
            own_z, own_n = z[c], n[c]
            root = np.sqrt(own_n)
            w = -(own_z - np.sign(own_z) * L1) / ((BETA + root) / ALPHA + L2)
            w[np.abs(own_z) <= L1] = 0.0
            bias = -bias_z / ((BETA + bias_n**0.5) / ALPHA)
            p = 1 / (1 + np.exp(-min(max(w.sum() + bias, -35.0), 35.0)))
            g = p - bad[i]
            z[c] = own_z + g - (np.sqrt(own_n + g * g) - root) / ALPHA * w
            n[c] = own_n + g * g
            bias_z += g - ((bias_n + g * g) ** 0.5 - bias_n**0.5) / ALPHA * bias
            bias_n += g * g
    used = np.flatnonzero(np.abs(z) > L1)
    weights = -(z[used] - np.sign(z[used]) * L1) / ((BETA + np.sqrt(n[used])) / ALPHA + L2)
    return Model(used, weights.astype(np.float32), float(-bias_z / ((BETA + bias_n**0.5) / ALPHA)))


def fit(rows: list[np.ndarray], bad: np.ndarray) -> Model:
    """Fit on all but every ``CALIBRATION``-th row, which set the probability. With one class only, every text gets its share."""
    if not len(rows) or bad.all() or not bad.any():
        share = (bad.sum() + 1) / (len(rows) + 2)
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    fold = np.arange(len(rows)) % CALIBRATION == 0
    if min(bad[fold].sum(), (~bad)[fold].sum(), bad[~fold].sum(), (~bad)[~fold].sum()) == 0:
        fold = np.zeros(len(rows), dtype=bool)
    model = ftrl([r for r, out in zip(rows, fold) if not out], bad[~fold])
    dense, tested = model.dense(), fold if fold.any() else ~fold
    margins = np.array([dense[r].sum() + model.bias for r, t in zip(rows, tested) if t])
    model.slope, model.offset = probability(margins, bad[tested])
    return model


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole)):
        text, column = columns_of(batch.column(1).to_pylist())
        bounds = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(column.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["bad", "columns"])


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Learn from ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic).

    Of more than ``train_docs`` labelled documents, that many are taken by the hash of their id. A document with
    several labels counts as toxic if most of them are; null labels and ids teach nothing.
    """
    own = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.avg("toxic") > 0.5).alias("bad"))
    n = own.count()
    if n > train_docs:
        draw = F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1_000_000)) / F.lit(1e6)
        own = own.where(draw < train_docs / n)  # about train_docs rows: small enough to broadcast
    taken = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(own), "doc_id")
    seen = taken.select("bad", "text").mapInArrow(_featured, "bad boolean, columns array<int>").toArrow()
    bad = np.array(seen.column("bad").to_pylist(), dtype=bool)
    columns = seen.column("columns").combine_chunks()
    rows = np.split(columns.values.to_numpy(), columns.offsets.to_numpy()[1:-1]) if len(bad) else []
    order = sorted(range(len(rows)), key=lambda i: (bool(bad[i]), rows[i].tobytes()))  # tasks end in any order
    order = np.random.default_rng(0).permutation(np.array(order, dtype=np.int64))
    return fit([rows[i] for i in order], bad[order])


def scorer(spark, model: Model):
    """A column function: the score of a text column."""
    given = shared(spark, model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        dense = given().dense()
        for texts in batches:
            parts = [given().scores(part, dense) for part in texts_of(texts)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0), index=texts.index)

    return score


def rate(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text), from labels outside the held-out fold.

    Null texts count as empty; empty texts get the score of a text without words. Without labels every score is 0.5.
    Rows repeating a doc_id are scored by their own text; a null doc_id is in no fold and has no label.
    """
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = F.coalesce(in_fold(F.col("doc_id"), 4, 2), F.lit(False))
    score = scorer(docs.sparkSession, train(slim, labels.where(~out), train_docs))
    rated = slim.select("doc_id", out.alias("held_out"), score("text").alias("score"))
    return rated.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
