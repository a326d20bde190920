"""Language identification with interpolated Kneser-Ney character models.

One model of character 4-grams per language, learned from labelled documents. Text is lower-cased; every run of
non-letters is one space. Counts of all languages are put into one sorted array of hashed n-grams per order, with
a row of log probabilities per n-gram, so that one look-up serves every language. A text gets the language of the
lowest cross-entropy per character.

A text that no model explains is rejected: its cross-entropy lies too far above the usual one of its language. How far is too far
is set per language, by a high quantile and the robust spread of calibration documents that are predicted as labelled, so that a
mislabelled or garbled one moves nothing; short texts, and languages with few such documents, are allowed more.
Calibration documents are kept out of the counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostvane.llm.workers import per_worker, shared, slices, texts_of

ORDER = 4
TRAIN_CHARS = 16_000_000  # documented bound of the labelled sample: characters, shared evenly by the languages
CALIBRATION = 5  # one labelled document in so many
SCORED_CHARS = 1 << 18  # characters scored at once
SPREAD_CHARS = 400  # from this length on, longer texts are not expected to vary less
QUANTILE = 0.99
SPREADS = 60  # robust standard deviations allowed above the quantile: texts of one language differ by topic and style
LEAST_SPREAD = 0.01  # nats
SLACK = 4.0  # nats allowed besides when one document calibrates; less with more of them
UNKNOWN = "und"

U = np.uint64


def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)])


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(16-bit characters of all texts, first position of each text): letters and single spaces, padded in front.

    Letters beyond the basic plane are folded into 16 bits.
    """
    letter = per_worker("letters", _letters)
    pad = "\n" * (ORDER - 1)
    joined = pad + (pad + "\n").join(t.lower().replace("\n", " ") for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    mark = codes == 10
    kept = np.where(letter[np.minimum(codes, 0x10FFFF)], codes, 32).astype(np.uint32)
    kept = (kept ^ (kept >> 16)) & 0xFFFF
    blank = kept == 32
    doubled = np.zeros(len(codes), dtype=bool)
    doubled[1:] = blank[1:] & blank[:-1] & ~mark[1:]
    kept, mark = kept[~doubled], mark[~doubled]
    # Between texts stand ORDER marks: the first closes a text, the others are the padding of the next.
    at = np.flatnonzero(mark)
    first = at[ORDER - 2 :: ORDER] + 1
    return kept.astype(np.uint64), first


def grams(chars: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each position, 16 bits a character; the first ones are cut short."""
    out = chars.copy()
    for k in range(1, order):
        out[k:] |= chars[:-k] << U(16 * k)
    return out


def hashed(packed: np.ndarray) -> np.ndarray:
    """A one-to-one mix, so that sorted hashes are spread evenly."""
    x = packed ^ (packed >> U(32))
    x = x * U(0x9FB21C651E98DF25)
    return x ^ (x >> U(29))


class SortedHashes:
    """Sorted hashes with a table over their leading bits; ``find`` gives the row of each hash, or -1."""

    def __init__(self, packed: np.ndarray):
        keys = hashed(packed)
        self.order = np.argsort(keys)
        keys = keys[self.order]
        bits = max(1, int(len(keys)).bit_length())
        self.shift = U(64 - bits)
        self.first = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int64)
        sizes = np.diff(np.append(self.first, len(keys)))
        self.longest = int(sizes.max()) if len(sizes) else 0
        self.keys = np.append(keys, np.full(self.longest + 1, ~U(0)))
        self.n = len(keys)

    def find(self, packed: np.ndarray) -> np.ndarray:
        asked = hashed(packed)
        at = self.first[(asked >> self.shift).astype(np.int64)]
        for _ in range(self.longest):
            at = at + (self.keys[at] < asked)
        return np.where((self.keys[at] == asked) & (at < self.n), at, -1)


@dataclass
class Model:
    """``logs[n]``: log probability rows of the known n-grams; ``backoffs[n]``: log weight that a context of
    n - 1 characters leaves to shorter ones. ``usual`` and ``limit``: cross-entropy to expect, and the excess allowed."""

    languages: list[str]
    index: dict[int, SortedHashes]
    logs: dict[int, np.ndarray]
    contexts: dict[int, SortedHashes]
    backoffs: dict[int, np.ndarray]
    unseen: np.ndarray
    usual: np.ndarray
    limit: np.ndarray
    sharpness: float

    def log_rows(self, chars: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log probability of each position's character in every language (positions x languages)."""
        return self._rows(grams(chars, order), order)

    def _rows(self, packed: np.ndarray, order: int) -> np.ndarray:
        found = self.index[order].find(packed)
        out = self.logs[order][found]
        missing = np.flatnonzero(found < 0)
        if len(missing):
            if order == 1:
                out[missing] = self.unseen
            else:
                rest = packed[missing]
                context = self.contexts[order].find(rest >> U(16))
                weight = self.backoffs[order][context]
                weight[context < 0] = 0
                out[missing] = weight + self._rows(rest & U((1 << (16 * (order - 1))) - 1), order - 1)
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per character in each language, characters) of each text; whole texts, in bounded pieces."""
        sums, sizes = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), dtype=np.int64)
        k = 0
        while k < len(texts):
            end, size = k, 0
            while end < len(texts) and (end == k or size + len(texts[end]) < SCORED_CHARS):
                size += len(texts[end])
                end += 1
            chars, first = characters(texts[k:end])
            for a in range(0, len(chars), SCORED_CHARS):
                b = min(a + SCORED_CHARS, len(chars))
                lead = min(a, ORDER - 1)
                rows = self.log_rows(chars[a - lead : b])[lead:]
                owner = np.searchsorted(first, np.arange(a, b), side="right") - 1
                real = owner >= 0
                ends = np.append(first[1:] - ORDER, len(chars))  # the marks between texts are not theirs
                real &= np.arange(a, b) < ends[np.maximum(owner, 0)]
                for j in range(len(self.languages)):
                    sums[k:end, j] -= np.bincount(owner[real], rows[real, j], end - k)
                sizes[k:end] += np.bincount(owner[real], minlength=end - k)
            k = end
        return sums / np.maximum(sizes, 1)[:, None], sizes

    def predict(self, texts: list[str]) -> pd.DataFrame:
        """lang, score and rejected of each text. Without a letter: ``und``, 0 and rejected."""
        h, n = self.entropies(texts)
        best = np.argmin(h, axis=1)
        excess = (h[np.arange(len(h)), best] - self.usual[best]) * np.sqrt(np.minimum(n, SPREAD_CHARS) / SPREAD_CHARS)
        odds = np.exp(-self.sharpness * (h - h.min(axis=1, keepdims=True)))
        score = 1 / odds.sum(axis=1)
        none = np.array([not any(map(str.isalpha, t)) for t in texts], dtype=bool)
        names = np.array(self.languages, dtype=object)[best]
        names[none] = UNKNOWN
        return pd.DataFrame(
            {"lang": names, "score": np.where(none, 0.0, score), "rejected": none | (excess > self.limit[best])}
        )


def kneser_ney(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Interpolated Kneser-Ney from the counted highest-order n-grams (packed, count) of each language."""
    languages = sorted(counts)
    types = {lang: {ORDER: counts[lang]} for lang in languages}
    for lang in languages:
        for n in range(ORDER - 1, 0, -1):  # shorter ones count the characters seen before them
            mask = U((1 << (16 * n)) - 1)
            types[lang][n] = np.unique(types[lang][n + 1][0] & mask, return_counts=True)
    known = {n: np.unique(np.concatenate([types[lang][n][0] for lang in languages])) for n in range(1, ORDER + 1)}
    index = {n: SortedHashes(known[n]) for n in known}
    heads = {n: np.unique(known[n] >> U(16)) for n in range(2, ORDER + 1)}
    contexts = {n: SortedHashes(heads[n]) for n in heads}
    logs = {n: np.zeros((len(known[n]), len(languages))) for n in known}
    backoffs = {n: np.zeros((len(heads[n]), len(languages))) for n in heads}
    unseen = np.zeros(len(languages))
    floor = 1 / (len(known[1]) + 1)
    for j, lang in enumerate(languages):
        lower = None
        for n in range(1, ORDER + 1):
            packed, count = types[lang][n]
            ones, twos = int((count == 1).sum()), int((count == 2).sum())
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            if n == 1:
                total = count.sum()
                left = d * len(packed) / total
                p = np.full(len(known[1]), left * floor)
                p[np.searchsorted(known[1], packed)] += np.maximum(count - d, 0) / total
                unseen[j] = np.log(left * floor)
            else:
                head, where = np.unique(packed >> U(16), return_inverse=True)
                total = np.bincount(where, count)
                left = d * np.bincount(where) / total
                weight = np.ones(len(heads[n]))
                weight[np.searchsorted(heads[n], head)] = left
                below = np.searchsorted(known[n - 1], known[n] & U((1 << (16 * (n - 1))) - 1))
                p = weight[np.searchsorted(heads[n], known[n] >> U(16))] * lower[below]
                p[np.searchsorted(known[n], packed)] += np.maximum(count - d, 0) / total[where]
                backoffs[n][:, j] = np.log(weight)
            logs[n][:, j] = np.log(p)
            lower = p
    return Model(
        languages,
        index,
        {n: logs[n][index[n].order].astype(np.float32) for n in logs},
        contexts,
        {n: backoffs[n][contexts[n].order].astype(np.float32) for n in backoffs},
        unseen,
        np.zeros(len(languages)),
        np.full(len(languages), np.inf),
        1.0,
    )


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in (part for whole in batches for part in slices(whole)):
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in set(langs):
            chars, first = characters([t for t, own in zip(texts, langs) if own == lang])
            marks = np.zeros(len(chars), dtype=bool)
            for k in range(ORDER):  # positions of the padding end no n-gram of a text
                marks[np.maximum(first - 1 - k, 0)] = True
            held.setdefault(lang, []).append(np.unique(grams(chars, ORDER)[~marks], return_counts=True))
    for lang, parts in held.items():
        packed, where = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
        n = np.bincount(where, np.concatenate([c for _, c in parts])).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(packed)), pa.array(packed.view(np.int64)), pa.array(n)], ["lang", "gram", "n"]
        )


def train(docs: DataFrame, train_chars: int = TRAIN_CHARS) -> Model | None:
    """Learn from ``docs`` (doc_id, text, lang); rows with null lang or text teach nothing.

    Each language gets an equal part of ``train_chars``; of larger languages, documents are taken by the hash of
    their id. Whole texts are used. Without labelled rows there is no model.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.sum(F.length("text"))).collect()}
    if not sizes:
        return None
    share = train_chars / len(sizes)
    parts = spark.createDataFrame(
        [(lang, min(1.0, share / max(n or 0, 1))) for lang, n in sizes.items()], "lang string, part double"
    )
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("train")), F.lit(1_000_000)) / F.lit(1e6)
    taken = rows.join(F.broadcast(parts), "lang").where(draw < F.col("part"))
    held_back = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("calibrate")), F.lit(CALIBRATION)) == 0
    counted = taken.where(~held_back).select("lang", "text").mapInArrow(_count_grams, "lang string, gram long, n long")
    summed = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()  # at most train_chars rows
    langs = np.array(summed.column("lang").to_pylist(), dtype=object)
    gram, n = summed.column("gram").to_numpy().view(np.uint64), summed.column("n").to_numpy()
    counts = {}
    for lang in sorted(set(langs)):
        own = langs == lang
        order = np.argsort(gram[own])
        counts[lang] = (gram[own][order], n[own][order])
    if not counts:  # a handful of rows may all be calibration documents, or have no text
        return None
    model = kneser_ney(counts)
    return _calibrated(spark, model, taken.where(held_back))


def allowed(excess: np.ndarray) -> float:
    """The excess up to which a text is kept, given that of calibration documents of one language."""
    if not len(excess):
        return SLACK
    spread = 1.4826 * np.median(np.abs(excess - np.median(excess)))
    return float(max(np.quantile(excess, QUANTILE), 0.0) + SPREADS * max(spread, LEAST_SPREAD) + SLACK / np.sqrt(len(excess)))


def _calibrated(spark: SparkSession, model: Model, rows: DataFrame) -> Model:
    """Set what is usual, the limit of rejection and the sharpness of scores on documents the counts do not hold."""
    given, names = shared(spark, model), model.languages

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            h, n = given().entropies(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(h), pa.list_(pa.float64())), pa.array(n)], ["lang", "h", "n"]
            )

    seen = rows.select("lang", "text").mapInArrow(measure, "lang string, h array<double>, n long").toPandas()
    seen = seen[(seen["n"] > 0) & seen["lang"].isin(names)]
    if not len(seen):
        return model
    h, n = np.vstack(seen["h"].to_numpy()), seen["n"].to_numpy()
    truth = np.array([names.index(x) for x in seen["lang"]])
    own = h[np.arange(len(h)), truth]
    for j in range(len(names)):
        mine = own[truth == j]
        model.usual[j] = np.median(mine) if len(mine) else np.median(own)
    excess = (own - model.usual[truth]) * np.sqrt(np.minimum(n, SPREAD_CHARS) / SPREAD_CHARS)
    right = np.argmin(h, axis=1) == truth
    model.limit = np.array([allowed(excess[right & (truth == j)]) for j in range(len(names))])
    tried = 2.0 ** np.arange(-2, 8)
    gap = h - own[:, None]
    loss = [np.log(np.exp(np.minimum(-s * gap, 700)).sum(axis=1)).mean() for s in tried]
    model.sharpness = float(tried[int(np.argmin(loss))])
    return model


def predictor(spark: SparkSession, model: Model | None):
    """A column function: struct(lang, score, rejected) of a text column. Without a model every text is ``und``,
    and only texts without letters are rejected."""
    given = shared(spark, model)

    @F.pandas_udf("lang string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            yield pd.concat([told([t or "" for t in part]) for part in texts_of(series)] or [told([])], ignore_index=True)

    def told(rows: list[str]) -> pd.DataFrame:
        if given() is None:
            empty = [not any(map(str.isalpha, t)) for t in rows]
            return pd.DataFrame({"lang": UNKNOWN, "score": 0.0, "rejected": empty}, index=range(len(rows)))
        return given().predict(rows)

    return predict


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold


def identify(docs: DataFrame, train_chars: int = TRAIN_CHARS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row of ``docs`` (doc_id, text, lang).

    Learns from labelled rows outside the held-out fold. Texts that are null or have no letter get ``und`` and 0.
    A null doc_id is in no fold, so it is not held out.
    """
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang")
    slim = slim.withColumn("held_out", F.coalesce(in_fold(F.col("doc_id"), 4, 2), F.lit(False)))
    predict = predictor(docs.sparkSession, train(slim.where(~F.col("held_out")), train_chars))
    out = slim.select("doc_id", "held_out", predict("text").alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score", "p.rejected")
