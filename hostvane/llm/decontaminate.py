"""Benchmark passages in documents: q-gram filtering in diagonal bands, verified by banded alignment.

Every ``STEP`` characters of a benchmark item a window begins, so any verbatim stretch of a window's length lies within the
edits of one. A passage of a document that equals a window up to ``k`` edits shares with it at least
``m + 1 - q * (k + 1)`` of its q-grams, all of them on neighbouring diagonals (place in the text less place in
the item). So q-grams that a document shares with an item are counted per band of diagonals; bands overlap by
``k``, so that a match lies in one of them whole. In bands that reach the bound, the same is counted for
every window of the item, and windows that reach it are aligned with the text inside the band; they count when that takes at
most ``k`` edits.

Items shorter than ``MIN_CHARS`` allow no edits: they are looked up by their first q-gram, with q no more than their length,
and count where they stand whole between word borders. Scripts written without spaces (from U+2E80 on) need no border.

Texts are compared in lower case, with every run of characters that are neither letters nor digits as one space.
Positions are places in that form. Items without a letter or digit match nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from hostvane.llm.workers import per_worker, shared, slices, texts_of

WINDOW = 80  # characters
STEP = 8
Q = 8
MAX_ERROR = 0.1  # edits per character of a window
MIN_CHARS = 40  # shorter items must stand as they are
BAND = 16
PIECE = 1 << 18  # characters of documents looked at at once
ALIGNED = 4096  # bands aligned at once
HITS = 1 << 21  # shared q-grams held at once, as far as texts can be cut
BLOCK_CHARS = 2_000_000  # benchmark characters held by a task at once; a larger benchmark is searched in blocks
UNSPACED = 0x2E80
FACTOR = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 22
LOW = np.int64((1 << 32) - 1)


def _alphanumeric() -> np.ndarray:
    return np.array([not 0xD800 <= c < 0xE000 and chr(c).isalnum() for c in range(0x110000)])


def normal_codes(text: str) -> np.ndarray:
    """Code points of the compared form of ``text``."""
    table = per_worker("alphanumeric", _alphanumeric)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = np.where(table[codes], codes, np.uint32(32))
    blank = kept == 32
    again = blank.copy()
    again[1:] &= blank[:-1]
    if len(again):
        again[0] = blank[0]  # none in front
    kept = kept[~again]
    return kept[:-1] if len(kept) and kept[-1] == 32 else kept


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of the ``q`` characters from each position on."""
    with np.errstate(over="ignore"):
        out = np.zeros(max(0, len(codes) - q + 1), np.uint64)
        wide = codes.astype(np.uint64) + np.uint64(1)
        for k in range(q):
            out = out * FACTOR + wide[k : k + len(out)]
        return (out ^ (out >> np.uint64(32))) * FACTOR


class Grams:
    """Sorted q-gram hashes, each with its places; ``hits`` gives (position, place) of those among given hashes."""

    def __init__(self, hashes: list[np.ndarray], places: list[np.ndarray], q: int):
        self.q = q
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.grams, first = np.unique(flat[order], return_index=True)
        self.first = np.append(first, len(flat))
        self.places = (np.concatenate(places) if places else np.zeros(0, np.int64))[order]
        self.seen = np.zeros(1 << FILTER_BITS, dtype=bool)  # whether any q-gram has these leading bits
        self.seen[(self.grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def known(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, row) of q-grams of ``codes`` that are here."""
        hashes = gram_hashes(codes, self.q)
        at = np.flatnonzero(self.seen[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        if not len(at) or not len(self.grams):
            return at[:0], at[:0]
        row = np.minimum(np.searchsorted(self.grams, hashes[at]), len(self.grams) - 1)
        real = self.grams[row] == hashes[at]
        return at[real], row[real]

    def hits(self, at: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        many = self.first[row + 1] - self.first[row]
        offset = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(at, many), self.places[np.repeat(self.first[row], many) + offset]


@dataclass
class Windows:
    """Windows of benchmark items, and q-gram indexes of the items."""

    items: np.ndarray  # item of each window
    patterns: list[np.ndarray]
    edits: np.ndarray  # allowed in each window
    needed: np.ndarray  # shared q-grams that a match must have
    starts: np.ndarray  # place of each window in its item
    first: np.ndarray  # first window of each long item, and the end
    step: int
    index: Grams  # of long items: item << 32 | place in it
    short: list[Grams]  # of items to be found as they are, by q: window of the first q-gram

    @classmethod
    def of(cls, items: list[tuple[int, str | None]], window: int = WINDOW, step: int = STEP, q: int = Q, max_error: float = MAX_ERROR):
        coded = [(item, normal_codes(text or "")) for item, text in items]
        long = [(item, codes) for item, codes in coded if len(codes) >= max(MIN_CHARS, q)]
        brief = [(item, codes) for item, codes in coded if 0 < len(codes) < max(MIN_CHARS, q)]
        owners, patterns, starts, first = [], [], [], [0]
        for item, codes in long:
            last = max(0, len(codes) - window)
            for at in sorted({*range(0, last, step), last}):
                owners.append(item)
                patterns.append(codes[at : at + window])
                starts.append(at)
            first.append(len(patterns))
        n = len(patterns)
        owners += [item for item, _ in brief]
        patterns += [codes for _, codes in brief]
        sizes = np.array([len(p) for p in patterns], dtype=np.int64)
        # The bound must ask for at least one shared q-gram.
        edits = np.maximum(np.minimum((sizes * max_error).astype(np.int64), sizes // q - 1), 0)
        edits[n:] = 0
        named = np.empty(len(owners), dtype=object)
        named[:] = owners
        hashes = [gram_hashes(codes, q) for _, codes in long]
        places = [(np.int64(k) << 32) + np.arange(len(h)) for k, h in enumerate(hashes)]
        short = []
        for size in sorted({min(q, len(codes)) for _, codes in brief}):
            own = [(n + k, codes) for k, (_, codes) in enumerate(brief) if min(q, len(codes)) == size]
            short.append(Grams([gram_hashes(c[:size], size) for _, c in own], [np.array([k]) for k, _ in own], size))
        return cls(
            named,
            patterns,
            edits,
            sizes + 1 - q * (edits + 1),
            np.array(starts + [0] * len(brief), dtype=np.int64),
            np.array(first, dtype=np.int64),
            step,
            Grams(hashes, places, q),
            short,
        )

    def matches(self, texts: list[str], window: int = WINDOW) -> pd.DataFrame:
        """(text, window, start, end, edits): verified matches, the best of each text and window."""
        found = []
        overlap = window + BAND + 4 * window // Q
        codes = [normal_codes(t) for t in texts]
        # Pieces: several short texts, or a part of a long one that overlaps the next.
        parts: list[tuple[int, int, np.ndarray, bool]] = []
        size = 0
        for t, c in enumerate(codes):
            for at in range(0, max(1, len(c) - overlap), PIECE):
                parts.append((t, at, c[at : at + PIECE + overlap], at + PIECE + overlap >= len(c)))
                size += len(parts[-1][2]) + overlap
                if size >= PIECE:
                    found += self._matches(parts, overlap, window)
                    parts, size = [], 0
        if parts:
            found += self._matches(parts, overlap, window)
        every = pd.concat(found) if found else self._none()
        return every.sort_values(["text", "window", "edits", "start"]).drop_duplicates(["text", "window"])

    @staticmethod
    def _none() -> pd.DataFrame:
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("text", "window", "start", "end", "edits")})

    def _matches(self, parts: list[tuple[int, int, np.ndarray, bool]], gap: int, window: int) -> list[pd.DataFrame]:
        """Matches in parts of texts: (text, place of the part, codes, whether the text ends there)."""
        sizes = np.array([len(c) for _, _, c, _ in parts])
        starts = np.cumsum(sizes + gap) - sizes  # each part stands behind a gap that matches nothing
        codes = np.zeros(int(starts[-1] + sizes[-1]) + gap, np.uint32)
        for at, (_, place, c, whole) in zip(starts, parts):
            codes[at : at + len(c)] = c
            codes[at - 1] = place > 0  # what lies beyond a cut is unknown, so no word border
            codes[at + len(c)] = not whole
        at, row = self.index.known(codes)
        many = int((self.index.first[row + 1] - self.index.first[row]).sum())
        if many > HITS and len(parts) > 1:
            half = len(parts) // 2
            return self._matches(parts[:half], gap, window) + self._matches(parts[half:], gap, window)
        if many > HITS and sizes[0] > 4 * gap:
            text, place, c, whole = parts[0]
            half = len(c) // 2
            before = self._matches([(text, place, c[: half + gap], False)], gap, window)
            return before + self._matches([(text, place + half, c[half:], whole)], gap, window)
        which, ends, edits = (np.concatenate(x) for x in zip(self._similar(codes, at, row, window), self._verbatim(codes)))
        length = np.array([len(self.patterns[w]) for w in which], dtype=np.int64)
        part = np.maximum(np.searchsorted(starts, ends - 1, side="right") - 1, 0)
        base = np.array([p[1] for p in parts])[part] - starts[part]
        return [
            pd.DataFrame(
                {
                    "text": np.array([p[0] for p in parts])[part],
                    "window": which,
                    "start": np.maximum(ends - length, starts[part]) + base,
                    "end": ends + base,
                    "edits": edits,
                }
            )
        ]

    def _verbatim(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, end, edits) of short items that stand between word borders."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for grams in self.short:
            at, which = grams.hits(*grams.known(codes))
            length = np.array([len(self.patterns[w]) for w in which], dtype=np.int64)
            fits = at + length < len(codes)
            at, which, length = at[fits], which[fits], length[fits]
            order = np.argsort(which, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(which[order])) + 1) if len(order) else []:
                pattern, place = self.patterns[which[own[0]]], at[own]
                for i in range(grams.q, len(pattern)):
                    place = place[codes[place + i] == pattern[i]]
                before, after = codes[place - 1], codes[place + len(pattern)]
                free = (before == 0) | (before == 32) | (before >= UNSPACED) | bool(pattern[0] >= UNSPACED)
                free &= (after == 0) | (after == 32) | (after >= UNSPACED) | bool(pattern[-1] >= UNSPACED)
                found.append((np.full(int(free.sum()), which[own[0]]), place[free] + len(pattern)))
        which, ends = (np.concatenate(x) for x in zip(*found))
        return which, ends, np.zeros(len(which), np.int64)

    def _similar(self, codes: np.ndarray, at: np.ndarray, row: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, end, edits) of windows that lie in ``codes`` within their edits."""
        none = np.zeros(0, np.int64)
        if not len(at):
            return none, none, none
        text_at, place = self.index.hits(at, row)
        item, place = place >> 32, place & LOW
        # Diagonals are counted from the longest item's length before the piece, so they are positive.
        base = int(place.max())
        diagonal = text_at - place + base
        slack = int(self.edits.max())
        band = diagonal // BAND
        second = np.flatnonzero((diagonal % BAND < slack) & (band > 0))  # also in the reach of the band before
        keys = np.concatenate([item * (1 << 32) + band, item[second] * (1 << 32) + band[second] - 1])
        place = np.concatenate([place, place[second]])
        _, group, counts = np.unique(keys, return_inverse=True, return_counts=True)
        busy = counts[group] >= self.needed[self.first[keys >> 32]]
        keys, place = keys[busy], place[busy]
        if not len(keys):
            return none, none, none
        # Every window that holds the q-gram: those from the one that ends with it to the one that begins with it.
        item, q = keys >> 32, self.index.q
        reach = (window - q) // self.step + 2
        nth = place[:, None] // self.step + 1 - np.arange(reach + 1)
        able = (nth >= 0) & (nth < (self.first[item + 1] - self.first[item])[:, None])
        hit, _ = np.nonzero(able)
        which = self.first[item[hit]] + nth[able]
        size = np.minimum(window, self.needed[which] - 1 + q * (self.edits[which] + 1))
        inside = (self.starts[which] <= place[hit]) & (place[hit] + q <= self.starts[which] + size)
        pairs, counts = np.unique((which << 32 | (keys[hit] & LOW))[inside], return_counts=True)
        which, band = pairs >> 32, pairs & LOW
        enough = counts >= self.needed[which]
        which, band = which[enough], band[enough]
        first = band * BAND - base + self.starts[which]
        ends = np.full(len(which), -1, np.int64)
        edits = np.full(len(which), -1, np.int64)
        for k in range(0, len(which), ALIGNED):
            ends[k : k + ALIGNED], edits[k : k + ALIGNED] = self._aligned(codes, which[k : k + ALIGNED], first[k : k + ALIGNED], slack)
        good = edits <= self.edits[which]
        return which[good], ends[good], edits[good]

    def _aligned(self, codes: np.ndarray, which: np.ndarray, first: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
        """(end, edits) of the best alignment of each window on the diagonals from ``first`` on, ``slack`` around them."""
        width = BAND + 3 * slack
        size = np.array([len(self.patterns[w]) for w in which], dtype=np.int64)
        longest = int(size.max()) if len(size) else 0
        pattern = np.zeros((len(which), longest), np.int32)
        for row, w in enumerate(which):
            pattern[row, : size[row]] = self.patterns[w]
        front = slack + longest + BAND + slack  # a window may begin before the text does
        padded = np.concatenate([np.zeros(front, np.uint32), codes, np.zeros(width + longest + slack, np.uint32)]).astype(np.int32)
        begin = first + front - slack  # lane 0 is ``slack`` before the band
        best, end = np.full(len(which), longest + 1, np.int64), np.zeros(len(which), np.int64)
        # Windows that stand there as they are need no alignment.
        row, at = (x.reshape(-1) for x in np.indices((len(which), width)))
        for i in range(longest):
            same = (padded[begin[row] + at + i] == pattern[row, i]) | (i >= size[row])
            row, at = row[same], at[same]
        row, one = np.unique(row, return_index=True)
        best[row], end[row] = 0, first[row] - slack + at[one] + size[row]
        rest = np.setdiff1d(np.arange(len(which)), row)
        begin, pattern, lane = begin[rest], pattern[rest], np.arange(width, dtype=np.int16)
        cost = np.zeros((len(rest), width), np.int16)  # a match may start on any diagonal
        for i in range(longest):
            step = cost + (padded[begin[:, None] + (lane + i)] != pattern[:, i : i + 1])
            step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + np.int16(1))
            cost = np.minimum.accumulate(step - lane, axis=1) + lane
            last = np.flatnonzero(size[rest] == i + 1)
            if len(last):
                lowest = np.argmin(cost[last], axis=1)
                best[rest[last]] = cost[last, lowest]
                end[rest[last]] = first[rest[last]] - slack + lowest + i + 1
            if i % 8 == 7:  # costs never fall again
                open_ = (cost.min(axis=1) <= self.edits[which[rest]]) & (size[rest] > i + 1)
                rest, begin, pattern, cost = rest[open_], begin[open_], pattern[open_], cost[open_]
        return end, best


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS, **shape) -> Iterator[Windows]:
    """Indexes of ``benchmark`` (item_id, text), each over a bounded number of characters."""
    slim = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    total = slim.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = total // block_chars + 1
    for k in range(n):
        mine = slim.where(F.pmod(F.xxhash64("text", F.lit("block")), F.lit(n)) == k) if n > 1 else slim
        yield Windows.of([(r["item_id"], r["text"]) for r in mine.collect()], **shape)


def leaks(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, n_windows, start, end, edits: one row per document and item with a matching window.

    Null texts are empty. Rows of one doc_id are taken together; items of one item_id too. No match, no row.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = benchmark.schema["item_id"].dataType
    schema = f"doc_id long, item_id {kind.simpleString()}, window long, start long, end long, edits long"
    item_type = to_arrow_type(kind)
    found = None
    for number, windows in enumerate(blocks(benchmark, block_chars)):
        given = shared(docs.sparkSession, windows)

        def search(batches: Iterator[pa.RecordBatch], given=given, number=number) -> Iterator[pa.RecordBatch]:
            for batch in (part for whole in batches for part in slices(whole)):
                rows = given().matches([t or "" for t in batch.column(1).to_pylist()])
                ids = batch.column(0).take(pa.array(rows["text"].to_numpy(), pa.int64()))
                items = pa.array(given().items[rows["window"].to_numpy()].tolist(), item_type)
                rest = [pa.array(rows[c].to_numpy(), pa.int64()) for c in ("start", "end", "edits")]
                window = pa.array(rows["window"].to_numpy() + (number << 32), pa.int64())
                yield pa.RecordBatch.from_arrays([ids, items, window, *rest], ["doc_id", "item_id", "window", "start", "end", "edits"])

        one = slim.mapInArrow(search, schema)
        found = one if found is None else found.unionByName(one)
    return found.groupBy("doc_id", "item_id").agg(
        F.countDistinct("window").alias("n_windows"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("edits").alias("edits")
    )


def leak_test(spark: SparkSession, windows: Windows):
    """A column function: whether a text has a passage of one of these windows."""
    given = shared(spark, windows)

    def leaked_of(texts: list[str | None]) -> np.ndarray:
        rows = given().matches([t or "" for t in texts])
        return np.isin(np.arange(len(texts)), rows["text"].to_numpy())

    @F.pandas_udf("boolean")
    def leaked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [leaked_of(part) for part in texts_of(texts)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0, dtype=bool))

    return leaked


def clean(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` without a benchmark passage, all columns kept. Each row is judged by its own text."""
    for windows in blocks(benchmark, block_chars):
        docs = docs.where(~leak_test(docs.sparkSession, windows)(F.col("text").cast("string")))
    return docs
