"""SimHash near-duplicates: fingerprints of word shingles, linked through a Gray-order hierarchical index.

Fingerprint: words are runs of anything but ASCII white space, after lower-casing A-Z; shingles are consecutive
words joined by spaces, repeats included; every shingle votes with the bits of its XXH64. A bit of the
fingerprint is set if it is set in over half of the shingles. A text with fewer words than a shingle is one
shingle; a text without words has fingerprint zero and links like any other.

Linking: of ``max_bits + 1`` bands of bits, two fingerprints within ``max_bits`` agree in at least one; for very many
fingerprints there are more bands, and every choice of enough of them is one mask, so that a mask value stays rare. For every
mask, fingerprints are dealt out by their value of it, so that pairs meet without comparing all. Inside such a
cell they are sorted by Gray rank, which puts similar ones next to each other, and factored into a tree: a node holds the
bits that all fingerprints below share and that no node above it holds. A search adds up differences from the
root down and drops whole groups as soon as the sum passes the limit. Cells give a spanning set of links, never
all pairs, so a group of n similar texts costs n links.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostvane.llm.components import components
from hostvane.llm.workers import slices
from hostvane.operators.joins import join_checked
from hostvane.session import materialize

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
BITS = 64
CELL = 16_000  # fingerprints that one task compares at once
FAN = 8
FRONTIER = 1 << 19  # open (query, node) pairs held at once
BATCH_BYTES = 1 << 20

BLANK = re.compile(rb"[\x20\x09-\x0D]")

U = np.uint64
# The primes of XXH64.
P1 = U(0x9E3779B185EBCA87)
P2 = U(0xC2B2AE3D27D4EB4F)
P3 = U(0x165667B19E3779F9)
P4 = U(0x85EBCA77C2B2AE63)
P5 = U(0x27D4EB2F165667C5)


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U(by)) | (x >> U(64 - by))


def _lane(x: np.ndarray) -> np.ndarray:
    return _rotated(x * P2, 31) * P1


def xxh64(raw: bytes, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of each slice of ``raw``, all slices of one step at a time."""
    sizes = ends - starts
    padded = raw + b"\0" * 8
    eights = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
    fours = np.ndarray(len(raw) + 1, "<u4", padded, strides=(1,))
    ones = np.frombuffer(padded, np.uint8)
    at, seed64 = starts.copy(), U(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(starts), seed64 + P5, U)
        long = np.flatnonzero(sizes >= 32)
        if len(long):
            state = [np.full(len(long), s, U) for s in (seed64 + P1 + P2, seed64 + P2, seed64, seed64 - P1)]
            stripes = sizes[long] // 32
            for k in range(int(stripes.max())):
                go = np.flatnonzero(stripes > k)
                base = at[long[go]] + 32 * k
                for j in range(4):
                    state[j][go] = _rotated(state[j][go] + eights[base + 8 * j] * P2, 31) * P1
            merged = _rotated(state[0], 1) + _rotated(state[1], 7) + _rotated(state[2], 12) + _rotated(state[3], 18)
            for part in state:
                merged = (merged ^ _lane(part)) * P1 + P4
            h[long] = merged
            at[long] += 32 * stripes
        h += sizes.astype(U)
        left = ends - at
        for k in range(3):
            go = np.flatnonzero(left >= 8 * (k + 1))
            h[go] = _rotated(h[go] ^ _lane(eights[at[go] + 8 * k]), 27) * P1 + P4
        at += left // 8 * 8
        left = ends - at
        go = np.flatnonzero(left >= 4)
        h[go] = _rotated(h[go] ^ (fours[at[go]].astype(U) * P1), 23) * P2 + P3
        at[go] += 4
        left = ends - at
        for k in range(3):
            go = np.flatnonzero(left > k)
            h[go] = _rotated(h[go] ^ (ones[at[go] + k].astype(U) * P5), 11) * P1
        h = (h ^ (h >> U(33))) * P2
        h = (h ^ (h >> U(29))) * P3
        return h ^ (h >> U(32))


def votes_of(texts: list[bytes], shingle_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles that set each bit, shingles) of each text."""
    joined = [b" ".join(t.lower().split()) for t in texts]
    raw = b"\n".join(joined)
    votes, shingles = np.zeros((len(texts), BITS), np.int64), np.zeros(len(texts), np.int64)
    sizes = np.array([len(j) for j in joined], dtype=np.int64)
    doc_start = np.cumsum(sizes + 1) - sizes - 1
    some = np.flatnonzero(sizes)
    if not len(some):
        return votes, shingles
    chars = np.frombuffer(raw, np.uint8)
    breaks = np.flatnonzero((chars == 32) | (chars == 10))
    starts, ends = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(raw)]])
    real = ends > starts  # an empty text leaves an empty word
    starts, ends = starts[real], ends[real]
    first = np.searchsorted(starts, doc_start[some])
    words = np.diff(np.append(first, len(starts)))
    many = np.maximum(words - shingle_words + 1, 1)
    offset = np.cumsum(many) - many
    word = np.arange(int(many.sum())) - np.repeat(offset - first, many)
    last = word + np.repeat(np.minimum(words, shingle_words), many) - 1
    hashes = xxh64(raw, starts[word], ends[last])
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, BITS // 8), axis=1)
    votes[some] = np.add.reduceat(bits, offset, axis=0, dtype=np.int64)
    shingles[some] = many
    return votes, shingles


def votes_in_pieces(text: bytes, shingle_words: int, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """``votes_of`` one long text, cut at white space; words that a shingle still needs are carried on."""
    votes, shingles = np.zeros((1, BITS), np.int64), np.zeros(1, np.int64)
    held: list[bytes] = []
    at = 0
    while at < len(text):
        cut = BLANK.search(text, at + piece)
        end = cut.end() if cut else len(text)
        held += text[at:end].split()
        at = end
        if len(held) >= shingle_words:
            more, n = votes_of([b" ".join(held)], shingle_words)
            votes, shingles = votes + more, shingles + n
            held = held[len(held) - shingle_words + 1 :]
    return (votes, shingles) if shingles[0] else votes_of([b" ".join(held)], shingle_words)


def fingerprints_of(texts: list[bytes], shingle_words: int = SHINGLE_WORDS, piece: int = BATCH_BYTES) -> np.ndarray:
    """Fingerprints of UTF-8 texts. Votes of a text longer than ``piece`` are added up in parts."""
    votes, shingles = votes_of([t if len(t) <= piece else b"" for t in texts], shingle_words)
    for k in (k for k, t in enumerate(texts) if len(t) > piece):
        more, n = votes_in_pieces(texts[k], shingle_words, piece)
        votes[k], shingles[k] = more[0], n[0]
    return np.packbits(votes * 2 > shingles[:, None], axis=1).view(">u8").reshape(-1).astype(U)


def _fingerprint(shingle_words: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            k = 0
            while k < len(texts):
                end, size = k, 0
                while end < len(texts) and size < BATCH_BYTES:
                    size += len(texts[end] or b"")
                    end += 1
                found = fingerprints_of([t or b"" for t in texts[k:end]], shingle_words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, end - k), pa.array(found.view(np.int64))], ["doc_id", "fp"]
                )
                k = end

    return emit


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) of whole texts; ``fp`` has the 64 bits as a signed long. A null text is empty."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_fingerprint(shingle_words), "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence, in which neighbours differ in one bit."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> U(shift)
    return rank


class GrayTree:
    """Codes in Gray order under nodes that hold the bits shared by all codes below."""

    def __init__(self, codes: np.ndarray, fan: int = FAN):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.fan = fan
        shared = [(codes[self.order], np.full(len(codes), ~U(0)))]  # (pattern, bits it fixes), leaves first
        while len(shared[-1][0]) > fan:
            pattern, fixed = shared[-1]
            at = np.arange(0, len(pattern), fan)
            ones = np.bitwise_and.reduceat(pattern & fixed, at)
            zeros = np.bitwise_and.reduceat(~pattern & fixed, at)
            shared.append((ones, ones | zeros))
        self.levels = []
        for k, (pattern, fixed) in enumerate(shared):
            if k + 1 < len(shared):  # what the parent holds is not held again
                above = np.repeat(shared[k + 1][1], fan)[: len(fixed)]
                fixed = fixed & ~above
            self.levels.append((pattern, fixed))

    def links(self, codes: np.ndarray, max_bits: int, exact: np.uint64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, found) positions of pairs within ``max_bits`` that agree on the ``exact`` bits, in bounded pieces."""
        top = len(self.levels) - 1
        roots = len(self.levels[top][0])
        step = max(1, FRONTIER // max(roots, 1))
        for begin in range(0, len(codes), step):
            asked = np.arange(begin, min(begin + step, len(codes)))
            stack = [(top, np.repeat(asked, roots), np.tile(np.arange(roots), len(asked)), np.zeros(len(asked) * roots, np.uint8))]
            while stack:
                level, query, node, sum_ = stack.pop()
                if len(query) > FRONTIER:
                    half = len(query) // 2
                    stack.append((level, query[half:], node[half:], sum_[half:]))
                    stack.append((level, query[:half], node[:half], sum_[:half]))
                    continue
                pattern, fixed = self.levels[level]
                differ = (codes[query] ^ pattern[node]) & fixed[node]
                sum_ = sum_ + np.bitwise_count(differ)
                keep = (sum_ <= max_bits) & ((differ & exact) == 0)
                query, node, sum_ = query[keep], node[keep], sum_[keep]
                if level == 0:
                    yield query, self.order[node]
                elif len(query):
                    n = len(self.levels[level - 1][0])
                    below = (node[:, None] * self.fan + np.arange(self.fan)).reshape(-1)
                    real = below < n
                    stack.append((level - 1, np.repeat(query, self.fan)[real], below[real], np.repeat(sum_, self.fan)[real]))


def spanning_links(codes: np.ndarray, max_bits: int, exact: np.uint64) -> np.ndarray:
    """For each code the position of the least code reachable through pairs within ``max_bits`` in this cell."""
    label = np.arange(len(codes))

    def settle() -> None:
        while True:
            up = label[label]
            if np.array_equal(up, label):
                return
            label[:] = up

    for query, found in GrayTree(codes).links(codes, max_bits, exact):
        while True:
            a, b = label[query], label[found]
            apart = a != b
            if not apart.any():
                break
            low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            np.minimum.at(label, high, low)
            settle()
    return label


def _cell_links(max_bits: int):
    def emit(table: pa.Table) -> pa.Table:
        codes = np.unique(table.column("fp").to_numpy()).view(U)
        exact = np.asarray(table.column("exact").to_numpy()[:1]).view(U)[0]
        label = spanning_links(codes, max_bits, exact)
        linked = np.flatnonzero(label != np.arange(len(codes)))
        return pa.table({"a": codes[linked].view(np.int64), "b": codes[label[linked]].view(np.int64)})

    return emit


def band_masks(max_bits: int, bands: int | None = None) -> list[int]:
    """Masks of which any two fingerprints within ``max_bits`` agree on at least one.

    The 64 bits are cut into ``bands``; differing bits fall into ``max_bits`` of them at most, so every choice of the others is a mask.
    """
    n = bands or max_bits + 1
    cuts = [BITS * k // n for k in range(n + 1)]
    own = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(cuts, cuts[1:])]
    return [sum(kept) for kept in combinations(own, n - max_bits)]


def bands_for(n: int, max_bits: int, cell: int) -> int:
    """The least number of bands that leaves a usual mask value a small part of a cell among ``n`` fingerprints."""
    bands = max_bits + 1
    while bands < 2 * max_bits + 2 and n > (cell << (BITS * (bands - max_bits) // bands)) // 4:
        bands += 1
    return bands


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def links(distinct: DataFrame, max_bits: int = MAX_BITS, cell: int = CELL, bands: int | None = None) -> DataFrame:
    """(a, b) links that connect the same fingerprints as all pairs of ``distinct`` (fp) within ``max_bits``.

    Band values are gathered into cells of about ``cell`` fingerprints. A band value that alone has more is cut
    into shares, and every pair of shares meets in a cell of its own.
    """
    n = distinct.count()
    masks = [_signed(m) for m in band_masks(max_bits, bands or bands_for(n, max_bits, cell))]
    exploded = distinct.select("fp", F.explode(F.array(*[F.lit(m) for m in masks])).alias("exact")).withColumn(
        "value", F.col("fp").bitwiseAND(F.col("exact"))
    )
    cells = max(1, -(-n // cell))
    sizes = exploded.groupBy("exact", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell)
    shares = F.ceil(F.col("n") / cell).cast("int").alias("shares")
    dealt = join_checked(exploded, sizes.select("exact", "value", shares), ["exact", "value"], "left")
    small = dealt.where("shares IS NULL").select(
        "fp", "exact", F.pmod(F.xxhash64("value"), F.lit(cells)).alias("cell"), F.lit(0).alias("i"), F.lit(0).alias("j")
    )
    own = F.pmod(F.xxhash64("fp", F.lit(SEED)), F.col("shares")).cast("int")
    large = dealt.where("shares IS NOT NULL").withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))
    ).select(
        "fp", "exact", F.col("value").alias("cell"),
        F.least("own", "other").alias("i"), (F.greatest("own", "other") + 1).alias("j"),
    )
    ids = ["exact", "cell", "i", "j"]
    dealt = small.unionByName(large).repartition(cells * len(masks), *ids)  # by work, not by bytes
    return dealt.groupBy(*ids).applyInArrow(_cell_links(max_bits), "a long, b long")


def near_duplicates(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, cell: int = CELL
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint, component_id.

    ``component_id`` is the smallest doc_id reachable through fingerprints at ``max_bits`` or fewer differing bits.
    Null doc_ids count as rows but never name a component. An empty table gives no rows.
    """
    marked = materialize(fingerprints(docs, shingle_words), "fingerprints")
    least = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    found = components(links(least.select("fp"), max_bits, cell)).withColumnRenamed("node", "fp")
    grouped = least.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    answer = materialize(grouped.join(named, "component").select("fp", "component_id"), "components")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return join_checked(marked, answer, ["fp"], stored=True).select("doc_id", hexed.alias("fingerprint"), "component_id")
