"""Canonical, length-limited Huffman codes over integer ids, with numpy."""

from __future__ import annotations

import numpy as np

CHECKPOINT = 256  # ids between two stored bit offsets


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` for every id with a count (0 for the rest), by package-merge."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids do not fit codes of {max_bits} bits")
    used = used[np.lexsort((used, counts[used]))]
    leaves = counts[used].astype(np.int64)
    row, is_leaf = leaves, [np.ones(len(leaves), dtype=bool)]
    for _ in range(max_bits - 1):
        paired = row[: len(row) // 2 * 2]
        row = np.concatenate([leaves, paired[0::2] + paired[1::2]])
        order = np.argsort(row, kind="stable")
        row = row[order]
        is_leaf.append(order < len(leaves))
    depth, take = np.zeros(len(leaves), dtype=np.int64), 2 * len(leaves) - 2
    for leaf in reversed(is_leaf):
        n = int(leaf[:take].sum())
        depth[:n] += 1
        take = 2 * (take - n)
    lengths[used] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    if len(used):
        width = int(lengths[used].max())
        spans = np.uint64(1) << (width - lengths[used].astype(np.int64)).astype(np.uint64)
        starts = np.cumsum(spans) - spans
        codes[used] = starts >> (width - lengths[used].astype(np.int64)).astype(np.uint64)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(bits read at once, id and code length for each value of those bits)."""
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    width = int(lengths[used].max()) if len(used) else 1
    spans = 1 << (width - lengths[used].astype(np.int64))
    ids, sizes = np.zeros(1 << width, dtype=np.uint32), np.ones(1 << width, dtype=np.uint8)
    n = int(spans.sum())
    ids[:n], sizes[:n] = np.repeat(used, spans), np.repeat(lengths[used], spans)
    return width, ids, sizes


def encode(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bits, bit offsets of every CHECKPOINT-th id). Codes are put into 32-bit words, high bits first."""
    sizes = lengths[ids].astype(np.int64)
    ends = np.cumsum(sizes)
    at = ends - sizes
    total = int(ends[-1]) if len(ids) else 0
    value = codes[ids] << (64 - (at & 31) - sizes).astype(np.uint64)
    word, n = at >> 5, (total + 31) // 32 + 1
    # A word takes disjoint bits from its ids, so sums are exact: below 2**32 in a double.
    filled = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n)
    filled += np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n)[:n]
    return filled.astype(np.uint32).astype(">u4").tobytes()[: (total + 7) // 8], at[::CHECKPOINT]


def decode(bits: bytes, n: int, checkpoints: np.ndarray, table: tuple[int, np.ndarray, np.ndarray]) -> np.ndarray:
    """All ``n`` ids; the runs between checkpoints are independent and advance side by side."""
    width, symbol, size = table
    raw = np.frombuffer(bits + b"\0" * 8, dtype=np.uint8).astype(np.uint64)
    m = len(bits) + 1
    window = (raw[:m] << np.uint64(32)) | (raw[1 : m + 1] << np.uint64(24)) | (raw[2 : m + 2] << np.uint64(16))
    window |= (raw[3 : m + 3] << np.uint64(8)) | raw[4 : m + 4]  # 40 bits from every byte on
    out = np.zeros((len(checkpoints), CHECKPOINT), dtype=np.uint32)
    at, mask = checkpoints.astype(np.int64), np.uint64((1 << width) - 1)
    for step in range(min(CHECKPOINT, n)):
        if step and step == n - (len(checkpoints) - 1) * CHECKPOINT:
            at = at[:-1]  # the last run is shorter
            if not len(at):
                break
        seen = (window[at >> 3] >> (40 - width - (at & 7)).astype(np.uint64)) & mask
        out[: len(at), step] = symbol[seen]
        at = at + size[seen]
    return out.reshape(-1)[:n]
