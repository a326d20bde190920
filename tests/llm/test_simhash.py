from __future__ import annotations

import random
import re

import numpy as np
import xxhash

from hostvane.llm import simhash as S
from hostvane.llm.queries import QUERIES
from corpus_fixtures import components_of, make, tables  # noqa: F401


def brute(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def linked_within(codes, bits):
    return components_of(len(codes), lambda a, b: bin(codes[a] ^ codes[b]).count("1") <= bits)


def test_fingerprints():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdÉé") for _ in range(rng.choice([1, 2, 5, 20, 90]))) for _ in range(99)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 4, 50]))) for _ in range(150)]
    texts += ["", "  \t\x0b A\x1cB c", "X" * 5000, "a b " * 3000, " ", "a\nb\rc\x0cd"]
    assert S.fingerprints_of([t.encode() for t in texts]).tolist() == [brute(t) for t in texts]
    assert len(S.fingerprints_of([])) == 0


def test_tree_links_what_brute_force_links():
    rng = np.random.default_rng(0)
    codes = [rng.integers(0, 2**63, 40, dtype=np.uint64)]
    for _ in range(4):
        codes.append(codes[-1] ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)))
    codes = np.unique(np.concatenate(codes))
    for bits in (0, 1, 2, 3, 5):
        assert S.spanning_links(codes, bits, np.uint64(0)).tolist() == linked_within(codes.tolist(), bits)


def test_gray_rank():
    codes = np.arange(1024, dtype=np.uint64)
    in_order = codes[np.argsort(S.gray_rank(codes))]
    assert (np.bitwise_count(in_order[1:] ^ in_order[:-1]) == 1).all()


def test_cells_and_shares_keep_all_links(spark):
    """With tiny cells, band values are cut into shares; the components stay the same."""
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    codes = {centre}
    while len(codes) < 90:
        c = rng.choice(sorted(codes))
        for _ in range(rng.choice([1, 3, 4])):
            c ^= 1 << rng.randrange(64)
        codes.add(c)
    codes = sorted(codes)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    df = spark.createDataFrame([(c,) for c in signed], "fp long")
    from hostvane.llm.components import components

    found = {r["node"]: r["component"] for r in components(S.links(df, 3, cell=7)).collect()}
    label = linked_within(codes, 3)
    mine = [found.get(c, c) for c in signed]
    for a in range(len(codes)):
        for b in range(a):
            assert (mine[a] == mine[b]) == (label[a] == label[b])


def test_edge_cases(make, spark):  # noqa: F811
    rows = [(5, None), (4, ""), (9, " \n "), (7, "One two three four"), (8, "one TWO three four"), (3, "a b"), (3, "a b"), (None, "a b"), (6, "w " * 50_000)]
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(make(rows)).collect()}
    want = {(i, f"{brute(t):016x}") for i, t in rows}
    assert {g[:2] for g in got} == want
    assert {g[0]: g[2] for g in got} == {5: 4, 4: 4, 9: 4, 7: 7, 8: 7, 3: 3, None: 3, 6: 6}
    assert S.near_duplicates(make([])).collect() == []


def test_registered_query(spark, tables):  # noqa: F811
    rows = spark.read.parquet(f"{tables}/documents.parquet").orderBy("doc_id").collect()
    codes = [brute(r["text"]) for r in rows]
    label = linked_within(codes, 3)
    want = {r["doc_id"]: (f"{c:016x}", rows[k]["doc_id"]) for r, c, k in zip(rows, codes, label)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op4_simhash"](spark, tables).collect()} == want
