from __future__ import annotations

import hashlib

import pytest

from corpus_fixtures import make  # noqa: F401
from hostvane.llm import exact_dedup as E
from hostvane.llm.exact_dedup import build, exact_duplicates

ROWS = [
    (1, "Abc"), (2, "aBC"), (3, "abc "), (4, None), (5, ""), (6, "ÄB"), (7, "äb"), (8, "Äb"), (9, "x" * 200_000),
    (10, "X" * 200_000), (10, "X" * 200_000), (11, "abc"), (None, "abc"), (None, "lonely"), (12, "a\nb"), (13, "a b"),
]


def brute(rows):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    body = [(i, (t or "").translate(lower)) for i, t in rows]
    out = []
    for i, t in body:
        ids = [j for j, u in body if u == t]
        named = [j for j in ids if j is not None]
        keep = max(named) if named else None
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("index", [{}, {"key_bits": 2}, {"bucket_keys": 1, "max_depth": 5}, {"key_bits": 3, "bucket_keys": 1}])
def test_against_brute_force(make, index):  # noqa: F811
    """Short keys collide all the time: the bytes decide. A small bucket makes the directory double."""
    assert sorted(map(tuple, exact_duplicates(make(ROWS), **index).collect()), key=str) == brute(ROWS)


def test_empty_table(make):  # noqa: F811
    assert exact_duplicates(make([])).collect() == []


def test_directory_covers_every_key_and_bounds_buckets(make):  # noqa: F811
    rows = [(i, f"text {i}") for i in range(400)]
    index = build(make(rows), bucket_keys=20, max_depth=10)
    pages = index.pages.collect()
    assert len(pages) == 400
    held = {}
    for p in pages:
        held[p["depth"], p["bucket"]] = held.get((p["depth"], p["bucket"]), 0) + 1
    assert max(held.values()) <= 20 and len({d for d, _ in held}) >= 1
    # a bucket is the leading bits of its keys, and half its range would not do
    for p in pages:
        assert (p["key"] % (1 << 64)) >> (64 - p["depth"]) == p["bucket"]


def test_a_large_index_has_larger_buckets(make, monkeypatch):  # noqa: F811
    """No bucket stays overfull when there are more keys than the directory has room for."""
    monkeypatch.setattr(E, "BUCKET_KEYS", 5)
    rows = [(i, f"text {i}") for i in range(1000)]
    index = build(make(rows), max_depth=5)  # 32 cells of about 31 keys
    held = {(r["depth"], r["bucket"]): r["count"] for r in index.pages.groupBy("depth", "bucket").count().collect()}
    assert sum(held.values()) == 1000 and max(held.values()) <= 125
    assert sorted(map(tuple, exact_duplicates(make(rows), max_depth=5).collect()), key=str) == brute(rows)


def test_lookup_stays_inside_the_bucket(make):  # noqa: F811
    plan = exact_duplicates(make(ROWS))._jdf.queryExecution().optimizedPlan().toString()
    assert "depth#" in plan.split("Join Inner", 1)[1].split("\n")[0] and "bucket#" in plan.split("Join Inner", 1)[1].split("\n")[0]
