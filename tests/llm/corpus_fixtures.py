from __future__ import annotations

import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tables():
    if not os.path.isdir(SF):
        pytest.skip("driver tables are not here")
    return SF


@pytest.fixture(scope="session")
def make(spark):
    """Documents with columns that clash with names the operators use."""

    def build(rows, extra=True):
        full = [
            (i, t, lang, source, "x", 1, "y") for i, t, lang, source in ((*r, *("en", "s")[len(r) - 2 :])[:4] for r in rows)
        ]
        kind = "doc_id long, text string, lang string, source string, key string, n long, component string"
        df = spark.createDataFrame(full, kind)
        return df if extra else df.select("doc_id", "text", "lang", "source")

    return build


def components_of(n, linked):
    """Smallest member of each position's component, by brute force."""
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a in range(n):
            for b in range(a):
                if label[a] != label[b] and linked(a, b):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label
