from __future__ import annotations

import math
import random

import duckdb
import pandas as pd
import pytest

from corpus_fixtures import make, tables  # noqa: F401
from hostvane.llm import mixing as M


def corpus():
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(0, 9), "en", "big") for i in range(900)]
    rows += [(1000 + i, "one two three", "en", f"small{i % 3}") for i in range(120)]
    rows += [(2000 + i, "  ", "en", "blank") for i in range(5)]
    rows += [(3000, None, "en", None), (3001, "a b", "en", None), (3002, "c", "en", ""), (None, "x y", "en", "big"), (5, "again", "en", "big")]
    return rows


@pytest.mark.parametrize("evenness", [0.0, 0.5, 0.95])
def test_against_sql(make, evenness, monkeypatch):  # noqa: F811
    monkeypatch.setattr(M, "BLOCK_DOCS", 7)
    rows = corpus()
    got = sorted(map(tuple, M.mixed(make(rows), evenness=evenness, budget="all").collect()), key=str)
    db = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"})
    db.register("documents", frame)
    assert got == sorted(db.execute(M.oracle_sql(evenness)).fetchall(), key=str)


def weights_of(mix):
    return {r["source"]: r.asDict() for r in mix.sources.collect()}


def test_entropy_target_is_met_and_budgets_are_kept(make):  # noqa: F811
    docs = make(corpus())
    mix = M.plan(docs, entropy=1.2, budget=5000)
    told = weights_of(mix)
    p = [r["weight"] for r in told.values() if r["weight"]]
    assert sum(p) == pytest.approx(1) and -sum(x * math.log(x) for x in p) == pytest.approx(1.2, abs=1e-4)
    spent = {}
    for r in M.realise(docs, mix).select("source", M.n_tokens(M.F.col("row.text")).alias("n")).collect():
        spent[r["source"]] = spent.get(r["source"], 0) + r["n"]
    longest = 9
    for name, r in told.items():
        if r["tokens"]:
            assert r["quota"] - longest < spent[name] <= r["quota"]


def test_every_document_appears_and_none_too_often(make):  # noqa: F811
    docs = make(corpus())
    mix = M.plan(docs, max_repeats=2.5)
    seen = {}
    for r in M.realise(docs, mix).select("row.doc_id", "row.text", "row.n").collect():
        assert r["n"] == 1  # columns that clash come through
        seen[r["doc_id"], r["text"]] = seen.get((r["doc_id"], r["text"]), 0) + 1
    assert {(i, t) for i, t, _, _ in corpus()} == set(seen)
    told = weights_of(mix)
    repeats = {s: r["quota"] / r["tokens"] for s, r in told.items() if r["tokens"]}
    smallest = min((s for s in repeats), key=lambda s: told[s]["tokens"])  # the one that hits the limit
    p = {s: told[s]["weight"] / told[s]["tokens"] for s in repeats}
    assert p[smallest] / min(p.values()) == pytest.approx(2.5, abs=0.02) and max(repeats.values()) <= 2.5
    assert max(seen.values()) <= 3 and told["big"]["full"] == 1


def test_passes_have_orders_of_their_own(make):  # noqa: F811
    docs = make([(i, "a b c", "en", "s" if i % 50 else "t") for i in range(3000)])
    rows = M.mixed(docs, evenness=1.0, budget=20_000).where("source = 't'").collect()
    order = [[r["doc_id"] for r in sorted(rows, key=lambda r: r["place"]) if r["epoch"] == e] for e in (0, 1)]
    assert sorted(order[0]) == sorted(order[1])
    assert len({r["epoch"] for r in rows}) > 10


def test_one_source_empty_table_and_bad_calls(make):  # noqa: F811
    one = make([(i, "a b", "en", "only") for i in range(10)])
    assert M.mixed(one, evenness=0.3, budget="all").count() == 10
    assert M.mixed(make([]), evenness=0.3).collect() == []
    blank = make([(1, "", "en", "a"), (2, None, "en", "b")])
    assert M.mixed(blank, max_repeats=2.0).count() == 2
    with pytest.raises(ValueError):
        M.plan(one, evenness=0.5, entropy=1.0)


def test_entropies_out_of_reach_are_refused(make):  # noqa: F811
    two = make([(i, "a b", "en", "s" if i % 11 else "t") for i in range(2100)])
    near = make([(i, "a b", "en", "s" if i < 52 else "t") for i in range(100)])
    for docs, entropy in ((two, 0.001), (near, 0.1)):  # the second needs an exponent beyond the first bracket
        told = weights_of(M.plan(docs, entropy=entropy, budget="all"))
        p = [r["weight"] for r in told.values()]
        assert -sum(x * math.log(x) for x in p if x) == pytest.approx(entropy, abs=1e-3)
    for entropy in (-0.1, 0.8):
        with pytest.raises(ValueError, match="entropy must be between"):
            M.plan(two, entropy=entropy)
