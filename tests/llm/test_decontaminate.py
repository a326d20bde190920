from __future__ import annotations

import random

import numpy as np
import pytest

from corpus_fixtures import make, tables  # noqa: F401
from hostvane.llm import decontaminate as D
from hostvane.llm.queries import QUERIES


def form(text):
    return "".join(map(chr, D.normal_codes(text)))


def distance(pattern, text):
    """Least edits between the pattern and any part of the text."""
    codes, place = np.array([ord(c) for c in text], dtype=np.int64), np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, dtype=np.int64)
    for i, a in enumerate(pattern, 1):
        new = np.append(i, np.minimum(row[:-1] + (codes != ord(a)), row[1:] + 1))
        row = np.minimum.accumulate(new - place) + place
    return row.min()


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(n))


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        k = rng.randrange(len(out))
        out[k : k + 1] = rng.choice([[], [rng.choice("xyz ")], [out[k], rng.choice("xyz")]])
    return "".join(out)


def test_windows_against_brute_force():
    rng = random.Random(3)
    items = [(i, words(rng, rng.choice([9, 14, 30, 60]))) for i in range(6)]
    windows = D.Windows.of(items)
    texts = []
    for _ in range(16):
        _, text = rng.choice(items)
        texts.append(words(rng, 12) + " " + edited(rng, text, rng.choice([0, 2, 5, 9, 14])) + " " + words(rng, 9))
    texts += ["", "short", form(items[5][1])[:90]]
    found = {(r.text, r.window): r.edits for r in windows.matches(texts).itertuples()}
    for t, text in enumerate(texts):
        for w, pattern in enumerate(windows.patterns):
            least = distance("".join(map(chr, pattern)), form(text))
            assert found.get((t, w)) == (least if least <= windows.edits[w] else None)


def test_long_texts_are_cut_without_loss(monkeypatch):
    rng = random.Random(7)
    windows = D.Windows.of([(1, words(rng, 20))])
    passage = "".join(map(chr, windows.patterns[0]))
    monkeypatch.setattr(D, "PIECE", 300)
    for at in range(0, 900, 37):
        text = form(words(rng, 400))
        text = text[:at] + " " + passage + " " + text[at:]
        rows = windows.matches([text])
        assert 0 in set(rows["window"])
        best = rows[rows["window"] == 0].iloc[0]
        assert best["edits"] == 0 and form(text)[best["start"] : best["end"]] == passage


def test_edge_cases(make, spark):  # noqa: F811
    rng = random.Random(9)
    leak, other = words(rng, 40), words(rng, 40)
    items = [(1, leak), (2, None), (3, "too short"), (4, "--"), (5, leak.upper()), (6, "ha " * 60)]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, n_windows string")
    rows = [(1, other), (2, f"{other} -- {leak}! {other}"), (3, None), (4, ""), (None, leak), (5, "ha " * 30_000), (2, leak), (6, "h" * 50_000)]
    got = {(r.doc_id, r.item_id): r for r in D.leaks(make(rows), bench).collect()}
    assert set(got) == {(2, 1), (2, 5), (None, 1), (None, 5), (5, 6)}
    assert got[2, 1].edits == 0 and got[2, 1].start == 0
    kept = D.clean(make(rows), bench)
    assert kept.columns == make(rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 6]
    # a benchmark in several blocks gives the same
    again = {(r.doc_id, r.item_id): r for r in D.leaks(make(rows), bench, block_chars=100).collect()}
    assert again == got
    assert D.leaks(make([]), bench).collect() == []
    none = bench.where("item_id < 0")
    assert D.leaks(make(rows), none).collect() == [] and D.clean(make(rows), none).count() == len(rows)


def test_verbatim_excerpts_are_found_at_any_offset():
    """Every stretch of a window's length, wherever it begins, and with as many edits as the stride leaves room for."""
    rng = random.Random(4)
    items = [form(words(rng, 70)) for _ in range(3)]
    windows = D.Windows.of(list(enumerate(items)))
    for size, edits in ((80, 0), (81, 0), (90, 0), (130, 0), (80, 4)):
        texts = []
        for _ in range(100):
            item = rng.choice(items)
            at = rng.randrange(len(item) - size)
            part = list(item[at : at + size])
            for k in rng.sample(range(8, size - 8), edits):
                part[k] = "é"
            texts.append(words(rng, 5) + " " + "".join(part) + " " + words(rng, 5))
        assert set(windows.matches(texts)["text"]) == set(range(len(texts)))


def test_short_items_stand_between_word_borders():
    items = [(1, "What is the capital of Peru"), (2, "yes"), (3, "no"), (4, "東京の首都"), (5, "aa aa"), (6, "!"), (7, "yes we can")]
    windows = D.Windows.of(items)
    texts = [
        "Q: What is the capital\nof Peru?", "what is the capital of perus", "Yes, sir", "eyes and yesterday", "no", "ano nob", "昔の東京の首都は",
        "aa aa aa baa aa", "baa aab", "", "x " * 300 + "yes", "eyes yes", "so: yes; we -- can", "yes we cannot",
    ]
    rows = windows.matches(texts)
    got = {(t, windows.items[w]): (a, b) for t, w, a, b in zip(rows["text"], rows["window"], rows["start"], rows["end"])}
    want = {}
    for t, text in enumerate(texts):
        for i, item in items:
            pattern, own = form(item), form(text)
            at = [k for k in range(len(own)) if pattern and own.startswith(pattern, k)]
            cjk = lambda c: ord(c) >= D.UNSPACED
            for k in at:
                before, after = own[k - 1 : k] if k else " ", own[k + len(pattern) :][:1] or " "
                if (before == " " or cjk(before) or cjk(pattern[0])) and (after == " " or cjk(after) or cjk(pattern[-1])):
                    want.setdefault((t, i), (k, k + len(pattern)))
    assert got == want and len(want) > 8
    assert (rows["edits"] == 0).all()


def test_short_items_at_the_cuts_of_long_texts(monkeypatch):
    windows = D.Windows.of([(1, "cat"), (2, "a longer item of words")])
    monkeypatch.setattr(D, "PIECE", 200)
    for at in range(150, 260):
        text = "b" * at + " cat " + "b" * 500 + "catb bcat " + "z" * 90 + " a longer item of words"
        rows = windows.matches([text])
        assert [(at + 1, at + 4)] == [(r.start, r.end) for r in rows.itertuples() if r.window == 0]
        assert len(rows) == 2
        assert not len(windows.matches(["b" * at + "cat" + "b" * 500]))


@pytest.mark.parametrize("leading", [True, False])
def test_batches_with_and_without_matches(make, spark, leading):  # noqa: F811
    """One partition of several batches; ids of items may be strings."""
    rng = random.Random(5)
    leak = words(rng, 30)
    rows = [(k, words(rng, 8)) for k in range(1200)]
    for k in ([3, 700] if leading else [700, 1100]):
        rows[k] = (k, f"so {leak} so")
    bench = spark.createDataFrame([("item-1", leak), (None, "a short one")], "item_id string, text string")
    got = D.leaks(make(rows).coalesce(1), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, "item-1") for k in ([3, 700] if leading else [700, 1100])}


def test_hits_beyond_the_bound_are_found_in_halves(monkeypatch):
    rng = random.Random(6)
    items = [(1, words(rng, 40)), (2, "ha " * 60)]
    windows = D.Windows.of(items)
    texts = ["ha " * 900, items[0][1], "x", words(rng, 9) + items[0][1][:100] + " ha" * 400]
    want = windows.matches(texts)
    monkeypatch.setattr(D, "HITS", 50)
    again = windows.matches(texts)
    assert set(map(tuple, again[["text", "window", "edits"]].to_numpy())) == set(map(tuple, want[["text", "window", "edits"]].to_numpy()))


def test_registered_query(spark, tables):  # noqa: F811
    docs = spark.read.parquet(f"{tables}/documents.parquet").collect()
    items = [(r["item_id"], form(r["text"])) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    want = {(d["doc_id"], i) for d in docs for i, t in items if t in form(d["text"] or "")}
    got = QUERIES["op6_decontaminate"](spark, tables).collect()
    assert want and want <= {(r.doc_id, r.item_id) for r in got}
    by_id = {d["doc_id"]: form(d["text"]) for d in docs}
    for r in got:
        part = by_id[r.doc_id][max(0, r.start - 30) : r.end + 30]
        text = dict(items)[r.item_id]
        assert min(distance(text[k : k + D.WINDOW], part) for k in range(0, len(text), D.STEP)) <= D.WINDOW * D.MAX_ERROR
