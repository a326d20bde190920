from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from corpus_fixtures import make, tables  # noqa: F401
from hostvane.llm import langid as L
from hostvane.llm.queries import QUERIES

PAD = " " * (L.ORDER - 1)


def plain(text):
    out = ""
    for c in text.lower():
        c = c if c.isalpha() else " "
        if not (c == " " and out.endswith(" ")):
            out += c
    return out


def probability(texts, text):
    """Interpolated Kneser-Ney by dictionaries: mean negative log probability of ``text``."""
    grams = Counter()
    for t in texts:
        padded = PAD + plain(" " + t)[1:]
        for k in range(L.ORDER - 1, len(padded)):
            grams[padded[k - L.ORDER + 1 : k + 1]] += 1
    types = {L.ORDER: grams}
    for n in range(L.ORDER - 1, 0, -1):
        types[n] = Counter(g[1:] for g in types[n + 1])
    cut = {}
    for n, c in types.items():
        ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        cut[n] = ones / (ones + 2 * twos) if ones and twos else 0.5

    def p(gram):
        n = len(gram)
        if n == 1:
            total = sum(types[1].values())
            left = cut[1] * len(types[1]) / total
            return left / (len(types[1]) + 1) + max(types[1].get(gram, 0) - cut[1], 0) / total
        same = {g: c for g, c in types[n].items() if g[:-1] == gram[:-1]}
        total = sum(same.values())
        if not total:
            return p(gram[1:])
        return max(same.get(gram, 0) - cut[n], 0) / total + cut[n] * len(same) / total * p(gram[1:])

    padded = PAD + plain(" " + text)[1:]
    logs = [math.log(p(padded[k - L.ORDER + 1 : k + 1])) for k in range(L.ORDER - 1, len(padded))]
    return -sum(logs) / len(logs)


def counted(texts):
    chars, first = L.characters(texts)
    marks = np.zeros(len(chars), dtype=bool)
    for k in range(L.ORDER):
        marks[np.maximum(first - 1 - k, 0)] = True
    return np.unique(L.grams(chars, L.ORDER)[~marks], return_counts=True)


def test_model_against_dictionaries():
    rng = random.Random(0)
    texts = ["".join(rng.choice("aabcd  é.") for _ in range(60)) for _ in range(8)]
    model = L.kneser_ney({"x": counted(texts)})
    asked = ["abcd abca", "é", "zzz qq", "a" * 50, texts[0], "b é c"]
    h, n = model.entropies(asked)
    for k, t in enumerate(asked):
        assert h[k, 0] == pytest.approx(probability(texts, t), rel=1e-5)


def test_probabilities_sum_to_one():
    texts = ["abracadabra simsalabim", "banana bandana", "cabaret"]
    model = L.kneser_ney({"x": counted(texts)})
    letters = [*sorted(set("".join(texts))), "ж"]  # all known ones, and one that stands for the rest
    for context in ("abr", " ba", "zzz", "nan"):
        rows = [model.log_rows(np.array([ord(c) for c in context + x], dtype=np.uint64))[-1, 0] for x in letters]
        assert sum(math.exp(r) for r in rows) == pytest.approx(1, abs=1e-5)


def test_pieces_do_not_change_entropies(monkeypatch):
    texts = ["some words here", "", "other  Words!", "12", "long " * 400]
    model = L.kneser_ney({"x": counted(texts), "y": counted(["andere Wörter", "mehr davon"])})
    h, n = model.entropies(texts)
    monkeypatch.setattr(L, "SCORED_CHARS", 64)
    again, m = model.entropies(texts)
    assert np.allclose(h, again) and (n == m).all()


def test_sorted_hashes():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64))
    index = L.SortedHashes(keys)
    assert (index.order[index.find(keys)] == np.arange(len(keys))).all()
    assert (index.find(keys + np.uint64(1)) < 0).sum() >= len(keys) - 2
    assert L.SortedHashes(keys[:0]).find(keys[:3]).tolist() == [-1, -1, -1]


def test_edge_cases(make):  # noqa: F811
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["der", "die", "und", "nicht"]) for _ in range(30)), "de") for i in range(60)]
    rows += [(100 + i, " ".join(rng.choice(["the", "and", "of", "was"]) for _ in range(30)), "en") for i in range(60)]
    rows += [(300, None, "de"), (301, "", "en"), (302, "123 !?", "en"), (303, "日本語" * 300, None), (304, "the and of " * 20_000, None)]
    rows += [(None, "und nicht", "de"), (305, "die und", None), (305, "die und", None)]
    got = {r.doc_id: r for r in L.identify(make(rows)).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows if lang and i is not None and i < 300)
    assert [got[i].lang_pred for i in (300, 301, 302)] == ["und"] * 3 and got[300].score == 0
    assert got[303].rejected and not got[304].rejected and got[304].lang_pred == "en"
    assert got[305].lang_pred == "de" and got[None].lang_pred == "de" and not got[None].held_out
    assert all(0 <= r.score <= 1 for r in got.values())
    assert not any(got[i].rejected for i in range(60))


def test_nothing_to_learn_from(make):  # noqa: F811
    got = L.identify(make([(1, "words", None), (2, "", None)])).collect()
    assert {(r.doc_id, r.lang_pred, r.score, r.rejected) for r in got} == {(1, "und", 0.0, False), (2, "und", 0.0, True)}
    assert L.identify(make([])).collect() == []


def test_held_out_accuracy(spark, tables):  # noqa: F811
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    held = [r for r in QUERIES["op9_language_id"](spark, tables).collect() if r.held_out]
    assert len(held) > 20 and sum(docs[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.97


def test_limits_by_language():
    """Wrongly labelled calibration documents, and those of other languages, move no limit."""
    rng = np.random.default_rng(5)
    usual = np.abs(rng.normal(0, 0.02, 400))
    alone = L.allowed(usual)
    assert 0.5 < alone < 2 and L.allowed(np.append(usual, 7.0)) == pytest.approx(alone, abs=0.05)
    assert L.allowed(usual[:1]) > L.allowed(usual[:10]) > alone and L.allowed(usual[:0]) == L.SLACK


def test_unlearned_languages_are_rejected_despite_wrong_labels(make):  # noqa: F811
    rng = random.Random(2)
    words = {
        "de": "der die und nicht das ist ein eine mit auf für sich dem den von werden haben auch nach wie über".split(),
        "en": "the and of was that have with this from they which would their there about other into than them".split(),
    }
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(60)), lang) for i, lang in enumerate(["de", "en"] * 400)]
    wrong = [(5000 + i, " ".join(rng.choice(words["de"]) for _ in range(60)), "en") for i in range(12)]
    strange = ["Questo è un testo scritto in italiano che parla di cose normali. " * 5, "xqzv kjwh pqrtz bvxk zzqp wkjx qqv " * 12]
    asked = [(9000 + k, t, None) for k, t in enumerate(strange)]
    for extra in ([], wrong):
        docs = make([*rows, *extra, *asked])
        model = L.train(docs.where("doc_id < 9000"))
        got = {r.doc_id: r for r in L.identify(docs).collect()}
        assert [got[i].rejected for i, _, _ in asked] == [True, True]
        assert not any(got[i].rejected for i, _, _ in rows)
        # the answer is that of the model's own entropies
        h, n = model.entropies([t for _, t, _ in rows[:40]])
        best = h.argmin(axis=1)
        assert [model.languages[j] for j in best] == [lang for _, _, lang in rows[:40]]
        told = model.predict([t for _, t, _ in rows[:40]])
        share = np.exp(-model.sharpness * h)
        assert np.allclose(told["score"], share.max(axis=1) / share.sum(axis=1))
        excess = (h.min(axis=1) - model.usual[best]) * np.sqrt(np.minimum(n, L.SPREAD_CHARS) / L.SPREAD_CHARS)
        assert (told["rejected"] == (excess > model.limit[best])).all()
