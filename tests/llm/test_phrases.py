from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from corpus_fixtures import make, tables  # noqa: F401
from hostvane.llm import phrases as P


def pieces_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall("[^\x20\x09]+", piece) for piece in re.split("[.,;:!?\x0a-\x0d]", lower)]


def brute(rows, max_words=3, min_count=10, top=2000, percent=50):
    counts, sizes = {}, Counter()
    for _, text, lang in rows:
        for words in pieces_of(text):
            sizes[lang or "und"] += len(words)
            for k in range(1, max_words + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault((lang or "und"), Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        scored = []
        for p, a in candidates.items():
            inside = [q for q in candidates if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * candidates[q] >= percent * a for q in inside):
                continue
            score, _, l, r = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, text, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, text.decode(), -a, l, r, sizes[lang], -score))
    return sorted(out)


def corpus(rng, n, vocabulary):
    ends = [" ", " ", " ", " ", "  ", "\t", ", ", ". ", "\n", "!"]
    return ["".join(w + rng.choice(ends) for w in rng.choices(vocabulary, k=rng.randrange(0, 60))) for _ in range(n)]


def rows_of(rng, n):
    vocabulary = ["the", "The", "of", "a", "É", "é", "big", "cat", "sat", "日本", "x-y", "'s", *[f"rare{k}" for k in range(40)]]
    texts = corpus(rng, n, vocabulary[:12] * 6 + vocabulary)
    return [(i, t, rng.choice(["en", "de", None, "und"])) for i, t in enumerate(texts)]


def test_against_brute_force(make):  # noqa: F811
    rows = rows_of(random.Random(1), 260)
    rows += [(900, None, "en"), (901, "", "de"), (902, " . ,\t\n", "fr"), (902, "only", "es"), (None, "the cat sat " * 300, "en")]
    got = sorted(map(tuple, P.collocations(make(rows)).collect()))
    assert got == brute(rows) and len(got) > 40


@pytest.mark.parametrize("options", [{"max_words": 2}, {"max_words": 4, "min_count": 3}, {"top": 3, "min_count": 5, "contained_percent": 90}])
def test_other_parameters(make, options):  # noqa: F811
    rows = rows_of(random.Random(2), 120)
    own = {"percent" if k == "contained_percent" else k: v for k, v in options.items()}
    assert sorted(map(tuple, P.collocations(make(rows), **options).collect())) == brute(rows, **own)


def test_many_small_shards_and_buckets_give_the_same(make, monkeypatch):  # noqa: F811
    rows = rows_of(random.Random(3), 100)
    monkeypatch.setattr(P, "BLOCK_BYTES", 400)
    monkeypatch.setattr(P, "BUCKET_PHRASES", 300)
    assert sorted(map(tuple, P.collocations(make(rows)).collect())) == brute(rows)


def test_nothing_frequent(make):  # noqa: F811
    assert P.collocations(make([])).collect() == []
    assert P.collocations(make([(1, "every word once", "en"), (2, None, None)])).collect() == []


def test_index_enumerates_all_phrases_with_extensions():
    rng = np.random.default_rng(0)
    for depth in (1, 2, 3, 5):
        symbols = np.concatenate([[P.BORDER], rng.integers(0, 9, 500), [P.BORDER]])
        symbols[40:90] = symbols[100:150]
        want = {}
        own = symbols.tolist()
        for k in range(1, depth + 1):
            for i in range(len(own) - k + 1):
                phrase = tuple(own[i : i + k])
                if min(phrase) > P.RARE:
                    n, after, before = want.get(phrase, (0, 0, 0))
                    want[phrase] = (n + 1, after + (i > 0 and own[i - 1] != P.BORDER), before + (own[i + k] != P.BORDER))
        got = {}
        for phrase, n, after, before in P.enumerate_phrases(symbols, depth):
            for row in zip(map(tuple, phrase.tolist()), n.tolist(), after.tolist(), before.tolist()):
                assert row[0] not in got
                got[row[0]] = row[1:]
        assert got == want


def test_sort_keys_of_wide_alphabets():
    """More symbols than fit one number are ranked on the way."""
    rng = np.random.default_rng(1)
    symbols = rng.integers(2, 1 << 30, 300)
    symbols[::7], symbols[50:60], symbols[150:160] = P.BORDER, 5, 5
    order = np.argsort(P._sort_keys(symbols, 4), kind="stable")

    def suffix(i):
        out = []
        for x in symbols[i : i + 4]:
            out.append(int(x))
            if x <= P.RARE:
                break
        return out + [0] * (4 - len(out))

    assert [suffix(i) for i in order] == sorted(suffix(i) for i in range(300))


def test_packed_columns_come_back():
    import zstandard

    rng = np.random.default_rng(2)
    for n in (0, 1, 1000):
        columns = [rng.integers(0, 1 << 32, n, dtype=np.uint64) for _ in range(5)]
        blob = P.packed(columns, zstandard.ZstdCompressor().compress)
        back = P.unpacked(blob, 5, zstandard.ZstdDecompressor().decompress)
        assert back.shape == (5, n) and all((a == b).all() for a, b in zip(columns, back))


def test_scores_are_exact_beyond_64_bits(spark):
    a, l, r = 987_654_321_012, 987_654_321_013, 1_987_654_321_017
    df = spark.createDataFrame([(a, l, r), (10, 10, 10), (3, 7, 9)], "a long, l long, r long").select(P.floor_score("a", "l", "r").alias("s"))
    assert [x["s"] for x in df.collect()] == [1_000_000 * a * a // (l * r), 1_000_000, 1_000_000 * 9 // 63]
