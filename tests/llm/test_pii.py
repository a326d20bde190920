from __future__ import annotations

import hashlib
import random
import re

import numpy as np

from corpus_fixtures import make, tables  # noqa: F401
from hostvane.llm import pii as P
from hostvane.llm.queries import QUERIES

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            good = [
                lambda: True,
                lambda: all(int(x) <= 255 for x in m.group().split(".")),
                lambda: 14 <= len(d) <= 19 and P.luhn(d),
                lambda: 10 <= len(d) <= 15,
            ][kind]()
            if good:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_patterns_against_re():
    rng = random.Random(2)
    parts = ["1", "23", "4", "5", "@", "a", "b.c", ".", "+", " ", "-", "(", ")", "é", "255", "256", "0", "4111111111111111", "\n"]
    for _ in range(8000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 22)))
        assert P.exact_spans(text) == brute(text), text


def test_long_runs_are_fast():
    for text in ("a" * 300_000 + "@", "1" * 300_000 + "....", "1." * 100_000, "+" * 100_000 + "1", "@" * 100_000, "1 " * 100_000):
        P.exact_spans(text)
        P.Finder(None).find([text])


def test_long_runs_of_zeros():
    zeros = "0" * 10_000
    for text in (f"{zeros}.1.2.3", f"1.{zeros}.2.3", f"1.2.3.{zeros}7", f"1.2.3.{zeros}256 x", f"{zeros}999.1.2.3"):
        spans = [s for s in P.exact_spans(text) if s[1] == 1]
        value = re.search("[1-9][0-9]*", text.split(".")[0] if text.startswith("0") else text.split(".")[-1].split()[0])
        assert spans == ([] if value and int(value.group()) > 255 else [(0, 1, len(text.split()[0]))])


def test_windows_of_a_stretch_hold_every_segment_whole():
    rng = random.Random(8)
    for _ in range(30):
        text = " ".join(rng.choice(["12", "a@b.c", "(30)", "0049", "1.2.3.4", "x"]) for _ in range(rng.randrange(1, 400)))
        parts = P.spots(text)
        begin = [m.start() for m in P.TOKEN.finditer(text)]
        for a, b in P.stretches(text):
            mine = [p for p in parts if a <= p[0] and p[1] <= b]
            assert mine[0][2] == a and mine[-1][3] == b and all(x[3] == y[2] for x, y in zip(mine, mine[1:]))
            for start, end, least, most in mine:
                assert start <= least < most <= end
                last = [k for k in begin if least <= k < most][-1]
                after = [*[k for k in begin if k > last], len(text)]
                assert after[min(P.MAX_TOKENS, len(after)) - 1] <= end or end == b  # the longest segment from there


def test_no_number_is_split_in_a_long_row_of_them(make):  # noqa: F811
    """The field finds numbers it was shown rewritten; in a row of 200, no window cuts one."""
    rng = random.Random(3)
    number = lambda: f"({rng.randrange(10, 99)}) {rng.randrange(1000, 9999)} {rng.randrange(1000, 9999)}"
    known = [f"call +49 {number()} today or write" for _ in range(80)] + [f"in {rng.randrange(1000)} of {rng.randrange(99)} cases" for _ in range(300)]
    row, places, at = [], [], 0
    for _ in range(200):
        one = f"0049 {number()}"
        row.append(one)
        places.append((at, at + len(one)))
        at += len(one) + len(" and ")
    weights = P.train(make(list(enumerate(known))))
    (_, added), = P.Finder(weights).find([" and ".join(row)])
    got = {(a, b) for a, _, b in added}
    assert got <= set(places) and len(got) >= 0.9 * len(places)


def test_marginals_and_best_against_enumeration():
    seg = P.segments(["a 1.2 @b", "x 12", "no"])
    scores = np.random.default_rng(0).normal(size=(len(seg.x), len(P.KINDS)))
    probable = P.marginals(seg, scores)
    for spot, rows in enumerate(P._rows_of(seg)):
        n = int(seg.offset[spot + 1] - seg.offset[spot])

        def ways(k, rows=rows, spot=spot, n=n):
            if k == n:
                yield (), 0.0
                return
            yield from ways(k + 1)
            for r in rows:
                if seg.first[r] - seg.offset[spot] == k:
                    for kind in range(len(P.KINDS)):
                        for rest, z in ways(int(seg.last[r] - seg.offset[spot])):
                            yield ((int(r), kind), *rest), z + scores[r, kind]

        every = list(ways(0))
        total = np.logaddexp.reduce([z for _, z in every])
        want = np.zeros_like(probable)
        for chosen, z in every:
            for r, kind in chosen:
                want[r, kind] += np.exp(z - total)
        assert np.allclose(want[rows], probable[rows])
        top = max(every, key=lambda e: e[1])[0]
        assert P.best(seg, spot, rows, scores) == [r for r, _ in top]


def corpus():
    rng = random.Random(6)

    def word():
        return "".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 8)))

    def span(k):
        d = rng.randrange
        card = "4" + "".join(str(d(10)) for _ in range(14))
        card += next(c for c in "0123456789" if P.luhn(card + c))
        return [
            f"{word()}.{d(99)}@{word()}.example.com", f"{d(256)}.{d(256)}.{d(256)}.{d(256)}", card,
            f"+1 ({d(100, 999)}) 555-{d(1000, 9999)}", str(d(10**9)), f"{d(9)}.{d(99)}",
        ][k]

    return [(i, " ".join([word(), word(), span(i % 6), word(), word() + "."])) for i in range(240)]


def test_the_field_knows_rewritten_spans(make, spark):  # noqa: F811
    rows = corpus()
    more = [
        (1000, "write to ab.12 [at] cde.example.com soon"), (1001, "tel (555) 555-1234 now"), (1002, None), (1003, ""),
        (1004, "no data here 12 at 3"), (None, "mail x@y.z"), (1005, "w " * 100_000 + "a@b.cd"), (1005, "é a@b.cd"),
    ]
    got = P.find_spans(make(rows + more)).collect()
    assert len(got) == len(rows + more)
    by_id = {r.doc_id: r for r in got if r.doc_id != 1005}
    told = {i: t for i, t in rows + more}
    for r in got:
        if r.doc_id not in (None, 1005):
            assert [(s.start, P.KINDS.index(s.kind), s.end) for s in r.exact] == brute(told[r.doc_id] or "")
    assert [told[1000][s.start : s.end] for s in by_id[1000].added] == ["ab.12 [at] cde.example.com"]
    assert not by_id[1004].added and not by_id[1004].exact
    assert [(s.start, s.end) for s in by_id[None].exact] == [(5, 10)]
    assert P.find_spans(make([])).collect() == []


def test_registered_query(spark, tables):  # noqa: F811
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    rows = QUERIES["op10_personal_data"](spark, tables).collect()
    assert len(rows) == len(docs)
    for r in rows:
        spans = brute(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in spans) for j in range(4)]
        text = ",".join(f"{P.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
