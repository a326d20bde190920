"""Personal data: exact patterns, and a semi-Markov conditional random field for what they miss.

Patterns find e-mail addresses, IP addresses, card and phone numbers. Around every digit, ``@`` or bracketed "at", a
model looks at all segments of up to ``MAX_TOKENS`` tokens as whole spans: how many digits and dots they have, what
surrounds them, whether they pass the card checksum. A dynamic program over segments chooses boundaries and types jointly; a
segment it chooses with a probability of ``MIN_PROBABILITY`` or more is added if it touches no exact span. The
model is trained on the corpus itself: the labels are the exact spans of a bounded sample, as they stand and rewritten
in ways that the patterns do not know (``name [at] host``, a phone number without its plus sign).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostvane.llm.workers import shared, slices
from hostvane.operators.toprows import top_rows
from hostvane.session import materialize

KINDS = ["email", "ip", "card", "phone"]
MAX_TOKENS = 20
MIN_PROBABILITY = 0.9
TRAIN_DOCS = 20_000  # documented bounds of the training sample: documents, spots of one document, spots of one pattern
SPOTS_A_DOC = 20
SPOTS_A_KIND = 60
SPOTS_WITHOUT = 300
ROUNDS = 100
PENALTY = 0.02
SPOT_CHARS = 400  # how far a word is followed at once
SPOT_TOKENS = 8 * MAX_TOKENS  # longer stretches are looked at in overlapping windows
SPOTS_AT_ONCE = 500

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9.]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]|[\[({<] ?at ?[\])}>]")
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|[^A-Za-z0-9\s]")
# Words that announce a kind of span.
CUES = {
    "email": 0, "mail": 0, "contact": 0, "ip": 1, "host": 1, "server": 1, "card": 2, "visa": 2, "mastercard": 2,
    "amex": 2, "tel": 3, "phone": 3, "call": 3, "fax": 3, "mobile": 3,
}

# How people write "@" to hide an address, and the start of a phone number.
AT_SIGNS = [" [at] ", " (at) ", " @ ", "[at]", "(at)"]
PREFIXES = ["00", ""]

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Looks back from each ``@``: searching forward takes quadratic time in long runs."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text[start - 1]):
            start -= 1
        match = DOMAIN.match(text, at) if start < at else None
        if match:
            yield start, match.end()
            done = match.end()
        at = text.find("@", max(at + 1, done))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    for run in DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        parts, places, at = run.group().split("."), [], run.start()
        for p in parts:
            places.append(at)
            at += len(p) + 1
        k = 0
        while k + 3 < len(parts):
            four = parts[k : k + 4]
            empty = [j for j, p in enumerate(four) if not p]
            if empty:
                k += empty[-1] + 1
                continue
            if all(len(own := p.lstrip("0")) <= 3 and int(own or "0") <= 255 for p in four):
                yield places[k], places[k + 3] + len(parts[k + 3])
            k += 4


def exact_spans(text: str) -> list[Span]:
    """(start, kind, end) of the patterns, leftmost and without overlap per kind, in order of start and kind."""
    found: list[Span] = []
    if "@" in text:
        found += [(a, 0, b) for a, b in _emails(text)]
    if any(d in text for d in "0123456789"):
        found += [(a, 1, b) for a, b in _addresses(text)]
        for m in CARD.finditer(text):
            if m.end() - m.start() < 14:
                continue
            d = _digits(m.group())
            if 14 <= len(d) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(found)


def _word_start(text: str, at: int, least: int) -> int:
    while at > least and not text[at - 1].isspace():
        at -= 1
    return at


def _word_end(text: str, at: int, most: int) -> int:
    while at < most and not text[at].isspace():
        at += 1
    return at


def stretches(text: str) -> list[tuple[int, int]]:
    """Stretches of words with a trigger, and one word before and after."""
    out: list[list[int]] = []
    hit = TRIGGER.search(text)
    while hit:
        least, most = max(0, hit.start() - SPOT_CHARS), min(len(text), hit.end() + SPOT_CHARS)
        a, end = _word_start(text, hit.start(), least), _word_end(text, hit.end(), most)
        while a > least and text[a - 1].isspace():
            a -= 1
        a = _word_start(text, a, least)
        b = end
        while b < most and text[b].isspace():
            b += 1
        b = _word_end(text, b, most)
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
        hit = TRIGGER.search(text, max(end, hit.end()))
    return [(a, b) for a, b in out if a < b]


def spots(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, from, to): windows over all stretches, and where segments of theirs may begin.

    Windows of one stretch overlap so far that every segment lies whole in the window in whose part it begins, with
    MAX_TOKENS tokens before it.
    """
    out = []
    for a, b in stretches(text):
        if b - a <= SPOT_TOKENS:
            out.append((a, b, a, b))
            continue
        begin = [m.start() for m in TOKEN.finditer(text, a, b)]
        step = SPOT_TOKENS - 2 * MAX_TOKENS
        for k in range(0, max(1, len(begin) - 2 * MAX_TOKENS), step):
            last = k + SPOT_TOKENS >= len(begin)
            end, to = (b, b) if last else (begin[k + SPOT_TOKENS], begin[k + SPOT_TOKENS - MAX_TOKENS])
            out.append((begin[k], end, begin[k + MAX_TOKENS] if k else a, to))
            if last:
                break
    return out


@dataclass
class Segments:
    """Candidate segments of many spots: token bounds, spot, and a row of features each."""

    first: np.ndarray
    last: np.ndarray  # exclusive
    spot: np.ndarray
    x: np.ndarray
    starts: np.ndarray  # character bounds of all tokens within their spot
    ends: np.ndarray
    offset: np.ndarray  # first token of each spot


def _bucket(n: np.ndarray, bounds: list[int]) -> list[np.ndarray]:
    """Which of the ranges from each bound to the next ``n`` is in."""
    place = np.searchsorted(bounds, n, side="right")
    return [place == k for k in range(1, len(bounds) + 1)]


def segments(texts: list[str]) -> Segments:
    """All candidate segments of spot texts: up to MAX_TOKENS tokens with a digit or ``@``, or a bracketed "at".

    They begin and end with a mark or a whole run of letters and digits."""
    tokens, starts, ends, offset, spot = [], [], [], [0], []
    for k, text in enumerate(texts):
        for m in TOKEN.finditer(text):
            tokens.append(m.group())
            starts.append(m.start())
            ends.append(m.end())
            spot.append(k)
        offset.append(len(tokens))
    n = len(tokens)
    owner, bound = np.array(spot, dtype=np.int64), np.array(offset, dtype=np.int64)
    length = np.array(ends, dtype=np.int64) - np.array(starts, dtype=np.int64)
    letters = np.array([t[0].isalpha() and t[0].isascii() for t in tokens], dtype=bool)
    digits = np.array([t[0].isdigit() and t[0].isascii() for t in tokens], dtype=bool)
    blank = np.array([t[0].isspace() for t in tokens], dtype=bool)
    is_ = {c: np.array([t == c for t in tokens], dtype=bool) for c in "@.+-"}
    bracket = np.array([t in "()[]{}<>" for t in tokens], dtype=bool)
    usual = letters | digits | blank | bracket | is_["@"] | is_["."] | is_["+"] | is_["-"]
    other = ~usual & ~np.array([t in "_%" for t in tokens], dtype=bool)
    opening = np.array([t in "([{<" for t in tokens], dtype=bool)
    near = np.concatenate([[False], bracket | is_["@"], [False]])
    loose = blank & ~near[:-2] & ~near[2:]  # white space that stands between words
    at_word = np.array([t == "at" for t in tokens], dtype=bool)
    at_word[1:] &= bracket[:-1] | blank[:-1]
    if n:
        at_word[0] = False

    def upto(values: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(values)])

    first = np.repeat(np.arange(n), MAX_TOKENS)
    last = first + np.tile(np.arange(1, MAX_TOKENS + 1), n)
    inside = last <= bound[owner[first] + 1] if n else np.zeros(0, dtype=bool)
    first, last = first[inside], last[inside]
    trigger = upto(digits | is_["@"] | (at_word & np.append(bracket[1:] | blank[1:], False)))
    whole = letters | digits
    inner = np.append(whole[1:] & whole[:-1], False) & np.append(owner[1:] == owner[:-1], False)  # within a run
    cuts = inner[last - 1] | (inner[np.maximum(first - 1, 0)] & (first > 0))
    able = ~blank[first] & ~blank[last - 1] & ~cuts & (trigger[last] > trigger[first])
    first, last = first[able], last[able]

    def count(values: np.ndarray) -> np.ndarray:
        sums = upto(values)
        return sums[last] - sums[first]

    n_digits, n_dots, n_at = count(length * digits), count(is_["."]), count(is_["@"])
    n_letters, n_blank, n_hyphen, n_bracket = count(letters), count(blank), count(is_["-"]), count(bracket)
    n_other, n_plus, n_tokens = count(other), count(is_["+"]), last - first
    at_end, at_start = last == bound[owner[first] + 1], first == bound[owner[first]]
    left, right = np.maximum(first - 1, 0), np.minimum(last, n - 1)
    after = np.minimum(last + 1, n - 1)
    joins = is_["."] | is_["@"] | is_["+"] | is_["-"]
    seen = np.where(is_["@"], np.arange(n), -1)
    latest = np.maximum.accumulate(seen) if n else seen
    dots = upto(is_["."])
    n_domain_dots = np.where(n_at > 0, dots[last] - dots[np.maximum(latest[last - 1], 0)], 0)
    cue = np.array([CUES.get(t.lower(), -1) if t[0].isalpha() else -2 for t in tokens], dtype=np.int64)
    words = np.where(cue != -2, np.arange(n), -1)
    word_before = np.maximum.accumulate(words) if n else words
    before = np.where(first > 0, word_before[left], -1)
    announced = np.where((before >= bound[owner[first]]) & (first - before <= 4), cue[np.maximum(before, 0)], -1)
    address, checked = np.zeros(len(first), dtype=bool), np.zeros(len(first), dtype=bool)
    for k in np.flatnonzero((n_tokens == 7) & (n_dots == 3) & (n_letters + n_blank + n_at == 0)):
        own = tokens[first[k] : last[k]]
        address[k] = all(t.isdigit() and len(t) < 4 and int(t) < 256 for t in own[::2]) and own[1] == own[3] == own[5] == "."
    only_card = (n_digits + n_blank + n_hyphen > 0) & (n_letters + n_dots + n_at + n_bracket + n_other + n_plus == 0)
    for k in np.flatnonzero(only_card & (n_digits >= 14) & (n_digits <= 19)):
        checked[k] = luhn(_digits("".join(tokens[first[k] : last[k]])))
    bare = n_letters + n_at + n_other == 0
    columns = [
        np.ones(len(first), dtype=bool),
        *_bucket(n_digits, [0, 1, 4, 8, 10, 12, 14, 17, 20]),
        *_bucket(n_dots, [0, 1, 2, 3, 4]),
        *_bucket(n_tokens, [1, 2, 5, 8, 12]),
        n_at == 1, n_at > 1, n_domain_dots > 0, (n_at > 0) & (n_blank > 0),
        is_["+"][first], n_plus > is_["+"][first],
        letters[first], letters[last - 1], digits[first], digits[last - 1], is_["."][last - 1], joins[first] & ~is_["+"][first],
        count(loose) > 0, count(opening) * 2 != n_bracket, (bracket & ~opening)[first], n_blank > 0, n_hyphen > 0, n_bracket > 0, n_other > 0, count(at_word) > 0,
        address, checked, only_card, bare, bare & is_["+"][first] & (n_digits >= 10), bare & (n_dots == 3) & (n_digits > 0),
        ~at_start & joins[left],
        ~at_end & joins[right] & ~blank[after] & (last + 1 < bound[owner[first] + 1]),
        ~at_end & blank[right] & (letters | digits)[after] & (n_digits > 0) & digits[after],
        *[announced == k for k in range(len(KINDS))],
    ]
    x = np.column_stack(columns).astype(np.float64) if n else np.zeros((0, len(columns)))
    return Segments(first, last, owner[first], x, np.array(starts), np.array(ends), bound)


def _rows_of(seg: Segments) -> list[np.ndarray]:
    cuts = np.searchsorted(seg.spot, np.arange(len(seg.offset)))
    return [np.arange(cuts[k], cuts[k + 1]) for k in range(len(seg.offset) - 1)]


def marginals(seg: Segments, scores: np.ndarray) -> np.ndarray:
    """Probability of each segment and type among all segmentations of its spot. A token outside segments scores 0."""
    size = np.diff(seg.offset)
    longest = int(size.max()) if len(size) else 0
    first, last = seg.first - seg.offset[seg.spot], seg.last - seg.offset[seg.spot]
    order = np.argsort(last, kind="stable")
    cuts = np.searchsorted(last[order], np.arange(longest + 2))
    any_type = np.logaddexp.reduce(scores, axis=1) if len(scores) else np.zeros(0)
    alpha = np.full((len(size), longest + 1), -np.inf)
    beta = alpha.copy()
    alpha[:, 0] = 0.0
    for k in range(1, longest + 1):
        rows = order[cuts[k] : cuts[k + 1]]
        alpha[:, k] = alpha[:, k - 1]
        np.logaddexp.at(alpha, (seg.spot[rows], k), alpha[seg.spot[rows], first[rows]] + any_type[rows])
    beta[np.arange(len(size)), size] = 0.0
    for k in range(longest, 0, -1):
        rows = order[cuts[k] : cuts[k + 1]]
        beta[:, k - 1] = np.logaddexp(beta[:, k - 1], beta[:, k])
        np.logaddexp.at(beta, (seg.spot[rows], first[rows]), beta[seg.spot[rows], k] + any_type[rows])
    around = alpha[seg.spot, first] + beta[seg.spot, last] - beta[seg.spot, 0]
    return np.exp(np.minimum(around[:, None] + scores, 0.0))


def best(seg: Segments, spot: int, rows: np.ndarray, scores: np.ndarray) -> list[int]:
    """Segments of the best segmentation."""
    n = int(seg.offset[spot + 1] - seg.offset[spot])
    top = scores[rows].max(axis=1) if len(rows) else np.zeros(0)
    able = top > 0  # a segment below outside tokens is in no best segmentation
    rows, top = rows[able], top[able]
    if not len(rows):
        return []
    first, last = seg.first[rows] - seg.offset[spot], seg.last[rows] - seg.offset[spot]
    order = np.argsort(last, kind="stable")
    value, came = np.zeros(n + 1), np.full(n + 1, -1)
    at = 0
    for k in range(1, n + 1):
        value[k] = value[k - 1]
        while at < len(order) and last[order[at]] == k:
            r = order[at]
            if value[first[r]] + top[r] > value[k]:
                value[k], came[k] = value[first[r]] + top[r], r
            at += 1
    chosen, k = [], n
    while k > 0:
        if came[k] >= 0:
            chosen.append(int(rows[came[k]]))
            k = int(first[came[k]])
        else:
            k -= 1
    return chosen[::-1]


def train_field(texts: list[str], spans: list[list[Span]]) -> np.ndarray:
    """Weights (features x kinds) that make the given spans of the spot texts likely."""
    seg = segments(texts)
    weights = np.zeros((seg.x.shape[1], len(KINDS)))
    rows = _rows_of(seg)
    place = {(int(s), int(seg.starts[a]), int(seg.ends[b - 1])): k for k, (s, a, b) in enumerate(zip(seg.spot, seg.first, seg.last))}
    target, busy = np.zeros((len(seg.x), len(KINDS))), []
    for s, own in enumerate(spans):
        known = [(place.get((s, a, b)), kind) for a, kind, b in own]
        if len(rows[s]) and all(k is not None for k, _ in known):
            busy.append(s)
            for k, kind in known:
                target[k, kind] = 1.0
    used = np.isin(seg.spot, busy)
    speed = np.full_like(weights, 1e-6)
    for _ in range(ROUNDS if busy else 0):
        wanted = (target - marginals(seg, seg.x @ weights))[used]
        gradient = seg.x[used].T @ wanted - PENALTY * weights
        speed += gradient**2
        weights += gradient / np.sqrt(speed)
    return weights


def train_spots(texts: list[str], spans: list[list[Span]]) -> np.ndarray:
    """Train on spots as they stand and rewritten."""
    more = [rewritten(t, s, turn) for turn, (t, s) in enumerate(zip(texts, spans))]
    pairs = list(zip(texts, spans)) + [m for m in more if m]
    return train_field([t for t, _ in pairs], [s for _, s in pairs])


class Finder:
    def __init__(self, weights: np.ndarray | None, min_probability: float = MIN_PROBABILITY):
        self.weights, self.min_probability = weights, min_probability

    def find(self, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
        """(exact spans, added spans) of each whole text."""
        exact = [exact_spans(t) for t in texts]
        added: list[list[Span]] = [[] for _ in texts]
        if self.weights is not None:
            every = [(k, *spot) for k, t in enumerate(texts) for spot in spots(t)]
            for at in range(0, len(every), SPOTS_AT_ONCE):
                self._add(texts, every[at : at + SPOTS_AT_ONCE], exact, added)
        return list(zip(exact, added))

    def _add(self, texts, part, exact, added) -> None:
        seg = segments([texts[k][a:b] for k, a, b, _, _ in part])
        scores, probable = seg.x @ self.weights, None
        for s, rows in enumerate(_rows_of(seg)):
            k, a, _, least, most = part[s]
            for r in best(seg, s, rows, scores):
                start, end = a + int(seg.starts[seg.first[r]]), a + int(seg.ends[seg.last[r] - 1])
                if not least <= start < most or (added[k] and start < added[k][-1][2]):
                    continue  # another window decides, or has decided
                if any(start < e and b < end for b, _, e in exact[k]):
                    continue
                if probable is None:
                    probable = marginals(seg, scores)
                kind = int(np.argmax(scores[r]))
                if probable[r, kind] >= self.min_probability:
                    added[k].append((start, kind, end))


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in sorted(spans))


def _training_spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole)):
        out: dict[str, list] = {"kinds": [], "text": [], "spans": []}
        for text in batch.column(0).to_pylist():
            exact = exact_spans(text or "")
            near = sorted(spots(text or ""), key=lambda ab: hashlib.md5(text[ab[0] : ab[1]].encode("utf-8", "replace")).digest())
            for a, b, _, _ in near[:SPOTS_A_DOC]:
                mine, end = [], a
                for s, kind, e in exact:
                    if end <= s and e <= b:  # without overlap
                        mine.append((s - a, kind, e - a))
                        end = e
                out["kinds"].append(",".join(sorted({KINDS[k] for _, k, _ in mine})))
                out["text"].append(text[a:b])
                out["spans"].append([x for s in mine for x in s])
        kinds = [pa.string(), pa.string(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))


def rewritten(text: str, spans: list[Span], turn: int) -> tuple[str, list[Span]] | None:
    """A spot with one e-mail address or phone number, written differently; None for others."""
    if len(spans) != 1 or spans[0][1] not in (0, 3):
        return None
    a, kind, b = spans[0]
    if kind == 0:
        new = text[a:b].replace("@", AT_SIGNS[turn % len(AT_SIGNS)])
    elif "(" in text[a:b]:
        prefix = PREFIXES[turn % len(PREFIXES)]
        new = prefix + text[a + 1 : b] if prefix else text[a + text[a:b].index("(") : b]
    else:
        return None
    return text[:a] + new + text[b:], [(a, kind, a + len(new))]


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> np.ndarray | None:
    """Weights learned from exact spans in about ``train_docs`` documents, taken by the hash of their text; None without any."""
    slim = docs.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    n = slim.count()
    if n > train_docs:
        slim = slim.where(F.pmod(F.xxhash64("text", F.lit("pii")), F.lit(1_000_000)) / F.lit(1e6) < train_docs / n)
    near = slim.mapInArrow(_training_spots, "kinds string, text string, spans array<long>")
    near = materialize(near.dropDuplicates(["text"]).withColumn("order", F.md5("text")), "pii-spots")
    order = [F.col("order"), F.col("text")]
    some = top_rows(near.where("kinds != ''"), ["kinds"], order, SPOTS_A_KIND).unionByName(
        top_rows(near.where("kinds = ''"), ["kinds"], order, SPOTS_WITHOUT)
    )
    taken = some.toPandas()  # at most SPOTS_A_KIND of every set of kinds, and SPOTS_WITHOUT
    taken = taken.iloc[np.lexsort((taken["order"], taken["kinds"] == ""))]
    spans = [[tuple(map(int, s[k : k + 3])) for k in range(0, len(s), 3)] for s in taken["spans"]]
    return train_spots(list(taken["text"]), spans) if any(spans) else None


def find_spans(docs: DataFrame, train_docs: int = TRAIN_DOCS, min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """doc_id, exact, added of every row of ``docs`` (doc_id, text): arrays of struct(start, kind, end).

    Places are code points of the whole text, ends exclusive, in order of start and kind. Null texts are empty.
    """
    given = shared(docs.sparkSession, Finder(train(docs, train_docs), min_probability))
    one = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            pairs = given().find([t or "" for t in batch.column(1).to_pylist()])
            lists = [
                pa.array([[{"start": a, "kind": KINDS[k], "end": b} for a, k, b in sorted(p[i])] for p in pairs], one)
                for i in (0, 1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["doc_id", "exact", "added"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    span = "array<struct<start: long, kind: string, end: long>>"
    return slim.mapInArrow(find, f"doc_id long, exact {span}, added {span}")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of exact spans by kind, their digest, and all spans as text."""

    def told(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    order = F.array(*[F.lit(k) for k in KINDS])
    every = F.transform(
        F.array_sort(
            F.transform(
                F.concat("exact", "added"),
                lambda s: F.struct(s["start"], F.array_position(order, s["kind"]).alias("nth"), s["kind"], s["end"]),
            )
        ),
        lambda s: F.struct(s["start"], s["kind"], s["end"]),
    )
    return found.select(
        "doc_id",
        *[_count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(told(F.col("exact")), 256).alias("base_sha256"),
        told(every).alias("spans"),
    )


def _count(kind: str):
    return F.size(F.filter("exact", lambda s: s["kind"] == kind)).cast("long")
