"""Token ids of whole texts with a public tokenizer file, remembering the ids of words already met.

A byte-level pre-tokenizer never joins text across the space in front of a word, so the ids of a text are the ids
of its words put together. The different words of a batch are looked up; the tokenizer's merges run on new pieces of new
words. Texts with the name of a special token, and other kinds of tokenizers, are always given to the tokenizer whole.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECES_KEPT = 600_000  # per worker
WORDS_AT_ONCE = 20_000  # different words of which Python objects are made together
# White space, and the letters and digits of the Latin blocks.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
DIGIT = "0-9²³¹¼½¾"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Known(dict):
    """What was made of keys met lately. When full, it drops the oldest half."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= PIECES_KEPT:
            for old in list(islice(self, PIECES_KEPT // 2)):
                del self[old]
        found = self[key] = self.make(key)
        return found


class WordEncoder:
    """``encode(texts)`` gives the ids of each text as little-endian bytes of ``dtype``."""

    def __init__(self, path: str, dtype: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(path), dtype
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        pre = told.get("pre_tokenizer") or {}
        self.by_word = (
            pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and not told.get("normalizer")
            and told["model"]["type"] == "BPE"
            and not told["model"].get("dropout")
            and not told["model"].get("ignore_merges")
            and byte_letters()[32] in told["model"]["vocab"]
        )
        specials = [t["content"] for t in told.get("added_tokens", ())]
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        if self.by_word:  # the same merges, without a second cache below ours
            from tokenizers.models import BPE

            vocab = told["model"]["vocab"]
            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in told["model"]["merges"]]
            self.model, self.letters = BPE(vocab, merges, cache_capacity=0), byte_letters()
            self.code = {"<u2": "H", "<u4": "I"}[dtype]
            self.opens = np.zeros(max(vocab.values()) + 1, bool)  # ids of tokens that begin with a space
            self.opens[[n for token, n in vocab.items() if token.startswith(self.letters[32])]] = True
        self.chunks = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        self.pieces = re.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{DIGIT}]+| ?[^{SPACE}{LETTER}{DIGIT}]+"
            f"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
        )
        self.beyond = re.compile("[^\x00-ɏ]")
        self.spaces = re.compile(f"[{SPACE}]")
        self.after_space: dict[str, bytes | None] = {}  # None: white space at its ends ties the word to its neighbours
        self.odd_spaces = re.compile(f"(?! )[{SPACE}]")
        self.known = Known(self._new_piece)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _new_piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():  # such letters stand for themselves, but for spaces
            spelled = piece.replace(" ", self.letters[32])
        else:
            spelled = piece.encode().decode("latin-1").translate(self.letters)
        ids = array(self.code, [t.id for t in self.model.tokenize(spelled)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if not chunk.isascii() and self.beyond.search(chunk):
            return self._whole(chunk)
        return b"".join(map(self.known.__getitem__, self.pieces.findall(chunk)))

    def _after_space(self, spelled: pa.LargeStringArray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
        """(ids, the row of each word with the space before it). Row -1: white space at its ends ties it to its neighbours."""
        parts, rows, n = [], [], 0
        for at in range(0, len(spelled), WORDS_AT_ONCE):
            ids, row = self._some_after_space(spelled.slice(at, WORDS_AT_ONCE))
            parts.append(ids)
            rows.append(np.where(row < 0, -1, row + n).astype(np.int32))
            n += len(ids)
        return pa.concat_arrays(parts), np.concatenate(rows)

    def _some_after_space(self, spelled: pa.LargeStringArray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
        words = spelled.to_numpy(zero_copy_only=False).tolist()  # several times faster than to_pylist
        joined, row = " " + " ".join(words), np.zeros(len(words), np.int32)
        if not all(words) or self.odd_spaces.search(joined):
            inner = pc.binary_length(pc.utf8_trim(spelled, SPACE)).to_numpy()
            row[(inner == 0) | (inner < pc.binary_length(spelled).to_numpy())] = -1
        if self.beyond.search(joined):
            row[[k for k, w in enumerate(words) if row[k] == 0 and self.beyond.search(w)]] = 1
        plain, strange = np.flatnonzero(row == 0), np.flatnonzero(row == 1)
        if len(plain) < len(words):
            joined = " " + " ".join([words[k] for k in plain])
        pieces = self.pieces.findall(joined) if len(plain) else []
        raw = b"".join(map(self.known.__getitem__, pieces))
        ids = np.frombuffer(raw, self.dtype)
        begin = np.flatnonzero(self.opens[ids])  # spaces stand only in front of words here
        row[plain], row[strange] = np.arange(len(plain)), len(plain) + np.arange(len(strange))
        bounds = pa.py_buffer(np.append(begin, len(ids)).astype(np.int64) * ids.itemsize)
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, bounds, pa.py_buffer(raw)])
        if len(begin) != len(plain):
            raise RuntimeError("the tokenizer's words do not begin with a space")
        rest = pa.array([self._whole(" " + words[k]) for k in strange], pa.large_binary())
        return pa.concat_arrays([whole, rest]), row

    def encode(self, texts: list[str]) -> list[bytes]:
        able = [self.by_word and not (self.special and self.special.search(t)) for t in texts]
        out = [b"" if a else self._whole(t) for t, a in zip(texts, able)]
        some = [k for k, a in enumerate(able) if a]
        if some:
            for k, ids in zip(some, self._by_words([texts[k] for k in some])):
                out[k] = ids
        return out

    def _by_words(self, texts: list[str]) -> list[bytes]:
        """Every different word of all texts is looked up once; texts are put together from the numbers of their words."""
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        bounds = split.offsets.to_numpy()
        words = split.values.dictionary_encode()
        del split  # parts are large
        ids, row = self._after_space(words.dictionary)
        number = words.indices.to_numpy()
        # The first word of a text has no space before it: a row of its own, behind the others.
        begin = bounds[:-1]
        heads = words.dictionary.take(pa.array(number[begin])).to_pylist()
        rows = row[number]
        del words, number
        rows[begin] = [-1 if (self.spaces.match(h[-1]) if h else n > 1) else 0 for h, n in zip(heads, np.diff(bounds))]
        loose = np.minimum.reduceat(rows, begin) < 0
        rows[begin] = len(ids) + np.arange(len(texts))
        first = pa.array([b"" if x else self._chunk(h) for h, x in zip(heads, loose)], pa.large_binary())
        joined = pa.concat_arrays([ids, first]).take(pa.array(np.maximum(rows, 0)))
        cuts = np.frombuffer(joined.buffers()[1], np.int64)[bounds]
        raw = memoryview(joined.buffers()[2] or b"")
        return [
            b"".join(map(self._chunk, self.chunks.findall(t))) if x else bytes(raw[a:b])
            for t, x, a, b in zip(texts, loose, cuts, cuts[1:])
        ]
