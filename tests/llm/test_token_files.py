from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpus_fixtures import make, tables  # noqa: F401
from hostvane.llm import huffman, token_files
from hostvane.llm.queries import QUERIES
from hostvane.llm.token_ids import WordEncoder

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(token_files.default_tokenizer())


def whole(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


TRICKY = [
    "", " ", "  a", "a  b", " a ", "a \n b", "don't 'tis ''s", "x y", "日本語 テキスト", "a<|endoftext|>b", "\t\n", "naïve café ²³",
    "a\x1cb", "é x", "🙂 ok", "A" * 3000, "1234567 89", "foo\n\nbar", "foo \n", "\n foo", "a b c", "ǅ ʯ Ω", "x" + " " * 500 + "y",
]


def test_words_give_the_ids_of_the_whole_text(library):
    encoder = WordEncoder(token_files.default_tokenizer(), "<u4")
    assert encoder.by_word
    texts = TRICKY + [" ".join(TRICKY)]
    for batch in [texts, [], texts[::-1], *[[t] for t in texts]]:
        for text, ids in zip(batch, encoder.encode(batch), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == whole(library, text), repr(text)


ENCODER = []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'st  \n\té1²,. 日<|>"), max_size=30))
def test_words_against_the_library(text):
    if not ENCODER:
        ENCODER.append(WordEncoder(token_files.default_tokenizer(), "<u4"))
    encoder = ENCODER[0]
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == whole(encoder.tokenizer, text)


def kraft(lengths):
    return sum(2.0 ** -int(x) for x in lengths if x)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=60), st.integers(6, 16))
def test_codes_are_optimal_within_the_limit(counts, limit):
    counts = np.array(counts)
    lengths = huffman.code_lengths(counts, limit)
    assert lengths.max(initial=0) <= limit and ((lengths > 0) == (counts > 0)).all()
    if (counts > 0).sum() > 1:
        assert kraft(lengths) == 1.0
        import heapq

        heap = [int(c) for c in counts if c]
        heapq.heapify(heap)
        best = 0
        while len(heap) > 1:
            a = heapq.heappop(heap) + heapq.heappop(heap)
            best += a
            heapq.heappush(heap, a)
        mine = int((counts * lengths.astype(np.int64)).sum())
        assert mine >= best and (limit < 16 or mine == best)


def test_limit_binds_and_bits_come_back():
    counts = np.array([1 << k for k in range(30)])
    lengths = huffman.code_lengths(counts, 6)
    assert lengths.max() == 6 and kraft(lengths) == 1.0
    rng = np.random.default_rng(0)
    for n in (0, 1, 255, 256, 257, 5000):
        ids = rng.integers(0, 30, n)
        bits, marks = huffman.encode(ids, lengths, huffman.canonical_codes(lengths))
        assert huffman.decode(bits, n, marks, huffman.decode_table(lengths)).tolist() == ids.tolist()
        assert len(bits) == -(-int(lengths[ids].sum()) // 8)


def expected(library, rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    out, start = [], 0
    for i, t in ordered:
        ids = np.array([*whole(library, t), 2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_round_trip(make, spark, library, tmp_path):  # noqa: F811
    rows = [(30 - i, t) for i, t in enumerate(TRICKY)] + [(None, "none"), (99, None), (100, "long " * 40_000)]
    path = f"file://{tmp_path}/files"
    got = token_files.round_trip(make(rows), path, block_ids=500)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == expected(library, rows)
    blocks = spark.read.parquet(f"{path}/blocks")
    assert blocks.count() >= 2
    back = token_files.read_token_files(spark, path).where("doc_id = 100").first()
    assert np.frombuffer(back["ids"], "<u4").tolist() == [*whole(library, "long " * 40_000), 2]


def test_repeated_ids_and_empty_table(make, spark, library):  # noqa: F811
    rows = [(1, "same"), (1, "same"), (1, "other words"), (2, "x")]
    got = sorted(map(tuple, token_files.round_trip(make(rows)).collect()), key=lambda r: r[1])
    assert sorted((r[0], r[2], r[3]) for r in got) == sorted((r[0], r[2], r[3]) for r in expected(library, rows))
    assert [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got]])[:-1].tolist() and got[-1][0] == 2
    assert token_files.round_trip(make([])).collect() == []


def test_registered_query(spark, tables, library):  # noqa: F811
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    got = QUERIES["op2_token_files"](spark, tables).collect()
    assert sorted(map(tuple, got)) == expected(library, rows)


def test_steps_after_encoding_hold_no_word_cache(monkeypatch):
    from hostvane.llm import workers

    made, kept = [], {}
    monkeypatch.setattr(workers, "_kept", lambda: kept)
    workers.per_worker("model", dict)
    workers.per_worker("letters", dict)
    encoder = workers.per_worker("words", lambda: made.append(list(kept)) or {}, others=0)
    assert made == [[]] and list(kept) == ["words"] and workers.per_worker("words", list, others=0) is encoder
    list(token_files._count("<u2", 10)(iter([])))
    assert not kept


def test_parts_of_a_batch_hold_so_many_bytes():
    from hostvane.llm.workers import slices_of_bytes

    texts = ["ab", None, "cd", "é", "long" * 5, "", "e", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], ["doc_id", "text"])
    for kind in (pa.string(), pa.large_string()):
        held = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(kind)], ["doc_id", "text"])
        parts = [p.column(1).to_pylist() for p in slices_of_bytes(held, 1, 4)]
        assert parts == [["ab", None, "cd"], ["é"], ["long" * 5], ["", "e", None]]
        assert [p.column(0).to_pylist() for p in slices_of_bytes(held.slice(3, 3), 1, 4)] == [[3], [4], [5]]
    assert list(slices_of_bytes(batch.slice(0, 0), 1, 4)) == []


def test_short_texts_share_one_look_up_and_one_pass_over_the_vocabulary(monkeypatch):
    calls, encode, bincount = [], WordEncoder.encode, np.bincount
    monkeypatch.setattr(WordEncoder, "encode", lambda self, texts: calls.append(len(texts)) or encode(self, texts))
    texts = [f"text {k} of many" for k in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(texts)], ["doc_id", "text"])
    packed = list(token_files._encode(token_files.default_tokenizer(), 2, "<u2")(iter([batch])))
    assert calls == [3000]
    monkeypatch.setattr(token_files, "BYTES_AT_ONCE", 20_000)
    small = list(token_files._encode(token_files.default_tokenizer(), 2, "<u2")(iter([batch])))
    assert len(small) > 1 and sum(calls) == 6000
    assert [x for b in small for x in b.column(1).to_pylist()] == packed[0].column(1).to_pylist()
    passes = []
    monkeypatch.setattr(np, "bincount", lambda *a, **k: passes.append(1) or bincount(*a, **k))
    (got,) = token_files._count("<u2", 1 << 16)(b.select([1]) for b in packed)
    assert len(passes) == 1
    ids = np.concatenate(token_files._unpacked(packed[0].column(1), "<u2"))
    assert dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist())) == dict(zip(*np.unique(ids, return_counts=True)))


def test_every_part_gives_its_memory_back(monkeypatch):
    """Executors hold several encoders beside the JVM: what a part took must not stay with the allocators."""
    from hostvane.llm import workers

    calls, give_back = [], workers.give_back
    monkeypatch.setattr(token_files, "give_back", lambda: calls.append(1) or give_back())
    texts = [" ".join(f"w{k}x{j}" for j in range(3000)) for k in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(texts)], ["doc_id", "text"])
    given = [(len(calls), b.num_rows) for b in token_files._encode(token_files.default_tokenizer(), 2, "<u2")(iter([batch]))]
    assert [n for n, _ in given] == list(range(1, len(given) + 1)) and sum(n for _, n in given) == 500
    size = sum(map(len, texts))
    assert len(given) >= size // (4 << 20)


def test_more_text_shares_a_look_up_while_few_words_become_objects(monkeypatch, library):
    from hostvane.llm import token_ids

    calls, groups, encode, some = [], [], WordEncoder.encode, WordEncoder._some_after_space
    monkeypatch.setattr(WordEncoder, "encode", lambda self, texts: calls.append(len(texts)) or encode(self, texts))
    monkeypatch.setattr(WordEncoder, "_some_after_space", lambda self, w: groups.append(len(w)) or some(self, w))
    monkeypatch.setattr(token_ids, "WORDS_AT_ONCE", 7)
    texts = TRICKY + [" ".join(TRICKY), "same few words " * 350_000]  # 5 MB
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    (got,) = token_files._encode(token_files.default_tokenizer(), 2, "<u4")(iter([batch]))
    assert calls == [len(texts)] and len(groups) > 2 and max(groups) == 7
    for text, ids in zip(texts[:-1], token_files._unpacked(got.column(1), "<u4")):
        assert ids.tolist() == [*whole(library, text), 2], repr(text)


def test_full_cache_makes_room_by_its_oldest_half(monkeypatch, library):
    from hostvane.llm import token_ids

    monkeypatch.setattr(token_ids, "PIECES_KEPT", 10)
    made = []
    known = token_ids.Known(lambda piece: made.append(piece) or piece.upper())
    assert [known[x] for x in "abcdefghij"] == list("ABCDEFGHIJ") and known["a"] == "A" and len(made) == 10
    assert known["k"] == "K" and list(known) == list("fghijk")
    assert known["a"] == "A" and made == list("abcdefghijka")  # each held once, none beside the cache
    encoder = WordEncoder(token_files.default_tokenizer(), "<u4")
    texts = ["x" + " ".join(f"w{k} y{k % 7}" for k in range(200)), "w3 w4"]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(texts)] == [whole(library, t) for t in texts]
    assert len(encoder.known) <= 10
