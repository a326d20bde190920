"""The pipeline, stage by stage, against brute force on what the stage before kept."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

import corpus_pipeline as C
from corpus_fixtures import make, tables  # noqa: F401
from hostvane.llm import token_files
from hostvane.session import materialize
from test_decontaminate import form
from test_simhash import brute as fingerprint
from test_simhash import linked_within

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def stages(spark, tables):  # noqa: F811
    docs, out = spark.read.parquet(f"{tables}/documents.parquet"), []
    out.append(docs.collect())
    for name, stage in C.STAGES:
        docs = materialize(stage(spark, docs, tables), name)
        out.append(docs.collect())
    return out


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_columns(spark, tables, stages):  # noqa: F811
    columns = spark.read.parquet(f"{tables}/documents.parquet").columns
    assert [s[0].__fields__ for s in stages[:-1]] == [columns] * len(C.STAGES)


def test_language_id_keeps_texts(stages):
    assert ids(stages[1]) == ids(r for r in stages[0] if r["text"] and any(map(str.isalpha, r["text"])))


def test_one_of_each_group_stays(stages):
    rows = sorted(stages[1], key=lambda r: r["doc_id"])
    label = linked_within([fingerprint(r["text"]) for r in rows], 3)
    assert ids(stages[2]) == sorted(rows[k]["doc_id"] for k in set(label))
    assert len(stages[2]) < len(stages[1])


def test_no_benchmark_passage_is_left(spark, tables, stages):  # noqa: F811
    items = [form(r["text"]) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    leaked = {r["doc_id"] for r in stages[2] if any(t in form(r["text"]) for t in items)}
    assert ids(stages[3]) == sorted({r["doc_id"] for r in stages[2]} - leaked)


def test_mix(stages):
    words = {}
    for stage in (3, 4):
        for r in stages[stage]:
            key = (stage, r["source"])
            words[key] = words.get(key, 0) + len(r["text"].split())
    assert set(ids(stages[4])) == set(ids(stages[3]))
    repeats = [words[4, s] / words[3, s] for k, s in words if k == 3]
    assert min(repeats) == 1 and 1 < max(repeats) <= C.MAX_REPEATS + 1e-6


def test_token_files(stages):
    library = tokenizers.Tokenizer.from_file(token_files.default_tokenizer())
    want, start = [], 0
    for r in sorted(stages[4], key=lambda r: r["doc_id"]):
        told = np.array([*library.encode(r["text"], add_special_tokens=False).ids, 2], "<u4")
        want.append((r["doc_id"], start, len(told), zlib.crc32(told.tobytes())))
        start += len(told)
    assert sorted(map(tuple, stages[5]), key=lambda r: r[1]) == want


def test_run(spark, tables, stages):  # noqa: F811
    assert sorted(map(tuple, C.run(spark, tables).collect())) == sorted(map(tuple, stages[5]))


def test_odd_rows(spark, make, tables):  # noqa: F811
    rows = [
        (1, "the words of this text are fine", "en", "a"), (1, "the words of this text are fine", "en", "a"), (2, None, None, None),
        (3, "", "en", None), (None, "the words of a text without name", "en", "b"), (4, "the words of this text are fine", None, "c"),
        (5, "and more words of another kind " * 5000, "en", "b"), (1, "another text of the same name", "en", "a"), (6, "12 34", "en", "a"),
    ]
    for docs in (make(rows), make([])):
        columns, n = docs.columns, docs.count()
        for _, stage in C.STAGES[:-1]:
            docs = materialize(stage(spark, docs, tables), "odd")
            assert docs.columns == columns
        out = C.STAGES[-1][1](spark, docs, tables).collect()
        # row 1 stays of its equals, rows None and 6 as the texts of their own that they are
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out) == ([(False, 1), (False, 1), (False, 5), (True, 0)] if n else [])


def test_rows_that_share_an_id_or_have_none_are_documents(spark, make, tables):  # noqa: F811
    """Rows, not ids: every group of near-duplicates keeps one row, and no text is lost without a link."""
    rng = np.random.default_rng(4)
    base = [" ".join(rng.choice(["a", "bb", "ccc", "dd", "e", "ff"], 40)) + f" {k} {k * 7} z{k}" for k in range(12)]
    rows = [(i, base[k], "en", s) for k in range(12) for i, s in ((1, "a"), (None, "b"), (k % 3, "c"), (1, "a"))]
    rows += [(None, None, "en", "a"), (7, "", "en", "a"), (None, "same without a name", None, None)] * 2
    docs = make(rows)
    kept = C.near_duplicates(spark, docs, tables)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    label = linked_within([fingerprint(r[1]) for r in rows], 3)
    assert len(got) == len(set(label))
    place = {}
    for row, l in zip(rows, label):
        place.setdefault(l, []).append((row[0] is None, row[0] or 0))
    of = {(r[0], r[1]): l for r, l in zip(rows, label)}
    assert sorted(of[g] for g in got) == sorted(set(label))
    assert all((g[0] is None, g[0] or 0) == min(place[of[g]]) for g in got)
