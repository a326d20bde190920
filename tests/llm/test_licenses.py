from __future__ import annotations

import textwrap

import duckdb
import pandas as pd

from corpus_fixtures import make  # noqa: F401
from hostvane.llm import licenses as L

S = L.SENTENCES
MIT = "MIT License\n\nCopyright (c) 2020 Someone\n\n" + "\n\n".join(S[i] for i in ("mit-grant", "mit-notice", "mit-as-is")) + " " + S["mit-liability"]
ROWS = [
    (1, MIT.replace(" deal in", "\ndeal in").upper()),
    (2, "x\n" + S["mit-released"] + "\nfoo. " + S["cc-by-nc"]),
    (3, S["gpl-free"] + " " + S["gpl-hope"] + " a. b. c. d. e. " + S["gpl-see"]),  # the gap is too wide
    (4, S["gpl-free"] + " " + S["gpl-hope"] + " a. b. " + S["gpl-see"]),
    (5, None),
    (6, ""),
    (7, "the license is nice. It has no warranty"),
    (1, MIT),
    (8, S["bsd-grant"] + "\n\n1. " + S["bsd-source"] + " 2. " + S["bsd-binary"] + " 3. " + S["bsd-names"]),
    (9, "word " * 60_000 + "\n" + S["apache-short"]),
    (None, S["unlicense"]),
    (10, S["mit-notice"] + " " + S["mit-grant"]),  # the wrong order
]


def test_against_sql_and_by_hand(make):  # noqa: F811
    got = sorted(map(tuple, L.scan(make(ROWS)).collect()), key=str)
    db = duckdb.connect()
    db.register("documents", pd.DataFrame(ROWS, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    assert got == sorted(db.execute(L.oracle_sql()).fetchall(), key=str)
    assert [(r[0], r[1], r[4]) for r in got if r[0] in (1, 3, 4, 8)] == [
        (1, "MIT", 4), (1, "MIT", 4), (3, "GPL-3.0-or-later", 1), (4, "GPL-3.0-or-later", 3), (8, "BSD-3-Clause", 4),
    ]
    assert {r[0] for r in got} == {1, 2, 3, 4, 8, 9, None}


def test_known_sentences_have_an_anchor_and_rules_know_their_sentences():
    assert all(any(a in s.lower() for a in L.ANCHORS) for s in S.values())
    assert len(L.known()) == len(S)
    assert all(i in S for _, _, wanted in L.RULES for i in wanted)


def test_empty(make):  # noqa: F811
    assert L.scan(make([])).collect() == []


def wrapped(text, width, leader):
    return "\n".join((leader + line).rstrip() for line in textwrap.wrap(text, width))


APACHE = [S[i] for i in ("apache-licensed", "apache-copy", "apache-as-is", "apache-see")]
BLOCKS = [
    (1, "# Copyright 2020 Someone\n#\n" + wrapped(" ".join([APACHE[0], APACHE[1]]), 70, "# ") + "\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n#\n"
        + wrapped(" ".join(APACHE[2:]), 70, "# ") + "\nimport os"),
    (2, "/*\n * Copyright (c) 2001 A\n *\n" + wrapped(S["bsd-grant"], 60, " * ") + "\n" + wrapped("1. " + S["bsd-source"], 60, " * ") + "\n"
        + wrapped("2. " + S["bsd-binary"], 60, " * ") + "\n" + wrapped("3. " + S["bsd-names"], 60, " * ") + "\n */\nint main() {}"),
    (3, "int x = 1;\n" + wrapped(S["GPL-2.0-or-later-program"], 50, "// ") + "\n//\n// more"),
    (4, "dnl a configuration\n" + wrapped(S["LGPL-2.1-or-later-library"], 72, "dnl ")),
    (5, "This is free and unencumbered software released into the public\n# domain."),
    (6, "a header without an end\n" + wrapped(S["bsl-grant"], 40, "") + "\n\nand so on"),
    (7, "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Someone\n "
        + S["gpl-family"].replace(" of this", "\n of this") + "\n\n                            Preamble\n\n  " + S["gpl-3-preamble"]),
    (8, "-- SPDX-License-Identifier: AGPL-3.0-only\nSELECT 1"),
    (9, "; " + S["mit-licensed"] + "\n; " + S["apache-short"]),
    (10, "licensed under\n" * 40 + "\n中文 licence\n*\n" + "\n".join(S["isc-grant"].split(" ")[:15])),  # unfinished
]


def test_comment_blocks_wraps_and_numbers(make):  # noqa: F811
    got = sorted(map(tuple, L.scan(make(BLOCKS)).collect()))
    assert [(r[0], r[1], r[4]) for r in got] == [
        (1, "Apache-2.0", 4), (2, "BSD-3-Clause", 4), (3, "GPL-2.0-or-later", 1), (4, "LGPL-2.1-or-later", 1), (5, "Unlicense", 1),
        (6, "BSL-1.0", 1), (7, "GPL-3.0", 2), (8, "AGPL-3.0-only", 1), (9, "Apache-2.0", 1), (9, "MIT", 1),
    ]
    db = duckdb.connect()
    db.register("documents", pd.DataFrame(BLOCKS, columns=["doc_id", "text"]))
    assert got == sorted(db.execute(L.oracle_sql()).fetchall())
