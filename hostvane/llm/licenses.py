"""Licence notices in documents, by known sentences and ordered rules. DataFrame code only.

A text is cut into sentences; each is normalised and looked up among known licence sentences. The identifiers
found, in order, are matched against rules: sequences of identifiers that make up a licence text or notice, with
fewer than ``MAX_GAP`` + 1 other sentences (names, years, remarks) between two of them. A match inside a longer one is part of it.

Lines lose what stands before their first letter or digit, such as comment leaders, quotes and boxes, and the words ``dnl`` and
``rem``. A sentence ends at ``. ! ?`` before white space, at an empty line, and before an item number (``1.``, ``a)``). Of a sentence that is not
known as a whole, runs of up to ``MAX_LINES`` lines are looked up: from each line the longest known run, unless the run of
an earlier line reaches over it. Normalised means lower case, with everything but a-z and 0-9 as single spaces.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_GAP = 3
MAX_LINES = 24

# Sentences of public licences and of the notices that refer to them.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    'associated documentation files (the "Software"), to deal in the Software without restriction, including without '
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software.",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
    "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-spdx": "SPDX-License-Identifier: MIT",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
    "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and "
    "the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
    "and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
    "promote products derived from this software without specific prior written permission.",
    "bsd-3-spdx": "SPDX-License-Identifier: BSD-3-Clause",
    "bsd-2-spdx": "SPDX-License-Identifier: BSD-2-Clause",
    "apache-licensed": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
    "except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License "
    'is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "apache-short": "Licensed under the Apache License, Version 2.0.",
    "apache-spdx": "SPDX-License-Identifier: Apache-2.0",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
    "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
    "option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
    "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "gpl-3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3-spdx": "SPDX-License-Identifier: GPL-3.0-or-later",
    "gpl-3-only-spdx": "SPDX-License-Identifier: GPL-3.0-only",
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at "
    "https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "gpl-family": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it "
    "is not allowed.",
    "gpl-2-preamble": "The licenses for most software are designed to take away your freedom to share and change it.",
    "gpl-3-preamble": "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "agpl-3-preamble": "The GNU Affero General Public License is a free, copyleft license for software and other kinds of "
    "works, specifically designed to ensure cooperation with the community in the case of network server software.",
    "lgpl-3-preamble": "This version of the GNU Lesser General Public License incorporates the terms and conditions of "
    "version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    "apache-body": '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by '
    "Sections 1 through 9 of this document.",
    "apache-licensor": '"Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is '
    "granting the License.",
    "mpl-body": '"Covered Software" means Source Code Form to which the initial Contributor has attached the notice in '
    "Exhibit A, the Executable Form of such Source Code Form, and Modifications of such Source Code Form, in each case "
    "including portions thereof.",
    "epl-body": 'THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT").',
    "epl-2-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public "
    "License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl-1-notice": "This program and the accompanying materials are made available under the terms "
    "of the Eclipse Public License v1.0 which accompanies this distribution, and is available at "
    "http://www.eclipse.org/legal/epl-v10.html",
    "bsl-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the "
    'software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, '
    "distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit "
    "third-parties to whom the Software is furnished to do so, all subject to the following:",
    "bsl-notice": "Distributed under the Boost Software License, Version 1.0.",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, "
    "and to alter it and redistribute it freely, subject to the following restrictions:",
    "cc0-body": "The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related "
    'Rights (defined below) upon the creator and subsequent owner(s) (each and all, an "owner") of an original work of '
    'authorship and/or a database (each, a "Work").',
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
    "hereby granted.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by": "Licensed under CC BY 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
}
# Fixed values: (licence, kind, identifiers in order).
RULES = [
    ("MIT", "text", ["mit-grant", "mit-notice", "mit-as-is", "mit-liability"]),
    ("MIT", "text", ["mit-grant", "mit-notice"]),
    ("MIT", "notice", ["mit-released"]),
    ("MIT", "notice", ["mit-licensed"]),
    ("MIT", "tag", ["mit-spdx"]),
    ("ISC", "text", ["isc-grant"]),
    ("BSD-3-Clause", "text", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", "text", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", "tag", ["bsd-3-spdx"]),
    ("BSD-2-Clause", "tag", ["bsd-2-spdx"]),
    ("Apache-2.0", "notice", ["apache-licensed", "apache-copy", "apache-as-is", "apache-see"]),
    ("Apache-2.0", "notice", ["apache-licensed"]),
    ("Apache-2.0", "notice", ["apache-short"]),
    ("Apache-2.0", "tag", ["apache-spdx"]),
    ("GPL-3.0-or-later", "notice", ["gpl-free", "gpl-hope", "gpl-see"]),
    ("GPL-3.0-or-later", "notice", ["gpl-free"]),
    ("GPL-3.0-only", "notice", ["gpl-3-work"]),
    ("GPL-3.0-or-later", "tag", ["gpl-3-spdx"]),
    ("GPL-3.0-only", "tag", ["gpl-3-only-spdx"]),
    ("MPL-2.0", "notice", ["mpl-subject", "mpl-copy"]),
    ("MPL-2.0", "notice", ["mpl-subject"]),
    ("Unlicense", "text", ["unlicense"]),
    ("CC-BY-NC-4.0", "notice", ["cc-by-nc"]),
    ("CC-BY-4.0", "notice", ["cc-by"]),
    ("CC-BY-SA-4.0", "notice", ["cc-by-sa"]),
    ("CC-BY-4.0", "notice", ["cc-by-work"]),
    ("CC-BY-SA-4.0", "notice", ["cc-by-sa-work"]),
    ("CC-BY-NC-4.0", "notice", ["cc-by-nc-work"]),
    ("GPL-2.0", "text", ["gpl-family", "gpl-2-preamble"]),
    ("GPL-3.0", "text", ["gpl-family", "gpl-3-preamble"]),
    ("AGPL-3.0", "text", ["gpl-family", "agpl-3-preamble"]),
    ("LGPL-3.0", "text", ["gpl-family", "lgpl-3-preamble"]),
    ("Apache-2.0", "text", ["apache-body", "apache-licensor"]),
    ("MPL-2.0", "text", ["mpl-body"]),
    ("EPL", "text", ["epl-body"]),
    ("EPL-2.0", "notice", ["epl-2-notice"]),
    ("EPL-1.0", "notice", ["epl-1-notice"]),
    ("BSL-1.0", "text", ["bsl-grant"]),
    ("BSL-1.0", "notice", ["bsl-notice"]),
    ("Zlib", "text", ["zlib-as-is", "zlib-grant"]),
    ("CC0-1.0", "text", ["cc0-body"]),
    ("0BSD", "text", ["0bsd-grant"]),
]
# SPDX identifiers that a tag may name, besides those above.
TAGGED = [
    "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0",
    "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "EPL-1.0", "EPL-2.0",
    "BSL-1.0", "Zlib", "CC0-1.0", "0BSD", "ISC", "Unlicense", "Apache-2.0 OR MIT", "MIT OR Apache-2.0", "CC-BY-4.0",
    "CC-BY-SA-4.0", "CC-BY-NC-4.0",
]
for _id in TAGGED:
    SENTENCES[f"{_id}-tag"] = f"SPDX-License-Identifier: {_id}"
    RULES.append((_id, "tag", [f"{_id}-tag"]))
# Fixed values: (SPDX name, words of the licence's name, versions) of the family whose notices share one wording.
GNU = [
    ("GPL", "GNU General Public License", ["2", "3"]),
    ("LGPL", "GNU Lesser General Public License", ["2.1", "3"]),
    ("AGPL", "GNU Affero General Public License", ["3"]),
]
for _short, _name, _versions in GNU:
    for _what in ("program", "library", "software", "file"):
        for _v in _versions:
            _spdx = f"{_short}-{_v if '.' in _v else _v + '.0'}"
            _start = f"This {_what} is free software; you can redistribute it and/or modify it under the terms of the {_name} as published by the Free Software Foundation"
            for _end, _kind in ((f"; either version {_v} of the License, or (at your option) any later version.", "or-later"), (f"; version {_v} of the License.", "only")):
                _key = f"{_spdx}-{_kind}-{_what}"
                if not (_short == "GPL" and _what == "program" and _v == "3" and _kind == "or-later"):  # gpl-free
                    SENTENCES[_key] = _start + _end
                    RULES.append((f"{_spdx}-{_kind}", "notice", [_key]))
# Every known sentence has one of these; texts without any need no closer look.
ANCHORS = ["licen", "permission", "copyright", "redistribut", "warrant", "distributed", "unencumbered", "contributor"]

LEADERS = r"(^|\n)[^A-Za-z0-9\n]*(?:(?:dnl|rem|REM)[ \t]+[^A-Za-z0-9\n]*)?"
ITEMS = r"\n[0-9A-Za-z]{1,2}[.)][ \t]+"
ENDS = r"([.!?])[ \t\n\r\f]+|\n[ \t\r\f]*\n[ \t\n\r\f]*"
MARK = "\x01"


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def known(sentences: dict[str, str] = SENTENCES) -> dict[str, str]:
    """Normalised sentence to identifier."""
    return {normal(s): i for i, s in sentences.items()}


def _normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def first_words(sentences: dict[str, str] = SENTENCES) -> list[str]:
    return sorted({body.split(" ")[0] for body in known(sentences)})


def identifiers(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """Known identifiers of a text in order, as array<struct<id, place>>; the place is the sentence's number."""
    lookup = F.create_map(*[F.lit(x) for pair in known(sentences).items() for x in pair])
    begins = F.array(*[F.lit(w) for w in first_words(sentences)])
    open_text = F.regexp_replace(F.regexp_replace(text, LEADERS, "$1"), ITEMS, "\n\n")
    cut = F.split(F.regexp_replace(open_text, ENDS, f"$1{MARK}"), MARK)

    def in_lines(sentence: Column) -> Column:
        lines = F.transform(F.split(sentence, "\n"), _normal)

        def longest(line: Column, i: Column) -> Column:
            lengths = F.sequence(F.lit(1), F.least(F.lit(MAX_LINES), F.size(lines) - i))
            told = F.transform(lengths, lambda n: F.struct(
                F.try_element_at(lookup, F.array_join(F.slice(lines, i + 1, n), " ")).alias("id"), n.alias("n")
            ))
            last = F.try_element_at(F.filter(told, lambda t: t["id"].isNotNull()), F.lit(-1))
            found = F.struct(i.alias("line"), last["id"].alias("id"), (i + last["n"]).alias("end"))
            return F.when(F.array_contains(begins, F.substring_index(line, " ", 1)) & last.isNotNull(), found)

        runs = F.filter(F.transform(lines, longest), lambda r: r.isNotNull())
        # Evaluates the runs once: a variable of a lambda, not an expression to be repeated.
        outer = F.transform(F.array(runs), lambda rs: F.filter(
            rs, lambda r: ~F.exists(rs, lambda o: (o["line"] < r["line"]) & (o["end"] > r["line"]))
        ))
        return F.transform(F.get(outer, 0), lambda r: r["id"])

    def told(sentence: Column, k: Column) -> Column:
        whole = F.try_element_at(lookup, _normal(sentence))
        ids = F.when(whole.isNotNull(), F.array(whole)).when(F.instr(sentence, "\n") > 0, in_lines(sentence))
        return F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda i: F.struct(i.alias("id"), k.alias("place")))

    return F.flatten(F.transform(cut, told))


def _found(ids: Column, rules: list[tuple[str, str, list[str]]], max_gap: int) -> Column:
    """array<struct<first, n, rule, place>> of all rule matches: ``n`` identifiers from number ``first`` on."""
    by_first: dict[str, list[Column]] = {}
    for number, (_, _, wanted) in enumerate(rules):
        rule = F.struct(F.lit(number).alias("rule"), F.array(*[F.lit(w) for w in wanted]).alias("wanted"))
        by_first.setdefault(wanted[0], []).append(rule)
    table = F.create_map(*[x for first, some in by_first.items() for x in (F.lit(first), F.array(*some))])

    def fits(k: Column, wanted: Column) -> Column:
        part = F.slice(ids, k + 1, F.size(wanted))
        steps = F.transform(part, lambda x, j: F.when(j > 0, x["place"] - F.get(part, j - 1)["place"]).otherwise(1))
        return (F.transform(part, lambda x: x["id"]) == wanted) & (F.array_max(steps) <= max_gap + 1)

    def matches(s: Column, k: Column) -> Column:
        fitting = F.filter(F.try_element_at(table, s["id"]), lambda r: fits(k, r["wanted"]))
        return F.transform(
            fitting,
            lambda r: F.struct(k.alias("first"), F.size(r["wanted"]).alias("n"), r["rule"].alias("rule"), s["place"].alias("place")),
        )

    return F.flatten(F.filter(F.transform(ids, matches), lambda m: m.isNotNull()))


def scan(
    docs: DataFrame,
    sentences: dict[str, str] = SENTENCES,
    rules: list[tuple[str, str, list[str]]] = RULES,
    anchors: list[str] = ANCHORS,
    max_gap: int = MAX_GAP,
) -> DataFrame:
    """doc_id, license, kind, sentence, n_sentences: one row per match in ``docs`` (doc_id, text).

    ``sentence`` is the place of the match's first sentence. Null and empty texts, and texts without a notice, give no rows;
    repeated rows give theirs each.
    """
    near = docs.select("doc_id", "text").where(F.lower("text").rlike("|".join(anchors)))
    ids = near.select("doc_id", identifiers(F.col("text"), sentences).alias("ids")).where(F.size("ids") > 0)
    found = ids.select("doc_id", _found(F.col("ids"), rules, max_gap).alias("found"))
    longest = F.filter(
        "found",
        lambda m: ~F.exists(
            "found",
            lambda o: (o["n"] > m["n"]) & (o["first"] <= m["first"]) & (o["first"] + o["n"] >= m["first"] + m["n"]),
        ),
    )
    one = found.select("doc_id", F.explode(longest).alias("m"))
    names = F.array(*[F.lit(r[0]) for r in rules])
    kinds = F.array(*[F.lit(r[1]) for r in rules])
    return one.select(
        "doc_id",
        F.get(names, F.col("m.rule")).alias("license"),
        F.get(kinds, F.col("m.rule")).alias("kind"),
        F.col("m.place").cast("long").alias("sentence"),
        F.col("m.n").cast("long").alias("n_sentences"),
    )


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle_sql() -> str:
    """DuckDB SQL for ``scan`` with the fixed sentences and rules."""
    sentences = ", ".join(f"({_sql_text(s)}, {_sql_text(i)})" for s, i in known().items())
    rules = ", ".join(f"({k}, {_sql_text(a)}, {_sql_text(b)}, [{', '.join(map(_sql_text, w))}])" for k, (a, b, w) in enumerate(RULES))
    clean = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
    opened = f"regexp_replace(regexp_replace(text, '{LEADERS}', '\\1', 'g'), '{ITEMS}', chr(10) || chr(10), 'g')"
    return f"""
WITH known(body, id) AS (VALUES {sentences}),
rules(rule, license, kind, wanted) AS (VALUES {rules}),
cut AS (
  SELECT row_number() OVER () AS r, doc_id,
         string_split(regexp_replace({opened}, '{ENDS}', '\\1' || chr(1), 'g'), chr(1)) AS parts
  FROM documents WHERE text IS NOT NULL
), sentences AS (
  SELECT r, doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS k FROM cut
), whole AS (
  SELECT r, doc_id, k, part, id FROM sentences LEFT JOIN known ON body = {clean.format('part')}
), lines AS (
  SELECT r, doc_id, k, unnest(string_split(part, chr(10))) AS part,
         generate_subscripts(string_split(part, chr(10)), 1) - 1 AS line
  FROM whole WHERE id IS NULL AND contains(part, chr(10))
), tidy AS (
  SELECT r, doc_id, k, line, {clean.format('part')} AS body FROM lines
), starts AS (
  SELECT * FROM tidy WHERE string_split(body, ' ')[1] IN (SELECT string_split(body, ' ')[1] FROM known)
), grown AS (
  SELECT s.r, s.doc_id, s.k, s.line, t.line + 1 AS after,
         string_agg(t.body, ' ') OVER (PARTITION BY s.r, s.k, s.line ORDER BY t.line) AS body
  FROM starts s JOIN tidy t ON t.r = s.r AND t.k = s.k AND t.line BETWEEN s.line AND s.line + {MAX_LINES - 1}
), runs AS (
  SELECT r, doc_id, k, line, max(after) AS after, max_by(id, after) AS id FROM grown JOIN known USING (body)
  GROUP BY r, doc_id, k, line
), placed AS (
  SELECT r, doc_id, k AS place, 0 AS line, id FROM whole WHERE id IS NOT NULL
  UNION ALL
  SELECT r, doc_id, k, line, id FROM runs m
  WHERE NOT EXISTS (SELECT 1 FROM runs o WHERE o.r = m.r AND o.k = m.k AND o.line < m.line AND o.after > m.line)
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY place, line) AS nth FROM placed
), found AS (
  SELECT a.r, a.doc_id, a.nth, a.place, rule, license, kind, len(wanted) AS n
  FROM rules JOIN ordered a ON a.id = wanted[1] JOIN ordered b ON b.r = a.r AND b.nth BETWEEN a.nth AND a.nth + len(wanted) - 1
  LEFT JOIN ordered c ON c.r = a.r AND c.nth = b.nth - 1 AND b.nth > a.nth
  GROUP BY a.r, a.doc_id, a.nth, a.place, rule, license, kind, wanted
  HAVING list(b.id ORDER BY b.nth) = wanted AND max(coalesce(b.place - c.place, 1)) <= {MAX_GAP} + 1
)
SELECT doc_id, license, kind, place AS sentence, n AS n_sentences FROM found m
WHERE NOT EXISTS (SELECT 1 FROM found o WHERE o.r = m.r AND o.n > m.n AND o.nth <= m.nth AND o.nth + o.n >= m.nth + m.n)
"""
