from __future__ import annotations

import duckdb
import pandas as pd

from hostvane.llm import url_filter as U

CANONICAL = '<html><head><LINK  href="{0}" rel="canonical"></head></html>'
REFRESH = "<meta http-equiv='Refresh' content='0; URL={0}'>"
PAGES = [
    (1, "http://a.example.com/de/1", None),
    (2, "https://clean.org/x/1", CANONICAL.format("http://a.example.com/de/1#top")),  # an alias of a blocked page
    (3, "http://clean.org/fr/2", CANONICAL.format("https://a.example.com/de/1?utm_source=x")),  # allowed by a rule of its own
    (4, "http://third.org/y", REFRESH.format("//clean.org/x/1/")),  # a redirect to an alias
    (5, "http://www.Example.NET/en/a?q=1", ""),
    (6, "http://www.example.net/de/a", "<a href='http://clean.org/x/9'>no link</a>"),
    (7, None, CANONICAL.format("http://a.example.com/de/1")),
    (8, "no scheme", "<p>"),
    (9, "http://far.org/z", CANONICAL.format("/w?b=2&amp;a=1")),
    (10, "http://far.org/w?a=1&b=2", REFRESH.format("http://spam.net/never/crawled")),  # its target is no page
    (11, "http://net", None),
    (12, "http://evil-example.com/de/", "x" * 100_000),
    (13, "https://user.info/a#http://x.net/", None),
    (14, "http://HOST.Net/?x", None),
    (1, "http://a.example.com/de/1", None),
    (None, "http://lonely.org/", CANONICAL.format("mailto:someone")),
]


def test_against_sql(spark):
    df = spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id long, url string, html string, rule string, host string")
    got = sorted(map(tuple, U.judge(df, U.rule_table(spark)).collect()), key=str)
    db = duckdb.connect()
    db.register("pages", pd.DataFrame(PAGES, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"}))
    found = db.execute(f"SELECT page_id, host, path, rule, verdict, alias_of FROM ({U.ORACLE_SQL})").fetchall()
    assert got == sorted(found, key=str)
    verdicts = {r[0]: r[4] for r in got}
    blocked = {i for i, v in verdicts.items() if v == "block"}
    assert blocked == {1, 2, 4, 6, 9, 10, 14}
    assert {i: r for i, _, _, r, _, _ in got}[3] == "org/fr/"


def test_longest_rule_wins_and_ties_allow(spark):
    rules = U.rule_table(spark, [("block", "a.b", "/"), ("allow", "a.b", "/"), ("block", "x.a.b", "/long/"), ("allow", "b", "/longer/path")])
    urls = [(1, "http://a.b/", None), (2, "http://x.a.b/long/", None), (3, "http://x.a.b/longer/path", None)]
    got = U.judge(spark.createDataFrame(urls, "page_id long, url string, html string"), rules)
    assert {r.page_id: r.rule for r in got.collect()} == {1: "a.b/", 2: "x.a.b/long/", 3: "b/longer/path"}
    assert {r.page_id: r.verdict for r in got.collect()} == {1: "allow", 2: "block", 3: "allow"}


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert U.judge(pages, U.rule_table(spark)).collect() == []
