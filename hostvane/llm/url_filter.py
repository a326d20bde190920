"""URL rules with redirect equivalence. DataFrame code only.

A rule is a host, a path prefix and an action. It fits its host and all subdomains of it when the url's path
starts with the rule's; the longest fitting rule decides. Pages are then linked to the targets of their
redirects (meta refresh) and canonical links; a block rule on any url of a linked component holds for all of
its urls, except those that an allow rule fits by itself. Pages without rule or blocked alias are allowed.

Urls that differ only in scheme, fragment, default port, a closing slash or tracking parameters are one node.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostvane.llm.components import components
from hostvane.llm.exact_dedup import UPPER
from hostvane.operators.joins import join_checked
from hostvane.session import materialize

# The rules of the registered query.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
TRACKING = r"(utm_[a-z]+|gclid|fbclid|ref|mc_cid|mc_eid)"


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(action, host, path) rules as the table the operators take."""
    return spark.createDataFrame(list(rules), "action string, rule_host string, rule_path string")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #``, A-Z lower-cased; empty without ``://`` or for null."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """One name for all spellings of a url; null if it has no host."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(
        F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(f"^{TRACKING}(=|$)"))
    )
    host = F.regexp_replace(host_of(url), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    name = F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(host != "", name)


def resolved(base: Column, target: Column) -> Column:
    """``target`` as an absolute url, seen from the page at ``base``."""
    target = F.trim(F.regexp_replace(target, "&amp;", "&"))
    scheme = F.regexp_extract(base, r"^([^:/?#]+):", 1)
    folder = F.regexp_extract(path_of(base), r"^(.*/)", 1)
    origin = F.concat(scheme, F.lit("://"), host_of(base))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(origin, target))
        .when(target.startswith("#") | target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (target == ""), F.lit(None))
        .when(target.startswith("?"), F.concat(origin, path_of(base), target))
        .otherwise(F.concat(origin, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


def _unquoted(value: Column) -> Column:
    return F.regexp_replace(value, "^[\"']|[\"']$", "")


def link_targets(html: Column) -> Column:
    """Targets of canonical links and meta refreshes, as written in the page."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0))
    quoted = r"""("[^"]*"|'[^']*'|[^\s"'>]+)"""
    canonical = F.filter(tags, lambda t: t.rlike(r"""(?i)^<link\b.*\brel\s*=\s*["']?canonical["'\s/>]"""))
    refresh = F.filter(tags, lambda t: t.rlike(r"""(?i)^<meta\b.*\bhttp-equiv\s*=\s*["']?refresh["'\s/>]"""))
    hrefs = F.transform(canonical, lambda t: _unquoted(F.regexp_extract(t, rf"(?i)\bhref\s*=\s*{quoted}", 1)))
    urls = F.transform(
        refresh,
        lambda t: _unquoted(
            F.regexp_extract(
                _unquoted(F.regexp_extract(t, rf"(?i)\bcontent\s*=\s*{quoted}", 1)), r"(?i)\burl\s*=\s*(.*)$", 1
            )
        ),
    )
    return F.filter(F.concat(hrefs, urls), lambda u: u != "")


def ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (with host and path) with ``rule`` and ``action`` of the longest fitting rule, or nulls.

    Rules meet hosts, not pages: each distinct host is split into its suffixes and joined with the rules once.
    Of rules of one length, the one with the longer host wins, then allow before block.
    """
    hosts = urls.select("host").where("host != ''").distinct()
    labels = F.split("host", r"\.")
    suffixes = hosts.withColumn("i", F.explode(F.sequence(F.lit(1), F.size(labels)))).select(
        "host", F.array_join(F.slice(labels, F.col("i"), F.size(labels)), ".").alias("rule_host")
    )
    met = join_checked(suffixes, rules.select("action", "rule_host", "rule_path").distinct(), ["rule_host"])
    fitting = met.groupBy("host").agg(
        F.collect_list(
            F.struct(
                (F.length("rule_host") + F.length("rule_path")).alias("size"),
                F.length("rule_host").alias("host_size"),
                (F.col("action") == "allow").alias("allows"),
                F.concat("rule_host", "rule_path").alias("rule"),
                "rule_path",
                "action",
            )
        ).alias("rules")
    )
    joined = join_checked(urls, fitting, ["host"], "left")
    best = F.array_max(F.filter("rules", lambda r: F.col("path").startswith(r["rule_path"])))
    return joined.withColumn("best", best).select(*urls.columns, F.col("best.rule"), F.col("best.action"))


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict, alias_of.

    ``alias_of`` is the smallest url of the page's component (null for a url without host). Null urls, urls
    without ``://`` and null html are judged like any other: empty host, no rule, no links, allowed.
    Repeated rows get the same answer each; an empty table gives no rows.
    """
    own = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node")
    )
    judged = ruled(own, rules)
    links = pages.select("url", F.explode(link_targets(F.col("html"))).alias("href")).withColumn(
        "target", resolved(F.col("url"), F.col("href"))
    )
    links = materialize(
        links.select(node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b"), "target")
        .where("a IS NOT NULL AND b IS NOT NULL"),
        "links",
    )
    member = materialize(components(links.select("a", "b")), "aliases")
    targets = links.select(
        host_of(F.col("target")).alias("host"), path_of(F.col("target")).alias("path"), F.col("b").alias("node")
    ).distinct()
    blocked = (
        judged.select("node", "action").unionByName(ruled(targets, rules).select("node", "action"))
        .where("action = 'block' AND node IS NOT NULL").select("node").distinct()
    )
    # Blocked urls that nothing links to can only meet pages of the same name.
    spread = blocked.join(member, "node", "left").select(F.coalesce("component", "node").alias("alias_of")).distinct()
    placed = join_checked(judged, member, ["node"], "left", stored=True).withColumn(
        "alias_of", F.coalesce("component", "node")
    )
    spread = spread.withColumn("taint", F.lit(True))
    final = join_checked(placed, spread, ["alias_of"], "left")
    verdict = F.coalesce("action", F.when(F.col("taint"), F.lit("block")).otherwise(F.lit("allow")))
    return final.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "alias_of")


def _host_sql(url: str) -> str:
    return f"translate(regexp_extract({url}, '^.*?://([^/?#]*)', 1, 's'), '{UPPER}', '{UPPER.lower()}')"


def _path_sql(url: str) -> str:
    return f"regexp_extract({url}, '^.*?://[^/?#]*([^?#]*)', 1, 's')"


_QUOTED = """("[^"]*"|''[^'']*''|[^\\s"''>]+)"""
_VALUES = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)
ORACLE_SQL = f"""
WITH RECURSIVE rules(action, rule_host, rule_path) AS (VALUES {_VALUES}),
tags AS (
  SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\\b[^>]*>')) AS tag FROM pages
), raw AS (
  SELECT url, regexp_extract(tag, '(?i)\\bhref\\s*=\\s*{_QUOTED}', 1) AS href FROM tags
  WHERE regexp_matches(tag, '(?i)^<link\\b.*\\brel\\s*=\\s*["'']?canonical["''\\s/>]')
  UNION ALL
  SELECT url, regexp_extract(trim(regexp_extract(tag, '(?i)\\bcontent\\s*=\\s*{_QUOTED}', 1), '"'''),
                             '(?i)\\burl\\s*=\\s*(.*)$', 1)
  FROM tags WHERE regexp_matches(tag, '(?i)^<meta\\b.*\\bhttp-equiv\\s*=\\s*["'']?refresh["''\\s/>]')
), hrefs AS (
  SELECT url, trim(replace(trim(href, '"'''), '&amp;', '&')) AS href, split_part(url, ':', 1) AS scheme,
         {_host_sql('url')} AS host, {_path_sql('url')} AS path
  FROM raw WHERE trim(href, '"''') != ''
), links AS (
  SELECT url, CASE
    WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href
    WHEN starts_with(href, '//') THEN scheme || ':' || href
    WHEN starts_with(href, '/') THEN scheme || '://' || host || href
    WHEN href = '' OR starts_with(href, '#') OR regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(href, '?') THEN scheme || '://' || host || path || href
    ELSE scheme || '://' || host || coalesce(nullif(regexp_extract(path, '^(.*/)', 1), ''), '/') || href END AS target
  FROM hrefs
), parts AS (
  SELECT url, {_host_sql("coalesce(url, '')")} AS host, {_path_sql("coalesce(url, '')")} AS path,
         list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'),
           lambda q: q != '' AND NOT regexp_matches(lower(q), '^{TRACKING}(=|$)'))) AS kept
  FROM (SELECT url FROM pages UNION SELECT target FROM links)
), urls AS (
  SELECT url, host, path, CASE WHEN host != '' THEN regexp_replace(host, ':(80|443)$', '') || regexp_replace(path, '/+$', '')
         || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS node
  FROM parts
), fits AS (
  SELECT url, arg_max(r, length(rule_host) * 1000 + length(rule_path) * 1000 + length(rule_host)) AS best
  FROM (SELECT url, rule_host, rule_path, {{'rule': rule_host || rule_path, 'action': action}} AS r FROM urls JOIN rules
        ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
  GROUP BY url
), judged AS (
  SELECT urls.*, best.rule AS rule, best.action AS action FROM urls LEFT JOIN fits USING (url)
), edges AS (
  SELECT DISTINCT x.node AS a, y.node AS b FROM links JOIN urls x ON x.url = links.url JOIN urls y ON y.url = links.target
  WHERE x.node IS NOT NULL AND y.node IS NOT NULL
), both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(node, other) AS (
  SELECT node, node FROM urls WHERE node IS NOT NULL
  UNION
  SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.other
), named AS (SELECT node, min(other) AS alias_of FROM reach GROUP BY node),
spread AS (SELECT DISTINCT alias_of FROM judged JOIN named USING (node) WHERE action = 'block')
SELECT page_id, host, path, rule,
       coalesce(action, CASE WHEN spread.alias_of IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, named.alias_of
FROM pages LEFT JOIN judged ON judged.url IS NOT DISTINCT FROM pages.url
LEFT JOIN named USING (node) LEFT JOIN spread USING (alias_of)
"""
