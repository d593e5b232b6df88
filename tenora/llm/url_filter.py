"""Operator 6: URL filters whose block decisions reach redirect and canonical aliases.

A page's own rule always decides. For pages that no rule fits, the pages that redirects and canonical links tie
together form one class (distributed connected components), and a class with a blocked page is blocked, unless
a page of it is explicitly allowed. DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenora.llm.graph import components
from tenora.plans.staging import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """``action`` (allow or block) for ``host`` and its subdomains, where the path starts with ``path``."""

    action: str
    host: str
    path: str


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host_: Column, path_: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct (length, rule, action); null if none does. Ties: the later text.

    The list is part of the plan: meant for up to a few hundred rules.
    """
    fits = [
        F.when(
            ((host_ == r.host) | host_.endswith("." + r.host)) & path_.startswith(r.path),
            F.struct(F.lit(len(r.host + r.path)).alias("length"), F.lit(r.host + r.path).alias("rule"), F.lit(r.action).alias("action")),
        )
        for r in rules
    ]
    return F.array_max(F.array_compact(F.array(*fits)))


def canonical_link(html: Column) -> Column:
    """The href of the first ``<link rel=canonical>``, or null."""
    tag = F.regexp_extract(html, r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>""", 0)
    return F.nullif(F.regexp_extract(tag, r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", 1), F.lit(""))


def redirect_target(html: Column) -> Column:
    """The url of the first ``<meta http-equiv=refresh>``, or null."""
    tag = F.regexp_extract(html, r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>""", 0)
    return F.nullif(F.regexp_extract(tag, r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)""", 1), F.lit(""))


def resolved(target: Column, url: Column) -> Column:
    """What ``target`` names on the page ``url``, with ``&amp;`` decoded; null for other schemes, for places in the page and without a base."""
    t = F.replace(target, F.lit("&amp;"), F.lit("&"))
    scheme = F.regexp_extract(url, r"^(?s:(.*?))://", 1)
    site = F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*", 0)
    whole = F.when(t.startswith("/"), t).when(t.startswith("?"), F.concat(path(url), t)).otherwise(F.concat(F.coalesce(F.nullif(F.regexp_extract(path(url), r"(?s)^.*/", 0), F.lit("")), F.lit("/")), t))
    here = F.regexp_extract(whole, r"^[^?#]*", 0)
    steps = F.slice(F.split(here, "/"), 2, 1 << 20)
    # a dot step leaves the step before it, or none at the end, open: /a/b/.. is /a/
    open_ = F.when(F.element_at(F.split(here, "/"), -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda s, x: F.when(x == "..", F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).when(x == ".", s).otherwise(F.concat(s, F.array(x))))
    plain = F.when(F.size(kept) > 0, F.concat(F.lit("/"), F.array_join(kept, "/"), open_)).otherwise(F.lit("/"))
    plain = F.when(here.rlike(r"/\.\.?(/|$)"), plain).otherwise(here)
    return (
        F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), t)
        .when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^#") | (site == ""), F.lit(None).cast("string"))
        .when(t.startswith("//"), F.concat(scheme, F.lit(":"), t))
        .otherwise(F.concat(site, plain, F.substring(whole, F.length(here) + 1, F.length(whole))))
    )


def alias_key(url: Column) -> Column:
    """The text by which aliases are the same: scheme and host in lower case, no default port, no fragment."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    site = F.when(scheme == "http", F.regexp_replace(host(url), ":80$", "")).when(scheme == "https", F.regexp_replace(host(url), ":443$", "")).otherwise(host(url))
    return F.when(scheme == "", url).otherwise(F.concat(scheme, F.lit("://"), site, F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^#]*)", 1)))


def alias_edges(pages: DataFrame) -> DataFrame:
    """Edges (src, dst) between a page's url and the urls, made absolute, that its html names, outside comments, as canonical or redirects to."""
    has = F.lower("html")
    linked = pages.where(F.col("url").isNotNull() & (has.contains("canonical") | has.contains("refresh")))
    linked = linked.select("url", F.regexp_replace("html", r"(?s)<!--.*?(-->|\z)", " ").alias("html"))
    named = linked.select(F.col("url").alias("src"), F.explode(F.array(canonical_link(F.col("html")), redirect_target(F.col("html")))).alias("dst"))
    return named.withColumn("dst", resolved(F.col("dst"), F.col("src"))).where("dst IS NOT NULL")


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, class_url.

    ``redirects`` (src, dst urls) adds edges from a crawl log to those found in the html. ``class_url`` is the smallest
    url of the page's class (see :func:`alias_key`), null for a page without aliases. Null urls, and urls without ``://``, have an empty host
    and path and fit no rule; with nothing else known they are allowed. Repeated rows are judged each on its own.
    Only page_id, url and html are read.
    """
    pages = pages.select("page_id", "url", "html")
    edges = alias_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("src", "dst"))
    edges = edges.select(alias_key(F.col("src")).alias("src"), alias_key(F.col("dst")).alias("dst"))
    judged = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    judged = judged.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    classes = staged(components(staged(edges, "alias"), "alias"), "classes")
    if classes.isEmpty():
        verdict = F.coalesce("best.action", F.lit("allow"))
        return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), F.lit(None).cast("string").alias("class_url"))
    # urls that only an edge names are judged by their text, like pages
    members = classes.withColumn("action", best_rule(host(F.col("node")), path(F.col("node")), rules)["action"])
    decided = members.groupBy("component").agg(F.bool_or(F.col("action").eqNullSafe("block")).alias("blocked"), F.bool_or(F.col("action").eqNullSafe("allow")).alias("allowed"))
    passed = classes.join(decided, "component").select(F.col("node").alias("alias"), F.col("component").alias("class_url"), (F.col("blocked") & ~F.col("allowed")).alias("by_alias"))
    rows = judged.join(passed, alias_key(F.col("url")) == F.col("alias"), "left")
    verdict = F.coalesce("best.action", F.when(F.col("by_alias"), "block"), F.lit("allow"))
    return rows.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "class_url")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = r"""
WITH RECURSIVE rules(action, host, path) AS (
  VALUES ('allow','com','/'), ('block','example.com','/en/'), ('allow','www.example.com','/en/'), ('block','net','/es/'), ('block','net','/fr/')
), edges AS (
  SELECT url AS a, t AS b FROM (
    SELECT url, unnest([
      regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
      regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0), '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)]) AS t
    FROM pages WHERE url IS NOT NULL) WHERE contains(t, '://')
), linked AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges
), reach(a, b) AS (SELECT a, a FROM linked UNION SELECT r.a, e.b FROM reach r JOIN linked e ON r.b = e.a
), urls AS (SELECT url AS u FROM pages UNION SELECT b FROM reach
), parts AS (
  SELECT u, translate(coalesce(regexp_extract(u, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(u, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM urls
), best AS (
  SELECT p.u, p.host, p.path, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.action, length(r.host || r.path)) AS action
  FROM parts p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.u, p.host, p.path
), passed AS (
  SELECT r.a, bool_or(coalesce(b.action, '') = 'block') AND NOT bool_or(coalesce(b.action, '') = 'allow') AS blocked FROM reach r JOIN best b ON r.b = b.u GROUP BY r.a
)
SELECT p.page_id, b.host, b.path, b.rule, coalesce(b.action, CASE WHEN s.blocked THEN 'block' END, 'allow') AS verdict
FROM pages p JOIN best b ON p.url IS NOT DISTINCT FROM b.u LEFT JOIN passed s ON s.a = p.url
"""
