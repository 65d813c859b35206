"""URL filters with redirect equivalence.

A rule fits a URL whose host is the rule's or below it and whose path starts with the rule's;
the longest rule decides. A URL that no rule fits is blocked if one of its aliases is blocked
by a rule, and allowed otherwise. Aliases are the URLs connected by redirects and canonical
links, whichever way they point. Only blocks spread; a URL's own allow rule always stands.

Links are read off the pages (canonical links and refresh redirects) and can be given as a
table too. A target that is relative (``//host/x``, ``/x``, ``x``, ``?x``) is resolved against
its page's URL; one with another kind of scheme (``mailto:``) is no link. The graph holds linked
URLs only, so pages without links never enter it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import connected_components

#: (verdict, host, path prefix)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TAG = r"(?is)<(?:link|meta)\b[^>]*>"
CANONICAL = r"""(?is)\brel\s*=\s*(?:"[^"]*\bcanonical\b|'[^']*\bcanonical\b|canonical[\s/>])"""
REFRESH = r"""(?is)\bhttp-equiv\s*=\s*["']?refresh["'\s/>]"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH_URL = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; '' for null or where there is none."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does."""
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in longest]
    none = F.lit(None).cast("string")
    rule = reduce(lambda c, x: c.when(x[0], F.lit(x[1][1] + x[1][2])), zip(fits[1:], longest[1:], strict=True), F.when(fits[0], F.lit(longest[0][1] + longest[0][2]))).otherwise(none)
    verdict = reduce(lambda c, x: c.when(x[0], F.lit(x[1][0])), zip(fits[1:], longest[1:], strict=True), F.when(fits[0], F.lit(longest[0][0]))).otherwise(none)
    return rule, verdict


def resolved(base: Column, target: Column) -> Column:
    """The address that ``target`` means on the page ``base``; null where it is none."""
    start = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    directory = F.regexp_extract(path(base), r"(?s)^(.*/)", 1)
    return (
        F.when(target.contains("://"), target)
        .when(target.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(target.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), target))
        .when(target.startswith("/"), F.concat(start, target))
        .when(target.startswith("?"), F.concat(start, path(base), target))
        .when(target.startswith("#") | (target == ""), F.lit(None).cast("string"))
        .otherwise(F.concat(start, F.when(directory == "", F.lit("/")).otherwise(directory), target))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(src, dst): the absolute addresses that pages name as canonical or redirect to."""
    tags = pages.filter(F.col("url").isNotNull() & F.col("html").rlike(r"(?i)canonical|http-equiv"))
    tag = tags.select(F.col("url").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(TAG), F.lit(0))).alias("tag"))
    to = F.when(F.col("tag").rlike(CANONICAL), F.regexp_extract("tag", HREF, 1)).when(F.col("tag").rlike(REFRESH), F.regexp_extract("tag", REFRESH_URL, 1))
    return tag.filter(F.col("src").contains("://")).select("src", resolved(F.col("src"), to).alias("dst")).filter("dst is not null")


def node(url: Column) -> Column:
    """A URL without scheme and fragment, its host in lower case."""
    rest = after_scheme(url)
    return F.concat(host(url), F.regexp_extract(rest, r"(?s)^[^/?#]*([^#]*)", 1))


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages`` (page_id, url, html, more).

    redirects: further links (src, dst). host and path are '' for a null url or one without
    ``://``; such a url has no aliases. rule is null where no rule fits. Repeated rows are
    judged alike; other columns are ignored; without links only the rules decide.
    """
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("src", "dst"))
    edges = links.select("src", "dst").filter("src like '%://%' and dst like '%://%'")
    # a linked URL may be no page of ours: its own verdict still counts
    edges = edges.select(node(F.col("src")).alias("a"), node(F.col("dst")).alias("b"))
    found = connected_components(edges)
    as_url = F.concat(F.lit("x://"), F.col("node"))
    _, own = rule_of(host(as_url), path(as_url), rules)
    blocked = found.withColumn("own", own).groupBy("component").agg(F.max((F.col("own") == "block").cast("int")).alias("any")).filter("any = 1")
    spread = found.join(blocked, "component").select("node", F.lit(True).alias("blocked"))

    judged = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), node(F.col("url")).alias("node"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = judged.withColumn("rule", rule).withColumn("own", verdict).join(spread, "node", "left")
    said = F.coalesce("own", F.when(F.col("blocked"), F.lit("block")), F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", said.alias("verdict"))


#: DuckDB: rules and links as above; the components as a recursive closure.
SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), t AS (
  SELECT url AS src, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM pages
  WHERE url LIKE '%://%' AND regexp_matches(html, '(?i)canonical|http-equiv')
), o AS (
  SELECT src, CASE WHEN regexp_matches(tag, '(?is)\brel\s*=\s*(?:"[^"]*\bcanonical\b|''[^'']*\bcanonical\b|canonical[\s/>])') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
    WHEN regexp_matches(tag, '(?is)\bhttp-equiv\s*=\s*["'']?refresh["''\s/>]') THEN regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) END AS dst, regexp_extract(src, '(?s)^(.*?://[^/?#]*)', 1) AS start, regexp_extract(substr(src, instr(src, '://') + 3), '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM t
), l AS (
  SELECT src, CASE WHEN dst LIKE '%://%' THEN dst WHEN regexp_matches(dst, '(?s)^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(dst, '//') THEN regexp_extract(src, '(?s)^(.*?:)//', 1) || dst WHEN starts_with(dst, '/') THEN start || dst
    WHEN starts_with(dst, '?') THEN start || path || dst WHEN starts_with(dst, '#') OR dst = '' THEN NULL
    ELSE start || CASE WHEN regexp_extract(path, '(?s)^(.*/)', 1) = '' THEN '/' ELSE regexp_extract(path, '(?s)^(.*/)', 1) END || dst END AS dst FROM o
), e AS (
  SELECT src AS a, dst AS b FROM l WHERE dst LIKE '%://%' UNION SELECT dst, src FROM l WHERE dst LIKE '%://%'
), n AS (
  SELECT translate(regexp_extract(substr(a, instr(a, '://') + 3), '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(substr(a, instr(a, '://') + 3), '(?s)^[^/?#]*([^#]*)', 1) AS a,
    translate(regexp_extract(substr(b, instr(b, '://') + 3), '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(substr(b, instr(b, '://') + 3), '(?s)^[^/?#]*([^#]*)', 1) AS b FROM e
), reach AS (
  SELECT a, b FROM n UNION SELECT r.a, n.b FROM reach r JOIN n ON r.b = n.a
), alias AS (
  SELECT a, b, regexp_extract(b, '(?s)^([^/?#]*)', 1) AS host, regexp_extract(b, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM reach
), rules(verdict, host, path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), spread AS (
  SELECT DISTINCT a FROM (
    SELECT a, b, (SELECT r.verdict FROM rules r WHERE (alias.host = r.host OR ends_with(alias.host, '.' || r.host)) AND starts_with(alias.path, r.path) ORDER BY length(r.host || r.path) DESC LIMIT 1) AS verdict FROM alias
  ) WHERE verdict = 'block'
), j AS (
  SELECT row_number() OVER () AS own, page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '(?s)^[^/?#]*([^#]*)', 1) AS tail FROM p
), f AS (
  SELECT j.own, j.page_id, j.host, j.path, j.tail, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY j.own ORDER BY length(r.host || r.path) DESC NULLS LAST) AS k
  FROM j LEFT JOIN rules r ON (j.host = r.host OR ends_with(j.host, '.' || r.host)) AND starts_with(j.path, r.path)
)
SELECT f.page_id, f.host, f.path, f.rule, coalesce(f.verdict, CASE WHEN s.a IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM f LEFT JOIN spread s ON s.a = f.host || f.tail WHERE k = 1
"""
