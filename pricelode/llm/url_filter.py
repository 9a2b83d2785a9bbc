"""URL filtering with decisions that follow redirects.

Explicit rules judge a url by host and path. A page that points elsewhere, by a
canonical link or an immediate redirect in its html, is the same resource under
another name; so pages are nodes of a graph over their urls, and a component of
it is one resource. What a rule decides for one name holds for the names that no
rule fits: allow, if any name of the component is explicitly allowed, else
block, if any is blocked, else allow. A page's own rule always stands.
"""

from pyspark.sql import functions as F

from .common import ascii_lower, durable, table
from .components import connected_components

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

# Attribute values of tags, quoted or not; (?s) lets a tag span lines.
_LINK = r"(?is)<link\s[^>]*>"
_META = r"(?is)<meta\s[^>]*>"
_CANONICAL = r"(?is)\srel\s*=\s*[\"']?[^\"'>]*\bcanonical\b"
_HREF = r"(?is)\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
_REFRESH = r"(?is)\shttp-equiv\s*=\s*[\"']?\s*refresh\b"
_TARGET = r"(?is)\bcontent\s*=\s*[\"']?\s*\d+(?:\.\d*)?\s*[;,]\s*(?:url\s*=\s*)?['\"]?([^\"'>\s]+)"


def url_host(url):
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or a url without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url):
    """What follows the host up to ? # or the end; empty for null or a url without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _name(url):
    """A url's node: host, path and query, without scheme and fragment; null if it has no host."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    rest = F.when(rest == "", F.lit("/")).when(rest.startswith("?"), F.concat(F.lit("/"), rest)).otherwise(rest)
    return F.when(url_host(url) != "", F.concat(url_host(url), rest))


def _absolute(link, url):
    """link as seen from url: absolute, without a scheme, from the root, or from the page's folder."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?://)", 1)
    root = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    page = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*[^?#]*)", 1)
    folder = F.concat(root, F.coalesce(F.nullif(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/(?:[^?#]*/)?)", 1), F.lit("")), F.lit("/")))
    link = F.trim(F.regexp_replace(link, "&amp;", "&"))
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.regexp_replace(scheme, "//$", ""), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(page, link))
        .when((link == "") | link.startswith("#"), url)
        .otherwise(F.concat(folder, link))
    )


def alias_edges(pages, url_col="url", html_col="html"):
    """u, v: names of urls that stand for one resource, from canonical links and immediate redirects in html."""
    html = F.col("html")
    tags = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).where(html.ilike("%canonical%") | html.ilike("%refresh%"))
    href = F.coalesce(*[F.nullif(F.regexp_extract("tag", _HREF, k), F.lit("")) for k in (1, 2, 3)])
    canonical = tags.select("url", F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(0))).alias("tag")).where(F.col("tag").rlike(_CANONICAL)).select("url", href.alias("link"))
    refresh = tags.select("url", F.explode(F.regexp_extract_all("html", F.lit(_META), F.lit(0))).alias("tag")).where(F.col("tag").rlike(_REFRESH)).select("url", F.nullif(F.regexp_extract("tag", _TARGET, 1), F.lit("")).alias("link"))
    links = canonical.unionByName(refresh).where("link is not null")
    # As lambda variables, url and link are worked out once and not written out in each branch.
    links = links.select(F.transform(F.array(F.struct("url", "link")), lambda x: F.struct(x["url"].alias("u"), _absolute(x["link"], x["url"]).alias("v"))).alias("pair"))
    return links.select(F.explode(F.transform("pair", lambda x: F.struct(_name(x["u"]).alias("u"), _name(x["v"]).alias("v")))).alias("e")).select("e.u", "e.v").where("u is not null and v is not null")


def fitting_rule(host, path, rules):
    """Struct of rule (host and path as one string) and verdict: the longest that fits; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def judge_urls(pages, rules=RULES, edges=None, id_col="page_id", url_col="url", html_col="html"):
    """Per row: id_col, host, path, rule, verdict.

    edges: further redirects, as two columns of urls (u, v), such as from a crawl
    log. rules is a short list and becomes part of the plan. A null url, or one
    without ://, has empty host and path, fits no rule, has no aliases and is
    allowed. Null html has no links. Repeated rows are judged alike, an empty
    table gives an empty result, further columns of pages are ignored.
    """
    links = alias_edges(pages, url_col, html_col)
    if edges is not None:
        links = links.unionByName(edges.select(_name(F.col("u")).alias("u"), _name(F.col("v")).alias("v")))
    members = durable(connected_components(links))

    def decided(name):
        full = F.concat(F.lit("x://"), name)
        return fitting_rule(url_host(full), url_path(full), rules)["verdict"]

    # Names without a page count too: what a page redirects to may be blocked. 0 allow, 1 block, 2 nothing said.
    say = F.coalesce(F.when(decided(F.col("node")) == "allow", 0).when(decided(F.col("node")) == "block", 1), F.lit(2))
    groups = members.groupBy("component").agg(F.min(say).alias("say"))
    blocked = members.join(groups.where("say = 1"), "component").select(F.col("node").alias("name"), F.lit("block").alias("group_verdict"))

    url = F.col(url_col)
    judged = pages.select(F.col(id_col), url_host(url).alias("host"), url_path(url).alias("path"), _name(url).alias("name"))
    judged = judged.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules)).join(blocked, "name", "left")
    return judged.select(id_col, "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", "group_verdict", F.lit("allow")).alias("verdict"))


def op6_redirect_equivalence(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"))


def _sql_name(url):
    host = f"translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rest = f"regexp_extract({url}, '(?s)^.*?://[^/?#]*([^#]*)', 1)"
    return f"CASE WHEN {host} <> '' THEN {host} || CASE WHEN {rest} = '' THEN '/' WHEN {rest} LIKE '?%' THEN '/' || {rest} ELSE {rest} END END"


_SQL_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)

OP6_SQL = (
    r"""
WITH RECURSIVE rules(verdict, host, path) AS (VALUES """
    + _SQL_RULES
    + r"""), tags AS (
  SELECT url, unnest(regexp_extract_all(html, '(?is)<link\s[^>]*>')) AS tag, 'c' AS kind FROM pages
  UNION ALL SELECT url, unnest(regexp_extract_all(html, '(?is)<meta\s[^>]*>')), 'r' FROM pages
), links AS (
  SELECT url, trim(replace(coalesce(nullif(regexp_extract(tag, '(?is)\shref\s*=\s*"([^"]*)"', 1), ''), nullif(regexp_extract(tag, '(?is)\shref\s*=\s*''([^'']*)''', 1), ''), nullif(regexp_extract(tag, '(?is)\shref\s*=\s*([^\s"''>]+)', 1), '')), '&amp;', '&')) AS link
  FROM tags WHERE kind = 'c' AND regexp_matches(tag, '(?is)\srel\s*=\s*["'']?[^"''>]*\bcanonical\b')
  UNION ALL
  SELECT url, trim(replace(nullif(regexp_extract(tag, '(?is)\bcontent\s*=\s*["'']?\s*\d+(?:\.\d*)?\s*[;,]\s*(?:url\s*=\s*)?[''"]?([^"''>\s]+)', 1), ''), '&amp;', '&'))
  FROM tags WHERE kind = 'r' AND regexp_matches(tag, '(?is)\shttp-equiv\s*=\s*["'']?\s*refresh\b')
), whole AS (
  SELECT url, CASE
    WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
    WHEN link LIKE '//%' THEN regexp_replace(regexp_extract(url, '(?s)^(.*?://)', 1), '//$', '') || link
    WHEN link LIKE '/%' THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || link
    WHEN link LIKE '?%' THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*[^?#]*)', 1) || link
    WHEN link = '' OR link LIKE '#%' THEN url
    ELSE regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || coalesce(nullif(regexp_extract(url, '(?s)^.*?://[^/?#]*(/(?:[^?#]*/)?)', 1), ''), '/') || link END AS target
  FROM links WHERE link IS NOT NULL
), edges AS (
  SELECT """
    + _sql_name("url")
    + " AS u, "
    + _sql_name("target")
    + r""" AS v FROM whole
), both_ways AS (
  SELECT u, v FROM edges WHERE u <> v UNION SELECT v, u FROM edges WHERE u <> v
), reach(a, b) AS (
  SELECT u, v FROM both_ways UNION SELECT reach.a, e.v FROM reach JOIN both_ways e ON reach.b = e.u
), names AS (
  SELECT DISTINCT b AS name FROM reach
), said AS (
  SELECT name, (SELECT r.verdict FROM rules r
    WHERE (regexp_extract(name, '^([^/?#]*)', 1) = r.host OR ends_with(regexp_extract(name, '^([^/?#]*)', 1), '.' || r.host)) AND starts_with(regexp_extract(name, '(?s)^[^/?#]*([^?#]*)', 1), r.path)
    ORDER BY length(r.host || r.path) DESC LIMIT 1) AS verdict
  FROM names
), blocked AS (
  SELECT reach.a AS name FROM reach JOIN said ON said.name = reach.b GROUP BY reach.a HAVING count(*) FILTER (verdict = 'allow') = 0 AND count(*) FILTER (verdict = 'block') > 0
), p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, """
    + _sql_name("url")
    + r""" AS name FROM pages
), f AS (
  SELECT p.*, (SELECT struct_pack(rule := r.host || r.path, verdict := r.verdict) FROM rules r
    WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
    ORDER BY length(r.host || r.path) DESC LIMIT 1) AS fit
  FROM p
)
SELECT page_id, host, path, fit.rule AS rule,
       coalesce(fit.verdict, CASE WHEN blocked.name IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM f LEFT JOIN blocked ON f.name = blocked.name
"""
)
