"""Queries of what reads rows one by one: rule automata, user checks, XML."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators import row_checks, rule_automaton, sitemap_xml
from . import duck as d
from .fixtures import view
from .registry import query

RULE_REGEX = r"'^' || replace(regexp_replace(regexp_replace(pattern, '\$$', ''), '([.+?(){}|^$\[\]\\])', '\\\1', 'g'), '*', '.*') || CASE WHEN pattern LIKE '%$' THEN '$' ELSE '' END"
OWN_RULES = f"SELECT host, pattern, allow, {RULE_REGEX} AS regex FROM robots_many r JOIN (SELECT host, max(agent) AS agent FROM robots_many WHERE agent IN ('*', 'mycrawler') GROUP BY host) b USING (host, agent)"
RULE_PATH = f"CASE WHEN {d.part('original_url', 4)} = '' THEN '/' ELSE {d.part('original_url', 4)} END || {d.part('original_url', 5)}"
JUDGED = f"SELECT seq, f.host, coalesce(arg_max(allow, length(pattern) * 2 + allow::INT) FILTER (regexp_matches(path, regex)), true) AS allowed, CAST(max(length(pattern)) FILTER (regexp_matches(path, regex)) AS INTEGER) AS specificity FROM (SELECT seq, host, {RULE_PATH} AS path FROM fetches) f LEFT JOIN own_rules r ON r.host = f.host GROUP BY seq, f.host"


@query("SELECT seq, host, allowed, specificity FROM judged", own_rules=OWN_RULES, judged=JUDGED)
def r3_robots_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that grow with the pages of a host."""
    pages = view(spark, sf_dir, "fetches").select("seq", "host", F.col("original_url").alias("url"))
    return rule_automaton.allowed(pages, view(spark, sf_dir, "robots_many"))


def numbered(page: Row):
    """Fails where an address doesn't end in a number."""
    n = int(re.search(r"([^/?#]*)/?(?:[?#].*)?$", page.url)[1])
    if n > 300:
        yield "PAGE_NUMBER_HIGH", "Info", {"n": n}


def titled(page: Row):
    title = re.search(r"<title>([^<]*)</title>", page.html)[1]
    return [("TITLE_LONG", "Warning", {"chars": len(title)})] if len(title) > 25 else None


def addressed(page: Row):
    """Fails on some pages after its first issue, which doesn't count then."""
    yield "ADDRESS_READ", "Info", None
    if page.url.startswith("http:"):
        yield "ADDRESS_PLAIN", "Warning", None
    if "?" in page.url:
        raise LookupError("no query known")


ENDS = r"regexp_extract(url, '([^/?#]*)/?(?:[?#].*)?$', 1)"
TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
USER_ISSUES = f"""
SELECT page_id, 'numbered' AS "check", 'PAGE_NUMBER_HIGH' AS code, 'Info' AS severity, try_cast({ENDS} AS INTEGER)::VARCHAR AS said FROM pages_ext WHERE regexp_full_match({ENDS}, '[0-9]+') AND try_cast({ENDS} AS INTEGER) > 300
UNION ALL SELECT page_id, 'numbered', 'CHECK_FAILED', 'Error', 'numbered: invalid literal for int() with base 10: ''' || {ENDS} || '''' FROM pages_ext WHERE NOT regexp_full_match({ENDS}, '[0-9]+')
UNION ALL SELECT page_id, 'titled', 'TITLE_LONG', 'Warning', length({TITLE})::VARCHAR FROM pages_ext WHERE length({TITLE}) > 25
UNION ALL SELECT page_id, 'addressed', 'ADDRESS_READ', 'Info', NULL FROM pages_ext WHERE NOT contains(url, '?')
UNION ALL SELECT page_id, 'addressed', 'ADDRESS_PLAIN', 'Warning', NULL FROM pages_ext WHERE NOT contains(url, '?') AND starts_with(url, 'http:')
UNION ALL SELECT page_id, 'addressed', 'CHECK_FAILED', 'Error', 'addressed: ''no query known''' FROM pages_ext WHERE contains(url, '?')
"""


@query(USER_ISSUES.replace("'addressed: ''no query known'''", "'addressed: no query known'"))
def e1_p26_user_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three checks, of which two fail on some of the pages."""
    found = row_checks.run_row_checks(view(spark, sf_dir, "pages_ext"), {"numbered": numbered, "titled": titled, "addressed": addressed}, ["page_id"], ["url", "html"])
    return found.select("page_id", "check", "code", "severity", F.coalesce(F.col("detail.n"), F.col("detail.chars"), F.col("detail.message")).alias("said"))


XML_KINDS = "SELECT host, url AS file, nth, CASE WHEN nth % 11 IN (5, 6, 8, 9) THEN 'broken' WHEN nth % 11 = 7 THEN 'unknown' WHEN nth % 11 = 4 THEN 'index' ELSE 'urlset' END AS kind FROM sitemap_xml_files"
XML_LOCS = (
    "SELECT page_id AS nth, trim(url) AS loc FROM pages_ext WHERE page_id % 11 IN (0, 1, 3, 10) UNION ALL SELECT page_id, 'ftp/x' FROM pages_ext WHERE page_id % 11 = 1 UNION ALL SELECT page_id, 'https://' || host || '/e&A' FROM pages_ext WHERE page_id % 11 = 2 "
    "UNION ALL SELECT page_id, 'https://' || host || '/a.xml' FROM pages_ext WHERE page_id % 11 = 4 UNION ALL SELECT page_id, 'b.xml' FROM pages_ext WHERE page_id % 11 = 4"
)


@query("SELECT host, file, kind, loc, kind = 'broken' AS failed FROM xml_kinds LEFT JOIN xml_locs USING (nth)", xml_kinds=XML_KINDS, xml_locs=XML_LOCS)
def r8_sitemap_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sitemap_xml.sitemap_urls(view(spark, sf_dir, "sitemap_xml_files"))
    return found.withColumn("failed", F.col("error").isNotNull()).drop("error")


@query(
    f"SELECT host, file, CASE WHEN nth % 11 = 8 THEN 'SITEMAP_XML_ERROR' ELSE 'SITEMAP_XML_PARSE_ERROR' END AS code, 1 AS n FROM xml_kinds WHERE kind = 'broken' UNION ALL SELECT host, file, 'SITEMAP_UNKNOWN_ROOT', 1 FROM xml_kinds WHERE kind = 'unknown' UNION ALL SELECT host, file, 'SITEMAP_BAD_URL', count(*) FROM xml_kinds JOIN xml_locs USING (nth) WHERE kind = 'urlset' AND {d.normalize('loc')} IS NULL GROUP BY host, file UNION ALL SELECT host, file, 'SITEMAP_URL_LIMIT_REACHED', count(*) FROM xml_kinds JOIN xml_locs USING (nth) WHERE kind = 'urlset' GROUP BY host, file HAVING count(*) > 1",
    xml_kinds=XML_KINDS, xml_locs=XML_LOCS,
)
def r8_sitemap_xml_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit of one address, so that a file goes over it."""
    return sitemap_xml.sitemap_problems(view(spark, sf_dir, "sitemap_xml_files"), max_urls=1)
