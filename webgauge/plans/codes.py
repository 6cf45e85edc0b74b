"""Queries for issue codes of redirects, indexing, landing pages, blocklists, contents and hosts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import checks, content, extract, graph, hosts, robots
from . import duck as d
from .content import BANDS, HASHED, NEAR, SIMHASH, STUFFED, TOKENS, _docs, _titles
from .fixtures import view
from .pages import BLOCKLIST, EXTERNAL, FLAT, HEAD
from .registry import query
from .robots import ALLOWED, GROUPED, LINES, RULES

HOPS = "SELECT seq, count(*) AS n, arg_min(split_part(location, '/', 3), CASE WHEN contains(from_url, '/hop/') THEN 1 ELSE 0 END) FILTER (split_part(location, '/', 3) <> host) AS other, any_value(host) AS own FROM redirects GROUP BY seq"
LAST2 = "array_to_string(string_split({}, '.')[-2:], '.')"
NEAR_HOST = f"{LAST2.format('own')} = {LAST2.format('other')}"


@query(d.issues("hops", "redirects", {"MULTI_REDIRECTS": ("n > 1", "Info"), "REDIRECT_TO_SUBDOMAIN": (NEAR_HOST, "Info"), "REDIRECT_TO_OTHER_DOMAIN": f"NOT ({NEAR_HOST})"}, "seq"), hops=HOPS)
def p7_p10_redirect_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second hop of a chain is the one that starts at a /hop/ address."""
    hop = F.struct(F.col("from_url").contains("/hop/").alias("nth"), "location")
    chains = view(spark, sf_dir, "redirects").groupBy("seq", "host").agg(F.array_sort(F.collect_list(hop)).alias("redirects"))
    return checks.redirect_issues(chains.withColumn("original_url", F.concat(F.lit("https://"), "host", F.lit("/"))))


HEADER = "coalesce(contains(x_robots_tag, 'noindex'), false)"


@query(f"SELECT f.seq, 'noindex' AS \"check\", 'INDEX_NOINDEX' AS code, 'Warning' AS severity FROM fetches f JOIN head h ON f.seq = h.page_id WHERE f.status_code BETWEEN 200 AND 399 AND contains(f.content_type, 'html') AND ({HEADER} OR len(h.noindex) > 0)", head=HEAD)
def p12_noindex_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.noindex_issues(view(spark, sf_dir, "fetches"))


#: Each page's first folder stands for a landing page.
LANDINGS = "SELECT seq, f.host, regexp_replace(original_url, '^(https?://[^/]+/[^/?#]*).*$', '\\1') AS original_url, x_robots_tag, len(h.noindex) > 0 AS by_meta FROM fetches f JOIN head h ON f.seq = h.page_id"


@query(
    d.issues("landings JOIN landing_allowed USING (seq)", "landing", {"LANDING_BLOCKED_BY_ROBOTS": "NOT allowed", "LANDING_NOINDEX_HEADER": HEADER, "LANDING_NOINDEX_META": "by_meta"}, "seq"),
    landings=LANDINGS, head=HEAD, robot_lines=LINES, robot_groups=GROUPED, robot_rules=RULES, landing_allowed=ALLOWED.replace("FROM fetches f", "FROM landings f"),
)
def p13_landing_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.regexp_replace("original_url", r"^(https?://[^/]+/[^/?#]*).*$", "$1")
    f = view(spark, sf_dir, "fetches").select("seq", "host", url.alias("url"), "x_robots_tag", "html")
    return checks.landing_issues(robots.allowed(f, robots.rules(view(spark, sf_dir, "robots_files"))))


LISTED = "SELECT page_id, domain, string_agg(DISTINCT zone, ', ' ORDER BY zone) AS zones, count(DISTINCT zone) AS n FROM (SELECT page_id, regexp_replace(external, '^www\\.', '') AS domain FROM external UNION SELECT page_id, array_to_string(string_split(external, '.')[-2:], '.') FROM external) c JOIN blocklist USING (domain) GROUP BY page_id, domain"


@query("SELECT page_id, 'outgoing' AS \"check\", 'OUTGOING_DOMAIN_DNSBL' AS code, 'Warning' AS severity, array_to_string(list(domain || ': ' || zones ORDER BY n DESC, domain)[1:5], '; ') AS shown FROM listed GROUP BY page_id", listed=LISTED, external=EXTERNAL, blocklist=BLOCKLIST)
def p24_blocklist_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.blocklist_issues(checks.outgoing_blocklisted(view(spark, sf_dir, "pages_ext"), spark.sql(BLOCKLIST)))


@query("SELECT page_id, 'runner' AS \"check\", 'CHECK_FAILED' AS code, 'Error' AS severity FROM pages WHERE page_id % 9 = 0")
def p26_failed_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ninth page stands for one that a check couldn't read."""
    return checks.failed_checks(view(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 9 == 0, "ValueError").alias("error")))


def _again(field: str) -> str:
    return f"SELECT page_id AS seq, 'SEO_DUPLICATE_{field.upper()}' AS code FROM (SELECT *, {d.fold(field)} AS key FROM head) k WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY host, key ORDER BY page_id) >= 2"


@query(f"SELECT * FROM ({_again('title')}) a UNION ALL SELECT * FROM ({_again('description')}) b", head=HEAD)
def d2_duplicate_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = [content.repeated(_titles(spark, sf_dir, f), text.fold(F.col("value"))).select("seq", F.lit(f"SEO_DUPLICATE_{f.upper()}").alias("code")) for f in ("title", "description")]
    return made[0].unionByName(made[1])


COPIES = f"SELECT doc_id AS seq FROM (SELECT doc_id, source, {d.fold('text')} AS key FROM documents) k WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY source, key ORDER BY doc_id) >= 2"


@query("SELECT seq, 'CONTENT_EXACT_DUPLICATE' AS code FROM copies UNION ALL SELECT seq, 'CONTENT_NEAR_DUPLICATE' FROM near WHERE seq NOT IN (SELECT seq FROM copies) UNION ALL SELECT seq, 'CONTENT_KEYWORD_STUFFING' FROM stuffed", copies=COPIES, tokens=TOKENS, hashed=HASHED, simhashes=SIMHASH, bands=BANDS, near=NEAR, stuffed=STUFFED)
def d2_d5_p22_content_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.content_issues(_docs(spark, sf_dir))


@query("SELECT page_id, 'thin' AS \"check\", 'CONTENT_THIN_PAGE' AS code, 'Warning' AS severity FROM (SELECT page_id, length(visible) AS chars, len(regexp_extract_all(lower(visible), '[\\p{L}\\p{Nd}]{2,}')) AS words, length(html) AS whole FROM flat) f WHERE chars < 600 OR words < 120 OR chars / whole < 0.05", flat=FLAT)
def p21_thin_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = content.thin(view(spark, sf_dir, "pages_ext"), extract.visible_text_flat(F.col("html")))
    return checks.issues(made, "thin", {"CONTENT_THIN_PAGE": F.col("thin")}, "page_id")


ENDS = "SELECT host, original_url AS url, final_url FROM fetches WHERE status_code < 400"
PER_HOST = f"SELECT host, bool_or(starts_with(url, 'https://')) AS https, bool_or(starts_with(url, 'http://')) AS http, bool_or(starts_with(url, 'http://') AND starts_with(final_url, 'https://')) AS led, count(DISTINCT regexp_replace({d.normalize('final_url', force_https=True)}, '^https://(www\\.)?', '')) AS keys FROM ends GROUP BY host"


@query(d.issues("per_host", "host", {"HTTPS_UNAVAILABLE": ("NOT https AND http", "Error"), "NO_HTTP_TO_HTTPS_REDIRECT_HOST": "http AND NOT led", "DOMAIN_VARIANTS_INCONSISTENT": "keys > 1"}, "host"), per_host=PER_HOST, ends=ENDS)
def j10_host_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A host's fetched pages stand for its variants."""
    f = view(spark, sf_dir, "fetches")
    return hosts.host_issues(f.select("host", F.col("original_url").alias("url"), "final_url", (F.col("status_code") < 400).alias("ok")))


TARGETS = "SELECT DISTINCT url AS seq, host, url AS original_url FROM (SELECT host, dst AS url FROM crawl_edges WHERE split_part(dst, '/', 3) = host UNION ALL SELECT host, loc FROM sitemap_entries) t"
CRAWL_EDGES = "SELECT host, src, dst FROM site_edges UNION ALL SELECT host, src, dst || '?again=1' FROM site_edges WHERE length(dst) % 5 = 0 UNION ALL SELECT host, src, 'https://elsewhere.example.org/' FROM site_edges WHERE length(dst) % 7 = 0"
BANNED = "SELECT DISTINCT host, lower(original_url) AS url FROM targets JOIN target_allowed USING (seq) WHERE NOT allowed"
WALK = (
    "SELECT host, lower(min_by(url, page_id)) AS url FROM pages_ext GROUP BY host UNION SELECT host, lower(loc) FROM sitemap_entries WHERE (host, lower(loc)) NOT IN (SELECT (host, url) FROM banned) "
    "UNION SELECT e.host, lower(e.dst) FROM walk w JOIN crawl_edges e ON w.host = e.host AND w.url = lower(e.src) WHERE split_part(e.dst, '/', 3) = e.host AND NOT contains(e.dst, '?') AND (e.host, lower(e.dst)) NOT IN (SELECT (host, url) FROM banned)"
)
MARKED = "SELECT e.host, split_part(dst, '/', 3) <> e.host AS away, contains(dst, '?') AS asks, (e.host, lower(dst)) IN (SELECT (host, url) FROM banned) AS ban FROM crawl_edges e JOIN walk w ON e.host = w.host AND lower(e.src) = w.url"
SKIPPED = "SELECT host, count(*) FILTER (away) AS external, count(*) FILTER (NOT away AND asks) AS asked, count(*) FILTER (NOT away AND NOT asks AND ban) AS ban FROM marked GROUP BY host"
#: Of several answers of an address the least counts.
FIRST_ANSWERS = "SELECT host, lower(original_url) AS url, status_code, content_type, length(html) > 1500000 AS long FROM fetches QUALIFY row_number() OVER (PARTITION BY host, lower(original_url) ORDER BY status_code NULLS FIRST, content_type NULLS FIRST, long NULLS FIRST) = 1"
ANSWERS = "SELECT w.host, count(*) AS visited, count(*) FILTER (status_code NOT BETWEEN 200 AND 299) AS errors, count(*) FILTER (status_code BETWEEN 200 AND 299 AND NOT contains(content_type, 'html')) AS other, count(*) FILTER (status_code BETWEEN 200 AND 299 AND contains(content_type, 'html') AND long) AS cut FROM walk w LEFT JOIN first_answers f ON f.host = w.host AND f.url = w.url GROUP BY w.host"
SEEDED = "SELECT host, count(*) FILTER ((host, lower(loc)) NOT IN (SELECT (host, url) FROM banned)) AS free, count(*) FILTER ((host, lower(loc)) IN (SELECT (host, url) FROM banned)) AS ban FROM sitemap_entries GROUP BY host"


@query(
    "SELECT a.host, a.visited, coalesce(s.free, 0) AS seeded, coalesce(k.ban, 0) + coalesce(s.ban, 0) AS skipped_robots, coalesce(k.external, 0) AS skipped_external, coalesce(k.asked, 0) AS skipped_query, a.errors AS skipped_http_errors, a.other AS skipped_non_html, a.cut AS truncated FROM answers a LEFT JOIN skipped k USING (host) LEFT JOIN seeded s USING (host)",
    answers=ANSWERS, first_answers=FIRST_ANSWERS, skipped=SKIPPED, seeded=SEEDED, marked=MARKED, walk=WALK, banned=BANNED, targets=TARGETS, crawl_edges=CRAWL_EDGES, robot_lines=LINES, robot_groups=GROUPED, robot_rules=RULES, target_allowed=ALLOWED.replace("FROM fetches f", "FROM targets f"),
)
def a15_crawl_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole crawl, from each host's first page and its sitemap, with links that carry a query and links to another host added."""
    pages, edges, f = view(spark, sf_dir, "pages_ext"), view(spark, sf_dir, "site_edges"), view(spark, sf_dir, "fetches")
    asking = edges.where(F.length("dst") % 5 == 0).withColumn("dst", F.concat("dst", F.lit("?again=1")))
    leaving = edges.where(F.length("dst") % 7 == 0).withColumn("dst", F.lit("https://elsewhere.example.org/"))
    edges = edges.unionByName(asking).unionByName(leaving)
    seeds = view(spark, sf_dir, "sitemap_entries").select("host", F.col("loc").alias("url"))
    targets = edges.select("host", F.col("dst").alias("url")).unionByName(seeds).distinct()
    blocked = robots.allowed(targets, robots.rules(view(spark, sf_dir, "robots_files"))).where(~F.col("allowed"))
    results = checks.truncate(f.withColumn("url", F.col("original_url")))
    return graph.crawl_counters(edges, pages.groupBy("host").agg(F.min_by("url", "page_id").alias("url")), seeds, blocked, results, max_pages=0)
