"""Queries over robots files and sitemaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import checks, extract, graph, robots
from . import duck as d
from .fixtures import view
from .pages import CANONICAL, HEAD, LAST, SEGMENTS  # noqa: F401
from .registry import query

LINES = "SELECT host, line, text, lower(trim(split_part(text, ':', 1))) AS key, trim(substr(text, strpos(text, ':') + 1)) AS value, contains(text, ':') AS colon FROM (SELECT host, line, trim(regexp_replace(raw, '#.*$', '')) AS text FROM (SELECT host, unnest(string_split(body, chr(10))) AS raw, unnest(range(1, 1 + len(string_split(body, chr(10))))) AS line FROM robots_files) a) b WHERE text <> ''"
GROUPED = "SELECT *, sum(begins) OVER (PARTITION BY host ORDER BY line) AS grp FROM (SELECT *, CASE WHEN key = 'user-agent' AND coalesce(lag(key) OVER (PARTITION BY host ORDER BY line), 'allow') <> 'user-agent' THEN 1 ELSE 0 END AS begins FROM robot_lines WHERE key IN ('user-agent', 'allow', 'disallow')) x"
RULES = "SELECT DISTINCT a.host, lower(a.value) AS agent, r.key = 'allow' AS allow, r.value AS pattern, '^' || replace(replace(regexp_replace(r.value, '\\$$', ''), '.', '\\.'), '*', '.*') || CASE WHEN r.value LIKE '%$' THEN '$' ELSE '' END AS regex, length(r.value) AS specificity FROM robot_groups a JOIN robot_groups r ON a.host = r.host AND a.grp = r.grp WHERE a.key = 'user-agent' AND r.key <> 'user-agent' AND r.value <> ''"
ALLOWED = f"SELECT f.seq, coalesce(arg_max(r.allow, r.specificity * 2 + r.allow::INT) FILTER (regexp_matches({d.part('f.original_url', 4)} || {d.part('f.original_url', 5)}, r.regex)), true) AS allowed FROM fetches f LEFT JOIN (SELECT r.* FROM robot_rules r JOIN (SELECT host, max(agent) FILTER (agent IN ('*', 'mycrawler')) AS agent FROM robot_rules GROUP BY host) b USING (host, agent)) r ON r.host = f.host GROUP BY f.seq"
MADE = {"robot_lines": LINES, "robot_groups": GROUPED, "robot_rules": RULES, "robot_allowed": ALLOWED, "head": HEAD}
STATE = "SELECT f.host, f.seq, f.original_url AS url, CASE WHEN NOT allowed THEN 'robots_blocked' WHEN status_code >= 400 THEN 'http_error' WHEN coalesce(contains(x_robots_tag, 'noindex'), false) THEN 'noindex_header' WHEN NOT contains(content_type, 'html') THEN 'indexable' WHEN len(h.noindex) > 0 THEN 'noindex_meta' ELSE 'indexable' END AS state FROM fetches f JOIN robot_allowed USING (seq) JOIN head h ON h.page_id = f.seq"


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = view(spark, sf_dir, "fetches").withColumn("url", F.col("original_url")).withColumn("metas", extract.metas(F.col("html"))).drop("html")
    return robots.indexability(robots.allowed(f, robots.rules(view(spark, sf_dir, "robots_files"))), checks.noindex_header(), checks.noindex_meta())


@query("SELECT host, agent, allow, pattern, regex, CAST(specificity AS INTEGER) AS specificity FROM robot_rules", **MADE)
def r1_r2_w6_robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robots.rules(view(spark, sf_dir, "robots_files"))


@query("SELECT seq, allowed FROM robot_allowed", **MADE)
def r3_robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = view(spark, sf_dir, "fetches").select("seq", "host", F.col("original_url").alias("url"))
    return robots.allowed(f, robots.rules(view(spark, sf_dir, "robots_files"))).select("seq", "allowed")


@query(f"SELECT host, line, code FROM (SELECT host, line, CASE WHEN NOT colon THEN 'ROBOTS_BAD_LINE' WHEN key NOT IN ('user-agent', 'disallow', 'allow', 'sitemap', 'crawl-delay', 'host') THEN 'ROBOTS_UNKNOWN_DIRECTIVE' WHEN key = 'crawl-delay' AND try_cast(value AS DOUBLE) IS NULL THEN 'ROBOTS_BAD_CRAWL_DELAY' END AS code FROM robot_lines) x WHERE code IS NOT NULL", **MADE)
def r4_robots_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robots.lint(view(spark, sf_dir, "robots_files")).withColumn("line", F.col("line").cast("bigint"))


@query("SELECT DISTINCT host, 'ROBOTS_FETCH_FAILED' AS code FROM pages_ext WHERE length(host) % 4 = 0")
def r5_robots_host_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = view(spark, sf_dir, "robots_files").where("length(host) % 4 <> 0")
    return robots.host_state(view(spark, sf_dir, "pages_ext").select("host").distinct(), files)


@query("SELECT host, 'https://' || host || '/sitemap.xml' AS sitemap_url FROM robots_files")
def r6_sitemap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robots.sitemaps_of(view(spark, sf_dir, "robots_files"))


@query("SELECT seq, state FROM states", states=STATE, **MADE)
def j6_indexability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir).select("seq", "state")


HOMES = "SELECT f.host, allowed, status_code, coalesce(contains(x_robots_tag, 'noindex'), false) AS by_header, len(h.noindex) > 0 AS by_meta FROM fetches f JOIN robot_allowed USING (seq) JOIN head h ON h.page_id = f.seq QUALIFY row_number() OVER (PARTITION BY f.host ORDER BY f.seq) = 1"


@query("SELECT host, 'SITE_INDEX_BLOCKED_BY_ROBOTS' AS code FROM homes WHERE NOT allowed UNION ALL SELECT host, 'SITE_INDEX_HOMEPAGE_HTTP_ERROR' FROM homes WHERE status_code >= 400 UNION ALL SELECT host, 'SITE_INDEX_HOMEPAGE_NOINDEX_HEADER' FROM homes WHERE by_header UNION ALL SELECT host, 'SITE_INDEX_HOMEPAGE_NOINDEX_META' FROM homes WHERE by_meta", homes=HOMES, **MADE)
def r7_site_indexability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of a host stands for its homepage."""
    first = view(spark, sf_dir, "fetches").groupBy("host").agg(F.min("seq").alias("seq")).select("seq")
    home = _states(spark, sf_dir).join(first, "seq")
    return robots.site_indexability(home.select("host", "allowed", "status_code", checks.noindex_header().alias("by_header"), checks.noindex_meta().alias("by_meta")))


@query(f"SELECT seq, NOT allowed AS blocked, coalesce(contains(x_robots_tag, 'noindex'), false) AS by_header FROM (SELECT seq, original_url AS url, x_robots_tag FROM fetches) f JOIN robot_allowed USING (seq) WHERE len({SEGMENTS}) <= 2", **MADE)
def p13_landing_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = view(spark, sf_dir, "fetches").select("seq", "host", F.col("original_url").alias("url"), "x_robots_tag").where(F.size(urls.segments(F.col("url"))) <= 2)
    return robots.allowed(f, robots.rules(view(spark, sf_dir, "robots_files"))).select("seq", (~F.col("allowed")).alias("blocked"), checks.noindex_header().alias("by_header"))


@query(f"SELECT c.page_id, CASE WHEN f.status_code >= 400 THEN 'CANONICAL_TARGET_HTTP_ERROR' ELSE 'CANONICAL_TARGET_BLOCKED_OR_NOINDEX' END AS code FROM canonical c JOIN fetches f ON {d.normalize('c.target')} = {d.normalize('f.original_url')} WHERE f.status_code >= 400 OR coalesce(contains(x_robots_tag, 'noindex'), false)", canonical=CANONICAL, head=HEAD)
def p17_canonical_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.canonical_targets(checks.canonical_facts(view(spark, sf_dir, "pages_ext")), view(spark, sf_dir, "fetches"), checks.noindex_header())


LISTED = f"SELECT DISTINCT host, {d.normalize('loc')} AS key FROM sitemap_entries"
CRAWLED = f"SELECT host, url, state, {d.normalize('url')} AS key FROM states"
SETS = {"listed": LISTED, "crawled": CRAWLED, "states": STATE, **MADE}


def _audit(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return robots.sitemap_audit(view(spark, sf_dir, "sitemap_entries"), _states(spark, sf_dir))


@query("SELECT host, key FROM listed l WHERE NOT EXISTS (SELECT 1 FROM crawled c WHERE c.host = l.host AND c.key = l.key)", **SETS)
def j3_w9_sitemap_not_crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit(spark, sf_dir)["not_crawled"]


@query("SELECT host, key FROM crawled c WHERE state = 'indexable' AND NOT EXISTS (SELECT 1 FROM listed l WHERE c.host = l.host AND c.key = l.key)", **SETS)
def j4_not_in_sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit(spark, sf_dir)["not_in_sitemap"]


@query("SELECT host, key, state FROM listed JOIN crawled USING (host, key) WHERE state IN ('robots_blocked', 'noindex_header', 'noindex_meta')", **SETS)
def j5_sitemap_not_indexable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit(spark, sf_dir)["not_indexable"]


@query(f"SELECT host, count(*) AS entries, count(*) FILTER (NOT contains({LAST}, '.') OR regexp_matches({LAST}, '\\.html?$')) AS html_estimate FROM (SELECT host, loc AS url FROM sitemap_entries) s GROUP BY host")
def a12_sitemap_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "sitemap_entries").groupBy("host").agg(F.count("*").alias("entries"), F.count_if(urls.looks_like_html(F.col("loc"))).alias("html_estimate"))


FILES = "SELECT host, 'https://' || host || '/sitemap_index.xml' AS url, '<?xml version=\"1.0\"?><sitemapindex><sitemap><loc>https://' || host || '/a.xml</loc></sitemap><sitemap><loc>https://' || host || '/b.xml</loc></sitemap></sitemapindex>' AS body FROM robots_files UNION ALL SELECT host, 'https://' || host || '/a.xml', '<s:urlset xmlns:s=\"x\"><s:url><s:loc> https://' || host || '/p?a=1&amp;b=2 </s:loc></s:url></s:urlset>' FROM robots_files UNION ALL SELECT host, 'https://' || host || '/b.xml', '<html><loc>no</loc></html>' FROM robots_files UNION ALL SELECT host, 'https://' || host || '/c.xml', '<urlset><url><loc>x</loc>' FROM robots_files"
READ = "SELECT host, 'https://' || host || '/sitemap_index.xml' AS file, 'index' AS kind, 'https://' || host || '/a.xml' AS loc FROM robots_files UNION ALL SELECT host, 'https://' || host || '/sitemap_index.xml', 'index', 'https://' || host || '/b.xml' FROM robots_files UNION ALL SELECT host, 'https://' || host || '/a.xml', 'urlset', 'https://' || host || '/p?a=1&b=2' FROM robots_files UNION ALL SELECT host, 'https://' || host || '/b.xml', 'unknown', NULL FROM robots_files UNION ALL SELECT host, 'https://' || host || '/c.xml', 'broken', NULL FROM robots_files"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FILES.replace("FROM robots_files", "FROM {robots_files}"), robots_files=view(spark, sf_dir, "robots_files"))


@query(READ)
def r8_s4_sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robots.sitemap_urls(_files(spark, sf_dir))


@query("SELECT host, 'https://' || host || '/' || f AS file, k AS depth FROM robots_files, (VALUES ('sitemap_index.xml', 0), ('a.xml', 1), ('b.xml', 1)) AS x(f, k)")
def r9_sitemap_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = view(spark, sf_dir, "robots_files").select("host", F.concat(F.lit("https://"), "host", F.lit("/sitemap_index.xml")).alias("url"))
    return robots.sitemap_closure(_files(spark, sf_dir), roots)
