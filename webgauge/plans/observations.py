"""Queries over observations with every branch in their data: page speed, sitemap files, addresses, host variants, lengths in crawl order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, hosts, robots
from .fixtures import view
from .hosts import AS_OF
from .registry import query
from .robots import CRAWLED, MADE, STATE, _states

PSI = "SELECT *, (psi_json LIKE '{%') IS TRUE AS success, CAST(round(try_cast(json_extract_string(CASE WHEN psi_json LIKE '{%' THEN psi_json END, '$.lighthouseResult.categories.performance.score') AS DOUBLE) * 100) AS INTEGER) AS score FROM psi_obs"


def _audit(name: str) -> str:
    return f"try_cast(json_extract_string(CASE WHEN success THEN psi_json END, '$.lighthouseResult.audits.\"{name}\".numericValue') AS DOUBLE)"


@query(
    f"SELECT host, strategy, url, success, score, {_audit('first-contentful-paint')} AS fcp_ms, {_audit('largest-contentful-paint')} AS lcp_ms, {_audit('speed-index')} AS speed_index_ms, {_audit('total-blocking-time')} AS tbt_ms, {_audit('cumulative-layout-shift')} AS cls, {_audit('interaction-to-next-paint')} AS inp_ms, CASE WHEN success THEN url || '#f' END AS final_url, strategy || CASE WHEN NOT success THEN '_PSI_FAILED' WHEN score < 50 THEN '_PSI_SCORE_LOW' WHEN score < 90 THEN '_PSI_SCORE_NEEDS_IMPROVEMENT' END AS code FROM psi",
    psi=PSI,
)
def x11_pagespeed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.pagespeed_results(view(spark, sf_dir, "psi_obs"))


@query("SELECT host, strategy, count(*) AS tested, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed, avg(score) AS avg_score, coalesce(array_to_string((list(url ORDER BY score, url) FILTER (score IS NOT NULL))[1:50], ' '), '') AS worst FROM psi GROUP BY host, strategy", psi=PSI)
def a13_pagespeed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.pagespeed_report(hosts.pagespeed_results(view(spark, sf_dir, "psi_obs")))


@query("SELECT host, strategy, url FROM (SELECT host, arg_min(regexp_extract(final_url, '^(https?://[^/?#]+)', 1) || '/', seq) AS url FROM fetches WHERE status_code BETWEEN 200 AND 399 AND contains(content_type, 'html') GROUP BY host) r, (VALUES ('MOBILE'), ('DESKTOP')) AS s(strategy)")
def x11_pagespeed_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.pagespeed_targets(view(spark, sf_dir, "fetches"))


#: What each file of the fixture holds, written out by its number.
NAMED = "SELECT host, page_id % 13 <> 0 AS got, page_id % 7 AS k, url, nth FROM (SELECT host, page_id, url, row_number() OVER (PARTITION BY host ORDER BY page_id) AS nth FROM pages_ext) x"
KEYED = "SELECT host, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS key FROM named WHERE got AND k IN (3, 5, 6) UNION SELECT host, 'https://' || host || '/f.pdf' FROM named WHERE got AND k IN (5, 6)"
FILE_COUNTS = "SELECT host, count(*) FILTER (got) AS files, count(*) FILTER (NOT got) AS unfetched, count(*) FILTER (got AND k IN (2, 4)) AS broken, count(*) FILTER (got AND k = 1) AS unknown, bool_or(got AND nth = 1 AND length(host) % 2 = 0) AS has_sitemap_xml, CAST(sum(CASE WHEN NOT got THEN 0 WHEN k = 0 THEN 1 WHEN k IN (3, 5, 6) THEN 2 ELSE 0 END) AS BIGINT) AS elements, count(*) FILTER (got AND k = 3) AS bad_urls FROM named GROUP BY host"
URL_COUNTS = "SELECT host, count(*) AS urls, count(*) FILTER (NOT contains(last, '.') OR regexp_matches(last, '\\.html?$')) AS html_estimate FROM (SELECT host, lower(regexp_extract(key, '^https?://[^/]+/(?:.*/)?([^/]*)$', 1)) AS last FROM keyed) x GROUP BY host"
SET_COUNTS = "SELECT host, (SELECT count(*) FROM keyed l WHERE l.host = h.host AND NOT EXISTS (SELECT 1 FROM crawled c WHERE c.host = l.host AND c.key = l.key)) AS not_crawled, (SELECT count(*) FROM crawled c WHERE c.host = h.host AND state = 'indexable' AND NOT EXISTS (SELECT 1 FROM keyed l WHERE c.host = l.host AND c.key = l.key)) AS not_in_sitemap, (SELECT count(*) FROM keyed l JOIN crawled c USING (host, key) WHERE l.host = h.host AND state IN ('robots_blocked', 'noindex_header', 'noindex_meta')) AS not_indexable FROM (SELECT DISTINCT host FROM states) h"


@query(
    "SELECT host, files > 0 AND coalesce(urls, 0) > 0 AS found, files, elements, coalesce(urls, 0) AS urls, coalesce(html_estimate, 0) AS html_estimate, has_sitemap_xml, unfetched + broken + CASE WHEN files > 0 AND urls > 0 THEN 0 ELSE 1 END AS errors, unknown + bad_urls + CASE WHEN files > 0 AND coalesce(urls, 0) = 0 THEN 1 ELSE 0 END AS warnings, not_crawled, not_in_sitemap, not_indexable FROM file_counts LEFT JOIN url_counts USING (host) JOIN set_counts USING (host)",
    named=NAMED, keyed=KEYED, file_counts=FILE_COUNTS, url_counts=URL_COUNTS, set_counts=SET_COUNTS, crawled=CRAWLED, states=STATE, **MADE,
)
def a12_sitemap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robots.sitemap_report(view(spark, sf_dir, "sitemap_files"), _states(spark, sf_dir))


PUBLIC = "SELECT host, ip, country, row_number() OVER (PARTITION BY host ORDER BY contains(ip, ':'), ip) AS nth FROM host_ips LEFT JOIN (VALUES ('2001:db8::5', 'DE'), ('2a00:1450::12', NULL), ('198.51.100.4', 'NL'), ('203.0.113.77', 'FR'), ('172.32.0.1', NULL)) AS c(ip, country) USING (ip) WHERE ip IN ('2001:db8::5', '2a00:1450::12', '198.51.100.4', '203.0.113.77', '172.32.0.1')"


@query("SELECT h.host, CASE WHEN n IS NULL THEN 'HOST_GEO_NO_PUBLIC_IP' WHEN countries IS NULL THEN 'HOST_GEO_UNKNOWN' ELSE 'HOST_COUNTRY' END AS code, countries FROM (SELECT DISTINCT host FROM host_ips) h LEFT JOIN (SELECT host, count(*) AS n, nullif(string_agg(DISTINCT country, ',' ORDER BY country), '') AS countries FROM public_ips WHERE nth <= 3 GROUP BY host) p USING (host)", public_ips=PUBLIC)
def x9_x10_geo_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IPv4 and IPv6 addresses of all ranges; a country stands in one of four places of the answer."""
    rows = view(spark, sf_dir, "host_ips")
    answers = {"2001:db8::5": '{"entities":[{"country":"x"},{"country":"de"}]}', "2a00:1450::12": '{"entities":[]}', "198.51.100.4": '{"country":"Netherlands","countryCode":"nl"}', "203.0.113.77": '{"cc":"FR","country":""}'}
    json = F.create_map(*(F.lit(x) for kv in answers.items() for x in kv))[F.col("ip")]
    known = hosts.rdap_country(rows.select("ip").distinct().select("ip", json.alias("json")).where("json is not null"))
    return hosts.geo(rows.groupBy("host").agg(F.collect_set("ip").alias("ips")), known)


ASKED = "SELECT host, naked, CASE WHEN seq % 4 = 0 THEN host WHEN seq % 4 = 1 THEN naked WHEN seq % 4 = 2 THEN 'example.org' END AS domain, seq FROM variant_hosts"


@query("SELECT host, CASE WHEN seq % 4 = 3 THEN 'example.org' ELSE domain END AS domain, CASE WHEN seq % 4 < 2 THEN DATE '2015-02-03' END AS created, CASE WHEN seq % 4 < 2 THEN DATE '2024-02-10' ELSE DATE '2023-12-31' END AS expires, CASE WHEN seq % 4 < 2 THEN 'DOMAIN_EXPIRES_SOON' ELSE 'DOMAIN_EXPIRED' END AS code FROM asked", asked=ASKED)
def x2_rdap_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the hosts have an answer for themselves, one for the name without www., the others for their registrable domain alone."""
    names = view(spark, sf_dir, "variant_hosts")
    own = names.where("seq % 4 < 2").select(F.expr("CASE WHEN seq % 4 = 0 THEN host ELSE naked END").alias("domain"), F.lit('{"events":[{"eventAction":"registration","eventDate":"2015-02-03"},{"eventAction":"expiration","eventDate":"2024-02-10T00:00:00Z"}]}').alias("json"))
    top = names.select(F.lit("example.org").alias("domain"), F.lit('{"events":[{"eventAction":"expiration","eventDate":"2023-12-31"}]}').alias("json"))
    return hosts.rdap_by_candidates(names.select("host"), own.unionByName(top), AS_OF)


@query("SELECT host, CASE WHEN seq % 3 <> 1 AND seq % 4 <> 2 THEN 'DOMAIN_VARIANTS_OK' ELSE 'DOMAIN_VARIANTS_PROBLEM' END AS code FROM variant_hosts")
def j9_variant_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some hosts lack the step to https, some the step between the names with and without www."""
    return graph.domain_variants(view(spark, sf_dir, "variant_hosts").select("host"), view(spark, sf_dir, "variant_hops"))


@query("SELECT CASE WHEN seq % 2 = 1 THEN host WHEN host = naked THEN 'www.' || host ELSE naked END AS wanted, host, seq FROM variant_hosts")
def j13_alias_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second host is asked for by its other name."""
    rows = view(spark, sf_dir, "variant_hosts")
    wanted = rows.select(F.expr("CASE WHEN seq % 2 = 1 THEN host WHEN host = naked THEN 'www.' || host ELSE naked END").alias("host"))
    return graph.alias_host(rows.select("host", "seq"), wanted)


NUMBERED = "SELECT host, content_length, row_number() OVER (PARTITION BY host ORDER BY seq, content_length) AS n FROM length_obs WHERE content_length > 0"
LOOKS = "SELECT a.host, a.n, b.content_length, count(*) AS c FROM numbered a JOIN numbered b ON a.host = b.host AND b.n <= a.n WHERE a.n >= 50 AND a.n % 25 = 0 GROUP BY ALL"


@query("SELECT host, min(n) AS pages, arg_min(c, n) AS top_count FROM (SELECT host, n, max(c) AS c FROM looks GROUP BY host, n) x WHERE c >= 0.75 * n GROUP BY host", looks=LOOKS, numbered=NUMBERED)
def a11_uniformity_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.uniformity_alerts(view(spark, sf_dir, "length_obs"))
