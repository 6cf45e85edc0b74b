"""Queries whose data takes each branch: codes of robots files and domains, addresses of both versions, suffixes, answers without a schema, reports with figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import addresses
from ..operators import checks, documents, hosts, reports, robots, suffixes
from ..sources import shared
from . import duck as d
from .content import BANDS, HASHED, NEAR, SIMHASH, STUFFED, TOKENS
from .crawl import OUTGOING
from .fixtures import view
from .hosts import AS_OF, MATCH
from .observations import CRAWLED, MADE, PSI, STATE, _audit, _states
from .pages import HEAD, IMAGES, LINKS
from .registry import query
from .reports import META_ROWS, _list
from .robots import HOMES


def _cases(table: str, key: str, codes: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT host, '{code}' AS code FROM {table} WHERE {key} IN ({cases})" for code, cases in codes.items())


FIRSTS = "SELECT host, min(page_id) % 8 AS k, min(page_id) % 6 AS six FROM pages_ext GROUP BY host"


@query("SELECT host, code, 'Warning' AS severity FROM said", firsts=FIRSTS, said=_cases("firsts", "k", {"ROBOTS_MISSING_OR_UNAVAILABLE": "2, 3, 4, 5", "ROBOTS_MISSING": "2", "ROBOTS_HTTP_ERROR": "3", "ROBOTS_FETCH_FAILED": "4, 5", "ROBOTS_ONLY_HTTP": "1", "ROBOTS_NO_GROUP_FOR_UA": "6", "ROBOTS_BLOCKS_ALL": "1, 7"}))
def r5_robots_host_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robots.host_issues(view(spark, sf_dir, "pages_ext").select("host"), view(spark, sf_dir, "robots_fetches").drop("k"))


@query("SELECT host, CASE WHEN k = 1 THEN 'http' ELSE 'https' END AS scheme, CASE k WHEN 2 THEN 404 WHEN 3 THEN 500 WHEN 4 THEN 0 ELSE 200 END AS status_code FROM firsts WHERE k <> 5", firsts=FIRSTS)
def s5_w1_robots_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts that answer by one scheme only, by both or by none."""
    return shared.pick_robots(view(spark, sf_dir, "robots_fetches").where("k % 8 <> 4 or scheme = 'https'")).drop("body")


@query("SELECT host, CAST(0 AS BIGINT) AS line, code FROM whole UNION ALL SELECT host, CAST(CASE WHEN six = 3 AND code = 'ROBOTS_RULE_BEFORE_UA' THEN 2 ELSE 1 END AS BIGINT), code FROM own JOIN firsts USING (host)", firsts=FIRSTS, whole=_cases("firsts", "six", {"ROBOTS_NO_USER_AGENT": "0, 1, 2, 3, 5", "ROBOTS_NO_UA_LINES": "0, 1, 2, 5"}), own=_cases("firsts", "six", {"ROBOTS_RULE_BEFORE_UA": "2, 3", "ROBOTS_EMPTY_USER_AGENT": "3", "ROBOTS_BAD_SITEMAP_URL": "5"}))
def r4_robots_whole_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without agents, without rules, without anything."""
    return robots.lint(view(spark, sf_dir, "robots_texts")).withColumn("line", F.col("line").cast("bigint"))


SITE_CODES = {"SITE_INDEX_ROBOTS_FETCH_FAILED": "k IN (4, 5)", "SITE_INDEX_BLOCKED_BY_ROBOTS": "NOT allowed", "SITE_INDEX_HOMEPAGE_HTTP_ERROR": "status_code >= 400", "SITE_INDEX_HOMEPAGE_NOINDEX_HEADER": "by_header", "SITE_INDEX_HOMEPAGE_NOINDEX_META": "by_meta"}


@query(" UNION ALL ".join(f"SELECT host, '{code}' AS code FROM homes JOIN firsts USING (host) WHERE {c}" for code, c in SITE_CODES.items()), homes=HOMES, firsts=FIRSTS, **MADE)
def r7_site_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of a host stands for its homepage; some hosts' robots files couldn't be fetched."""
    states = _states(spark, sf_dir)
    facts = F.struct("allowed", "status_code", checks.noindex_header().alias("by_header"), checks.noindex_meta().alias("by_meta"))
    home = states.groupBy("host").agg(F.min_by(facts, "seq").alias("f")).select("host", "f.*")
    fetched = view(spark, sf_dir, "robots_fetches").where("scheme = 'https' and status_code > 0").select("host", F.lit(True).alias("got")).distinct()
    homes = home.join(fetched.hint("shuffle_merge"), "host", "left").withColumn("robots_fetched", F.coalesce("got", F.lit(False)))
    return robots.site_indexability(homes)


ENDS_AT = "SELECT host, min(final_url) AS final_url FROM fetches GROUP BY host"
TLS_CODES = {"HTTPS_NOT_USED": "handshake_ok AND final_url NOT LIKE 'https:%'", "HTTPS_PRESENT": "handshake_ok", "HTTPS_MISSING": "NOT handshake_ok", "SSL_EXPIRES_AT": "handshake_ok AND not_after IS NOT NULL", "SSL_DOMAIN_MATCH": f"handshake_ok AND {MATCH}", "SSL_CA_CHAIN_VALID": "handshake_ok AND chain_error IS NULL"}


@query(" UNION ALL ".join(f"SELECT host, '{code}' AS code FROM hosts_obs JOIN ends_at USING (host) WHERE {c}" for code, c in TLS_CODES.items()), ends_at=ENDS_AT)
def x4_tls_page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = view(spark, sf_dir, "fetches").groupBy("host").agg(F.min("final_url").alias("final_url"))
    return hosts.tls_summary(view(spark, sf_dir, "hosts_obs").join(ends.hint("shuffle_merge"), "host"))


def _domain(check: str, rules: dict[str, tuple[str, str] | str]) -> str:
    return d.issues("domain_obs", check, rules, "host")


@query(_domain("whois", {"WHOIS_UNAVAILABLE": "silent", "WHOIS_CREATED_UNKNOWN": ("NOT silent AND NOT with_created", "Info"), "WHOIS_EXPIRES_UNKNOWN": ("NOT silent AND end_ = 0", "Info"), "DOMAIN_EXPIRED": "NOT silent AND end_ = 1", "DOMAIN_EXPIRING_SOON": "NOT silent AND end_ = 2"}))
def x1_whois_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.whois_issues(hosts.whois(view(spark, sf_dir, "whois_obs"), AS_OF))


RDAP_RULES = {
    "DOMAIN_WHOIS_FAILED": "silent OR NOT with_created AND end_ = 0", "DOMAIN_CREATED_AT": ("NOT silent AND with_created", "Info"), "DOMAIN_CREATED_UNKNOWN": ("NOT silent AND NOT with_created AND end_ > 0", "Info"), "DOMAIN_EXPIRED": ("NOT silent AND end_ = 1", "Error"),
    "DOMAIN_EXPIRES_SOON": "NOT silent AND end_ = 2", "DOMAIN_EXPIRES_AT": ("NOT silent AND end_ = 3", "Info"), "DOMAIN_EXPIRES_UNKNOWN": "NOT silent AND with_created AND end_ = 0",
}


@query(_domain("rdap", RDAP_RULES))
def x2_rdap_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.rdap_issues(documents.rdap_dates(view(spark, sf_dir, "rdap_obs")), AS_OF)


@query("SELECT host, CASE WHEN NOT silent AND with_created THEN DATE '2019-03-04' END AS created, CASE WHEN NOT silent THEN CASE end_ WHEN 1 THEN DATE '2023-12-31' WHEN 2 THEN DATE '2024-02-01' WHEN 3 THEN DATE '2030-01-01' END END AS expires, CASE WHEN NOT silent AND page_id % 2 = 0 THEN 'NL' END AS country, CASE WHEN silent THEN NULL WHEN page_id % 7 = 0 THEN 'ARRAY<VARIANT>' ELSE 'ARRAY<OBJECT<eventAction: STRING, eventDate: STRING>>' END AS shape FROM domain_obs")
def x2_x10_rdap_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some lists of events hold a number beside them."""
    return documents.rdap_dates(view(spark, sf_dir, "rdap_obs"))


SHAPE = "CASE WHEN NOT success THEN NULL WHEN contains(psi_json, '\"score\":null') THEN 'OBJECT<score: VOID>' ELSE 'OBJECT<score: DOUBLE>' END"


@query(
    f"SELECT host, strategy, url, success, score, {_audit('first-contentful-paint')} AS fcp_ms, {_audit('largest-contentful-paint')} AS lcp_ms, {_audit('speed-index')} AS speed_index_ms, {_audit('total-blocking-time')} AS tbt_ms, {_audit('cumulative-layout-shift')} AS cls, {_audit('interaction-to-next-paint')} AS inp_ms, CASE WHEN success THEN url || '#f' END AS final_url, {SHAPE} AS shape, strategy || CASE WHEN NOT success THEN '_PSI_FAILED' WHEN score < 50 THEN '_PSI_SCORE_LOW' WHEN score < 90 THEN '_PSI_SCORE_NEEDS_IMPROVEMENT' END AS code FROM psi",
    psi=PSI,
)
def x11_pagespeed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.pagespeed_results(view(spark, sf_dir, "psi_obs"))


#: Labels of each host from its end, and the ending that a rule's kind asks for, written out by cases.
ENDINGS = "SELECT host, labels, n, array_to_string(labels[-n:], '.') AS ending, CASE WHEN n > 1 THEN array_to_string(labels[-n + 1:], '.') END AS parent FROM (SELECT host, string_split(host, '.') AS labels, unnest(range(1, len(string_split(host, '.')) + 1)) AS n FROM suffix_hosts) x"
SUFFIX_N = "SELECT host, any_value(labels) AS labels, coalesce(max(n - 1) FILTER ('!' || ending IN (SELECT rule FROM suffix_rules)), max(n) FILTER (ending IN (SELECT rule FROM suffix_rules) OR '*.' || parent IN (SELECT rule FROM suffix_rules)), 1) AS k FROM endings GROUP BY host"


@query("SELECT host, array_to_string(labels[-k:], '.') AS suffix, CASE WHEN len(labels) > k THEN array_to_string(labels[-k - 1:], '.') END AS domain FROM suffix_n", endings=ENDINGS, suffix_n=SUFFIX_N)
def u12_suffix_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.registrable_domains(view(spark, sf_dir, "suffix_hosts"), view(spark, sf_dir, "suffix_rules"))


#: The addresses of the view, by hand in full length.
NIBBLES = {
    "fe80::1": "fe800000000000000000000000000001", "fd12:3456::9": "fd123456000000000000000000000009", "::1": "00000000000000000000000000000001", "ff02::1": "ff020000000000000000000000000001", "2001:0:53aa::1": "2001000053aa00000000000000000001",
    "2001:db8::5": "20010db8000000000000000000000005", "2a00:1450::12": "2a001450000000000000000000000012", "10.0.0.7": "00000000000000000000ffff0a000007", "172.31.4.4": "00000000000000000000ffffac1f0404", "224.0.0.1": "00000000000000000000ffffe0000001",
    "198.51.100.4": "00000000000000000000ffffc6336404", "203.0.113.77": "00000000000000000000ffffcb00714d", "172.32.0.1": "00000000000000000000ffffac200001",
}
WRITTEN = "SELECT * FROM (VALUES " + ", ".join(f"('{ip}', '{n}')" for ip, n in NIBBLES.items()) + ") AS w(ip, nibbles)"
NAME = "CASE WHEN contains(ip, ':') THEN array_to_string(string_split(reverse(nibbles), ''), '.') ELSE split_part(ip, '.', 4) || '.' || split_part(ip, '.', 3) || '.' || split_part(ip, '.', 2) || '.' || split_part(ip, '.', 1) END"


@query(f"SELECT host, ip, nibbles, {NAME} || '.rbl.example' AS query_name FROM host_ips JOIN written USING (ip)", written=WRITTEN)
def j11_lookup_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "host_ips").select("host", "ip", addresses.nibbles(F.col("ip")).alias("nibbles"), addresses.lookup_name(F.col("ip"), F.lit("rbl.example")).alias("query_name"))


LISTED_IPS = ("2001:db8::5", "203.0.113.77", "fe80::1")


@query(f"SELECT host, CASE WHEN n = 0 THEN 'RBL_NO_IP' WHEN listed > 0 THEN 'HOSTING_RBL_LISTED' ELSE 'HOSTING_RBL_CLEAN' END AS code, n AS ips, listed FROM (SELECT h.host, count(ip) AS n, count(*) FILTER (ip IN {LISTED_IPS}) AS listed FROM (SELECT DISTINCT host FROM pages_ext) h LEFT JOIN (SELECT * FROM host_ips WHERE length(host) % 5 <> 0) i USING (host) GROUP BY h.host) x")
def j11_addresses_blocklisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IPv6 in other spellings than the blocklist's; hosts without addresses."""
    full = F.when(F.col("ip").contains(":"), F.upper(F.regexp_replace(addresses.nibbles(F.col("ip")), "(.{4})(?=.)", "$1:"))).otherwise(F.col("ip"))
    ips = view(spark, sf_dir, "host_ips").where("length(host) % 5 <> 0").groupBy("host").agg(F.array_union(F.collect_set("ip"), F.collect_set(full)).alias("ips"))
    obs = view(spark, sf_dir, "pages_ext").select("host").distinct().join(ips.hint("shuffle_merge"), "host", "left")
    listed = view(spark, sf_dir, "host_ips").where(F.col("ip").isin(*LISTED_IPS)).select(addresses.lookup_name(F.col("ip"), F.lit("b.example")).alias("query_name"))
    return hosts.addresses_blocklisted(obs, ["a.example", "b.example"], listed)


RANGES = [("2001:db8::/32", "DE"), ("2001:db8::5/128", "FR"), ("2a00::/12", "NL"), ("203.0.113.0/24", "US"), ("203.0.113.64/26", "BE"), ("198.51.0.0/16", "GB"), ("fe80::/10", "ZZ"), ("no network", "XX"), ("172.32.0.0/12", "IT"), ("172.32.0.0/12", "JP")]
IN_RANGE = {"2001:db8::5": "FR", "2a00:1450::12": "NL", "203.0.113.77": "BE", "198.51.100.4": "GB", "fe80::1": "ZZ", "172.32.0.1": "IT"}


@query("SELECT DISTINCT ip, " + "CASE ip " + " ".join(f"WHEN '{ip}' THEN '{c}'" for ip, c in IN_RANGE.items()) + " END AS country FROM host_ips")
def x9_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses.in_networks(view(spark, sf_dir, "host_ips"), spark.createDataFrame(RANGES, "cidr string, country string"), "country")


@query(f"SELECT host, code, NULL AS record FROM (SELECT host, CASE WHEN silent THEN 'WHOIS_UNAVAILABLE' WHEN end_ = 0 THEN 'WHOIS_EXPIRES_UNKNOWN' WHEN end_ = 1 THEN 'DOMAIN_EXPIRED' WHEN end_ = 2 THEN 'DOMAIN_EXPIRING_SOON' WHEN NOT with_created THEN 'WHOIS_CREATED_UNKNOWN' END AS code FROM domain_obs WHERE page_id % 5 > 1) x UNION ALL SELECT NULL, 'OBSERVATION_UNREADABLE', CASE WHEN page_id % 5 = 0 THEN 'cut {{\"host\":\"' || host ELSE '{{\"host\":{{\"name\":1}},\"whois_raw\":[' || page_id || ']' END FROM domain_obs WHERE page_id % 5 <= 1".replace("{{", "{").replace("}}", "}"))
def s6_observation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of WHOIS answers as JSON lines, of which two in five can't be read: they stay, as their text."""
    obs = view(spark, sf_dir, "whois_obs")
    bad = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit('cut {"host":"'), "host")).when(F.col("page_id") % 5 == 1, F.concat(F.lit('{"host":{"name":1},"whois_raw":['), F.col("page_id").cast("string"), F.lit("]")))
    path = shared.new_path(spark)
    obs.select(F.coalesce(bad, F.to_json(F.struct("host", "whois_raw"))).alias("value")).write.text(path)
    good, unread = shared.split_bad(shared.read_observations(spark, path, "host string, whois_raw string"))
    told = hosts.whois(good, AS_OF).select("host", "code", F.lit(None).cast("string").alias("record"))
    return told.unionByName(unread.select(F.lit(None).cast("string").alias("host"), F.lit("OBSERVATION_UNREADABLE").alias("code"), "record"))


def _worst(rows: str, kind: str, where: str, order: str, figures: str, n: int = 200) -> str:
    return f"SELECT host, '{kind}' AS kind, CAST(row_number() OVER (PARTITION BY host ORDER BY {order}) AS INTEGER) AS nth, url, {figures} FROM {rows} WHERE {where} QUALIFY nth <= {n}"


LONG_FIGURES = "CAST(images AS INTEGER) AS images, CAST(empty_alt AS INTEGER) AS empty_alt, CAST(empty_title AS INTEGER) AS empty_title"


@query(" UNION ALL ".join(_worst("meta_rows", k, f"{k} > 0", f"{k} DESC, url", LONG_FIGURES) for k in ("empty_alt", "empty_title")), meta_rows=META_ROWS, raw_images=IMAGES)
def a5_image_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.image_pages(view(spark, sf_dir, "pages_ext"))


OUT_ROWS = "SELECT p.host, p.url, CAST(internal AS INTEGER) AS internal, CAST(external AS INTEGER) AS external FROM outgoing JOIN pages_ext p USING (page_id)"


@query(" UNION ALL ".join(_worst("out_rows", k, c, o, "internal, external") for k, c, o in (("no_internal", "internal = 0", "url"), ("many_internal", "internal > 5", "internal DESC, url"), ("any_external", "external > 0", "external DESC, url"))), out_rows=OUT_ROWS, outgoing=OUTGOING, raw_links=LINKS)
def a8_outgoing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bound of five internal links, so that pages go over it."""
    return reports.outgoing_pages(view(spark, sf_dir, "pages_ext"), many=5)


@query(_worst("(SELECT host, original_url AS url, load_seconds FROM fetches) f", "slow", "load_seconds IS NOT NULL", "load_seconds DESC, url", "load_seconds"))
def a9_slow_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.slow_pages(view(spark, sf_dir, "fetches"))


SAMPLED = (
    "SELECT host, 'not_crawled' AS kind, key AS url, NULL AS state FROM listed l WHERE NOT EXISTS (SELECT 1 FROM crawled c WHERE c.host = l.host AND c.key = l.key) UNION SELECT host, 'not_in_sitemap', key, NULL FROM crawled c WHERE state = 'indexable' AND NOT EXISTS (SELECT 1 FROM listed l WHERE c.host = l.host AND c.key = l.key) "
    "UNION SELECT host, 'not_indexable', key, state FROM listed JOIN crawled USING (host, key) WHERE state IN ('robots_blocked', 'noindex_header', 'noindex_meta')"
)
LISTED = f"SELECT DISTINCT host, {d.normalize('loc')} AS key FROM sitemap_entries"


@query("SELECT host, kind, CAST(row_number() OVER (PARTITION BY host, kind ORDER BY url, state) AS INTEGER) AS nth, url, state FROM sampled QUALIFY nth <= 3", sampled=SAMPLED, listed=LISTED, crawled=CRAWLED, states=STATE, **MADE)
def a12_sitemap_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robots.sitemap_samples(view(spark, sf_dir, "sitemap_entries"), _states(spark, sf_dir), 3)


CONTENT_DOCS = "SELECT source AS host, doc_id AS seq, CAST(doc_id AS VARCHAR) AS url, coalesce(text, '') AS text, length(coalesce(text, '')) * (doc_id % 30 + 1) AS html_chars FROM documents"
THIN_DOCS = "SELECT host, url FROM content_docs WHERE length(text) < 600 OR len(regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]{2,}')) < 120 OR length(text) / greatest(html_chars, 1) < 0.05"
STUFFED_DOCS = "SELECT host, url FROM content_docs JOIN stuffed USING (seq)"
EQUAL_DOCS = f"SELECT host, upper(sha256(key)) AS hash, count(*) AS n FROM (SELECT host, {d.fold('text')} AS key FROM content_docs) k WHERE key <> '' GROUP BY host, key HAVING count(*) >= 2"
NEAR_DOCS = "SELECT host, CAST(seq AS VARCHAR) AS url, CAST(other AS VARCHAR) AS other_url, distance FROM near"


@query(
    f"SELECT h.host, h.pages, coalesce(t.n, 0) AS thin, coalesce(s.n, 0) AS stuffed, coalesce(e.n, 0) AS exact_groups, coalesce(p.n, 0) AS near_pairs, coalesce(thin_urls, '') AS thin_urls, coalesce(stuffed_urls, '') AS stuffed_urls, coalesce(largest_groups, '') AS largest_groups, coalesce(nearest_pairs, '') AS nearest_pairs FROM (SELECT host, count(*) AS pages FROM content_docs GROUP BY host) h "
    f"LEFT JOIN (SELECT host, count(*) AS n, {_list('url', 'url', 50)} AS thin_urls FROM thin_docs GROUP BY host) t USING (host) LEFT JOIN (SELECT host, count(*) AS n, {_list('url', 'url', 50)} AS stuffed_urls FROM stuffed_docs GROUP BY host) s USING (host) "
    f"LEFT JOIN (SELECT host, count(*) AS n, {_list('hash || chr(61) || n', 'n DESC, hash', 200)} AS largest_groups FROM equal_docs GROUP BY host) e USING (host) LEFT JOIN (SELECT host, count(*) AS n, {_list('url || chr(126) || other_url || chr(61) || distance', 'distance, url, other_url', 500)} AS nearest_pairs FROM near_docs GROUP BY host) p USING (host)",
    content_docs=CONTENT_DOCS, thin_docs=THIN_DOCS, stuffed_docs=STUFFED_DOCS, equal_docs=EQUAL_DOCS, near_docs=NEAR_DOCS, tokens=TOKENS, hashed=HASHED, simhashes=SIMHASH, bands=BANDS, near=NEAR, stuffed=STUFFED,
)
def a1_content_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = view(spark, sf_dir, "documents").select(F.col("source").alias("host"), F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("url"), text.alias("text"), (F.length(text) * (F.col("doc_id") % 30 + 1)).alias("html_chars"))
    return reports.content_report(docs)
