"""Queries over host observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import hosts
from . import duck as d
from .fixtures import view
from .registry import query

AS_OF = "2024-01-15"
MATCH = "(san = host OR san LIKE '*.%' AND ends_with(host, substr(san, 2)) AND length(host) > length(san) - 1)"


def _union(facts: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT host, '{code}' AS code FROM {facts} WHERE {c}" for code, c in rules.items())


@query(_union("hosts_obs", {"TLS_HANDSHAKE_FAILED": "NOT handshake_ok", "SSL_EXPIRED": f"handshake_ok AND not_after < DATE '{AS_OF}'", "SSL_EXPIRING_SOON": f"handshake_ok AND not_after BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 30", "SSL_SELF_SIGNED": "handshake_ok AND issuer = subject", "SSL_DOMAIN_MISMATCH": f"handshake_ok AND NOT {MATCH}", "SSL_CA_CHAIN_INVALID": "handshake_ok AND chain_error IS NOT NULL"}))
def x3_x5_x6_tls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.tls(view(spark, sf_dir, "hosts_obs"), AS_OF)


@query(_union("hosts_obs", {"HTTPS_PRESENT": "handshake_ok", "HTTPS_MISSING": "NOT handshake_ok", "SSL_EXPIRES_AT": "handshake_ok AND not_after IS NOT NULL", "SSL_DOMAIN_MATCH": f"handshake_ok AND {MATCH}", "SSL_CA_CHAIN_VALID": "handshake_ok AND chain_error IS NULL"}))
def x4_tls_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.tls_summary(view(spark, sf_dir, "hosts_obs"))


WHOIS = f"SELECT *, date_diff('day', created, DATE '{AS_OF}') AS age_days, date_diff('day', DATE '{AS_OF}', expires) AS days_left FROM (SELECT host, CAST(regexp_extract(whois_raw, 'created: (\\S+)', 1) AS DATE) AS created, CAST(substr(regexp_extract(whois_raw, 'paid-till: (\\S+)', 1), 1, 10) AS DATE) AS expires FROM hosts_obs) w"


@query("SELECT host, created, expires, CAST(age_days AS INTEGER) AS age_days, CAST(days_left AS INTEGER) AS days_left, CASE WHEN days_left < 0 THEN 'DOMAIN_EXPIRED' WHEN days_left <= 30 THEN 'DOMAIN_EXPIRING_SOON' END AS code FROM whois", whois=WHOIS)
def x1_a14_whois(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.whois(view(spark, sf_dir, "hosts_obs"), AS_OF)


@query(f"SELECT host, created, expires, CASE WHEN days_left < 0 THEN 'DOMAIN_EXPIRED' WHEN days_left <= 30 THEN 'DOMAIN_EXPIRES_SOON' ELSE 'DOMAIN_EXPIRES_AT' END AS code FROM whois", whois=WHOIS)
def x2_rdap(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda p: F.regexp_extract("whois_raw", p, 1)
    made = view(spark, sf_dir, "hosts_obs").select("host", F.to_json(F.struct(F.array(F.struct(F.lit("registration").alias("eventAction"), at(r"created: (\S+)").alias("eventDate")), F.struct(F.lit("expiration").alias("eventAction"), at(r"paid-till: (\S+)").alias("eventDate"))).alias("events"))).alias("json"))
    return hosts.rdap(made, AS_OF)


@query("SELECT host, CASE WHEN ip LIKE '10.%' THEN 'HOST_GEO_NO_PUBLIC_IP' WHEN length(host) % 2 = 0 THEN 'HOST_GEO_UNKNOWN' ELSE 'HOST_COUNTRY' END AS code, CASE WHEN ip NOT LIKE '10.%' AND length(host) % 2 = 1 THEN 'NL' END AS countries FROM hosts_obs")
def x9_x10_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = view(spark, sf_dir, "hosts_obs").withColumn("ips", F.array("ip"))
    known = hosts.rdap_country(obs.where("length(host) % 2 = 1").select("ip", F.lit('{"entities":[{"country":"nl"}]}').alias("json")).distinct())
    return hosts.geo(obs, known)


@query("SELECT host, CASE WHEN length(host) % 4 = 1 AND ip LIKE '203.%' THEN 'HOSTING_RBL_LISTED' ELSE 'HOSTING_RBL_CLEAN' END AS code FROM hosts_obs")
def j11_ip_blocklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = view(spark, sf_dir, "hosts_obs").withColumn("ips", F.array("ip"))
    listed = obs.where("length(host) % 4 = 1 and ip like '203.%'").select(hosts.reversed_key(F.col("ip"), F.lit("rbl.example")).alias("query_name"))
    return hosts.ip_blocklisted(obs, ["rbl.example"], listed)


@query("SELECT host, 'HOST_IPS' AS code, ip AS shown FROM hosts_obs UNION ALL SELECT host, CASE WHEN length(host) % 6 = 0 THEN 'DNS_NS_LOOKUP_FAILED' ELSE 'HOST_NS' END, CASE WHEN length(host) % 6 = 0 THEN '' ELSE 'ns1.' || host END FROM hosts_obs")
def x7_dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.dns(view(spark, sf_dir, "hosts_obs").select("host", F.array("ip").alias("ips"), F.col("handshake_ok").alias("ns_ok"), F.array(F.concat(F.lit("ns1."), "host")).alias("ns")))


@query("SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS zone FROM hosts_obs")
def x8_ns_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = view(spark, sf_dir, "hosts_obs").select("host")
    return hosts.ns_zone(h, h.select(urls.root2(F.col("host")).alias("zone")).distinct())


@query("SELECT host, CAST(length(host) % 10 * 10 AS INTEGER) AS score, length(host) * 100.0::DOUBLE AS speed_index, CASE WHEN length(host) % 10 < 5 THEN 'MOBILE_PSI_SCORE_LOW' WHEN length(host) % 10 < 9 THEN 'MOBILE_PSI_SCORE_NEEDS_IMPROVEMENT' END AS code FROM hosts_obs")
def x11_pagespeed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.pagespeed(view(spark, sf_dir, "hosts_obs"))


@query("SELECT count(*) AS tested, count(*) AS succeeded, avg(length(host) % 10 * 10) AS avg_score FROM hosts_obs")
def a13_pagespeed_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = hosts.pagespeed(view(spark, sf_dir, "hosts_obs"))
    return p.agg(F.count("*").alias("tested"), F.count("score").alias("succeeded"), F.avg("score").alias("avg_score"))


@query(f"SELECT host, bool_or(starts_with(final_url, 'https://')) AS https, count(DISTINCT regexp_replace({d.normalize('final_url', force_https=True)}, '^https://(www\\.)?', '')) <= 1 AS consistent, (list(final_url ORDER BY CASE WHEN starts_with(final_url, 'https://www.') THEN 1 WHEN starts_with(final_url, 'https://') THEN 0 ELSE 2 END, final_url))[1] AS canonical FROM fetches GROUP BY host")
def j10_host_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.host_audit(view(spark, sf_dir, "fetches").select("host", "final_url", F.lit(True).alias("ok")))
