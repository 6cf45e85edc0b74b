"""Host observations: TLS, DNS, WHOIS, RDAP, page speed, blocklists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import addresses
from ..functions.urls import registrable_domain

#: What creation and expiry lines begin with, and the date formats that registries use.
CREATED = ["Creation Date", "Created", "Created On", "Registered On", "Registration Time", "Domain Registration Date", "created:", "created on", "created-date"]
EXPIRES = ["Registry Expiry Date", "Registrar Registration Expiration Date", "Expiration Date", "Expires On", "Expiry Date", "paid-till", "paid till", "expire:", "expires:"]
FORMATS = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy.MM.dd", "dd.MM.yyyy", "dd-MMM-yyyy", "yyyy/MM/dd"]
#: Prefixes of chain errors that make a chain invalid.
CHAIN_ERRORS = r"^(UntrustedRoot|PartialChain|NotSignatureValid|CtlNotTimeValid|RevocationStatusUnknown|Revoked)"


def codes(rows: DataFrame, rules: list[tuple[Column, str]], *keys: str) -> DataFrame:
    return rows.select(*keys, F.explode(F.filter(F.array(*(F.when(c, F.lit(code)) for c, code in rules)), lambda c: c.isNotNull())).alias("code"))


def cert_matches(host: Column, names: Column) -> Column:
    """A name is the host, or a wildcard over one label or more."""
    h = F.lower(host)
    return F.exists(names, lambda n: (F.lower(n) == h) | (n.startswith("*.") & h.endswith(F.lower(F.substr(n, F.lit(2)))) & (F.length(h) > F.length(n) - 1)))


def tls(observations: DataFrame, as_of: str, soon: int = 30) -> DataFrame:
    """(host, code) of observations(host, handshake_ok, not_after, issuer, subject, san, chain_error)."""
    ok = F.col("handshake_ok")
    left = F.datediff("not_after", F.lit(as_of).cast("date"))
    name = F.array(F.coalesce("san", F.regexp_replace("subject", "^CN=", "")))
    return codes(observations, [
        (~ok, "TLS_HANDSHAKE_FAILED"), (ok & F.col("not_after").isNull(), "SSL_NO_EXPIRY"), (ok & (left < 0), "SSL_EXPIRED"), (ok & left.between(0, soon), "SSL_EXPIRING_SOON"),
        (ok & (F.col("issuer") == F.col("subject")), "SSL_SELF_SIGNED"), (ok & ~cert_matches(F.col("host"), name), "SSL_DOMAIN_MISMATCH"), (ok & F.coalesce(F.col("chain_error").rlike(CHAIN_ERRORS), F.lit(False)), "SSL_CA_CHAIN_INVALID"),
    ], "host")


def tls_summary(observations: DataFrame) -> DataFrame:
    """(host, code); with `final_url` also HTTPS_NOT_USED where a host has https and a page of it ended elsewhere."""
    ok = F.col("handshake_ok")
    name = F.array(F.coalesce("san", F.regexp_replace("subject", "^CN=", "")))
    unused = [(ok & ~F.col("final_url").rlike("(?i)^https:"), "HTTPS_NOT_USED")] if "final_url" in observations.columns else []
    return codes(observations, [*unused, (ok, "HTTPS_PRESENT"), (~ok, "HTTPS_MISSING"), (ok & F.col("not_after").isNotNull(), "SSL_EXPIRES_AT"), (ok & F.col("not_after").isNull(), "SSL_EXPIRES_UNKNOWN"), (ok & cert_matches(F.col("host"), name), "SSL_DOMAIN_MATCH"), (ok & ~F.coalesce(F.col("chain_error").rlike(CHAIN_ERRORS), F.lit(False)), "SSL_CA_CHAIN_VALID")], "host")


def parse_date(value: Column) -> Column:
    return F.coalesce(*(F.try_to_timestamp(value, F.lit(f)) for f in FORMATS)).cast("date")


def whois(observations: DataFrame, as_of: str, soon: int = 30) -> DataFrame:
    """(host, created, expires, age_days, days_left, code): the first line that begins with a creation or expiry key, whatever its case, and
    has a date decides each.  The date stands after the line's colon, or after the key where there's none."""
    rows = F.transform(F.split("whois_raw", "\n"), lambda s: F.trim(F.translate(s, "\r\t", "  ")))

    def first(keys: list[str]) -> Column:
        key = f"(?i)^(?:{'|'.join(keys)})"
        value = lambda s: F.trim(F.when(s.rlike("^[^:]*:."), F.regexp_extract(s, "^[^:]*:(.*)$", 1)).otherwise(F.regexp_replace(s, key, "")))
        dates = F.transform(F.filter(rows, lambda s: s.rlike(key)), lambda s: parse_date(value(s)))
        return F.get(F.filter(dates, lambda d: d.isNotNull()), F.lit(0))

    now = F.lit(as_of).cast("date")
    out = observations.select("host", "whois_raw", first(CREATED).alias("created"), first(EXPIRES).alias("expires")).withColumn("age_days", F.datediff(now, "created")).withColumn("days_left", F.datediff("expires", now))
    code = F.when(F.coalesce(F.trim("whois_raw"), F.lit("")) == "", "WHOIS_UNAVAILABLE").when(F.col("expires").isNull(), "WHOIS_EXPIRES_UNKNOWN").when(F.col("days_left") < 0, "DOMAIN_EXPIRED").when(F.col("days_left") <= soon, "DOMAIN_EXPIRING_SOON").when(F.col("created").isNull(), "WHOIS_CREATED_UNKNOWN")
    return out.withColumn("code", code).drop("whois_raw")


def whois_issues(dates: DataFrame, soon: int = 30) -> DataFrame:
    """(host, check, code, severity): all that holds of whois(); where there was no answer, only that."""
    got, left = F.col("code").isNull() | (F.col("code") != "WHOIS_UNAVAILABLE"), F.col("days_left")
    rules = {
        "WHOIS_UNAVAILABLE": ~got, "WHOIS_CREATED_UNKNOWN": (got & F.col("created").isNull(), "Info"), "WHOIS_EXPIRES_UNKNOWN": (got & F.col("expires").isNull(), "Info"),
        "DOMAIN_EXPIRED": got & (left < 0), "DOMAIN_EXPIRING_SOON": got & left.between(0, soon),
    }
    from .checks import issues

    return issues(dates, "whois", rules, "host")


def rdap_issues(dates: DataFrame, as_of: str, soon: int = 30) -> DataFrame:
    """(host, check, code, severity): all that holds of rdap(); where no date is known, only that."""
    left, got = F.datediff("expires", F.lit(as_of).cast("date")), F.col("created").isNotNull() | F.col("expires").isNotNull()
    rules = {
        "DOMAIN_WHOIS_FAILED": ~got, "DOMAIN_CREATED_AT": (F.col("created").isNotNull(), "Info"), "DOMAIN_CREATED_UNKNOWN": (got & F.col("created").isNull(), "Info"), "DOMAIN_EXPIRED": (left < 0, "Error"),
        "DOMAIN_EXPIRES_SOON": left.between(0, soon), "DOMAIN_EXPIRES_AT": (left > soon, "Info"), "DOMAIN_EXPIRES_UNKNOWN": got & F.col("expires").isNull(),
    }
    from .checks import issues

    return issues(dates, "rdap", rules, "host")


def rdap(domains: DataFrame, as_of: str, soon: int = 30) -> DataFrame:
    """(host, created, expires, code) of domains(host, json)."""
    events = F.from_json("json", "struct<events:array<struct<eventAction:string,eventDate:string>>>")["events"]
    first = lambda action: parse_date(F.get(F.filter(events, lambda e: F.lower(e["eventAction"]) == action), F.lit(0))["eventDate"])
    out = domains.select("host", first("registration").alias("created"), first("expiration").alias("expires"))
    left = F.datediff("expires", F.lit(as_of).cast("date"))
    return out.withColumn("code", F.when(F.col("created").isNull() & F.col("expires").isNull(), "DOMAIN_WHOIS_FAILED").when(F.col("expires").isNull(), "DOMAIN_EXPIRES_UNKNOWN").when(left < 0, "DOMAIN_EXPIRED").when(left <= soon, "DOMAIN_EXPIRES_SOON").otherwise("DOMAIN_EXPIRES_AT"))


def rdap_candidates(names: DataFrame) -> DataFrame:
    """(host, domain, nth): what to ask for a host, in order: itself, without www., its registrable domain."""
    asked = F.array_distinct(F.array("host", F.regexp_replace("host", r"^www\.", ""), registrable_domain(F.col("host"))))
    return names.select("host", F.posexplode(asked).alias("nth", "domain"))


def rdap_by_candidates(names: DataFrame, answers: DataFrame, as_of: str, soon: int = 30) -> DataFrame:
    """rdap() of the first candidate that has an answer in answers(domain, json), with that domain; hosts without any stay and have failed."""
    known = answers.where("json is not null").groupBy("domain").agg(F.min("json").alias("json"))
    first = rdap_candidates(names).join(known.hint("shuffle_merge"), "domain").groupBy("host").agg(F.min_by(F.struct("domain", "json"), "nth").alias("a"))
    got = names.select("host").distinct().join(first.hint("shuffle_merge"), "host", "left").select("host", "a.domain", "a.json")
    return rdap(got.select("host", "json"), as_of, soon).join(got.select("host", "domain").hint("shuffle_merge"), "host")


def rdap_country(ips: DataFrame) -> DataFrame:
    """(ip, country): the first two-letter code of country, countryCode, cc, or of the entities in their order."""
    r = F.from_json("json", "struct<country:string,countryCode:string,cc:string,entities:array<struct<country:string>>>")
    codes_ = F.concat(F.array(r["country"], r["countryCode"], r["cc"]), F.coalesce(r["entities"]["country"], F.array().cast("array<string>")))
    return ips.select("ip", F.upper(F.get(F.filter(codes_, lambda c: F.length(c) == 2), F.lit(0))).alias("country"))


def public_ip(ip: Column) -> Column:
    """Neither private, loopback, link-local, multicast nor reserved; an IPv6 address neither site-local, unique local nor Teredo either."""
    v4 = ip.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") & ~ip.rlike(r"^(10|127)\.|^169\.254\.|^192\.168\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^22[4-9]\.|^2[3-5][0-9]\.")
    v6 = ip.rlike(r"(?i)^[0-9a-f:.]*:[0-9a-f:.]*$") & ~ip.rlike(r"(?i)^[0:]*:0*1$|^fe[89a-f][0-9a-f]:|^ff[0-9a-f]{2}:|^f[cd][0-9a-f]{2}:|^2001:0{0,4}:")
    return v4 | v6


def geo(observations: DataFrame, ip_country: DataFrame) -> DataFrame:
    """(host, code, countries): where a host's public addresses are, three at most, IPv4 first."""
    ranked = F.array_sort(F.array_distinct(F.transform(F.filter("ips", public_ip), lambda ip: F.struct(ip.contains(":").alias("v6"), F.lower(ip).alias("ip")))))
    ips = observations.select("host", F.transform(F.slice(ranked, 1, 3), lambda s: s["ip"]).alias("ips"))
    found = ips.select("host", F.explode("ips").alias("ip")).join(ip_country.hint("shuffle_hash"), "ip").groupBy("host").agg(F.array_join(F.array_sort(F.collect_set("country")), ",").alias("countries"))
    return ips.join(found.hint("shuffle_merge"), "host", "left").select("host", F.when(F.size("ips") == 0, "HOST_GEO_NO_PUBLIC_IP").when(F.coalesce("countries", F.lit("")) == "", "HOST_GEO_UNKNOWN").otherwise("HOST_COUNTRY").alias("code"), F.nullif("countries", F.lit("")).alias("countries"))


def reversed_key(ip: Column, zone: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(ip, r"\.")), "."), F.lit("."), zone)


def addresses_blocklisted(observations: DataFrame, zones: list[str], blocklist: DataFrame) -> DataFrame:
    """(host, code, ips, listed) of observations(host, ips), IPv4 and IPv6, against blocklist(query_name); listed: addresses that a zone names.  What is no address isn't
    asked for.  A host without addresses has RBL_NO_IP; without zones nothing is asked.  Repeated addresses in any spelling count once."""
    if not zones:
        return observations.select("host", F.lit("HOSTING_RBL_DISABLED").alias("code"), F.lit(0).cast("bigint").alias("ips"), F.lit(0).cast("bigint").alias("listed"))
    ips = observations.select("host", F.explode_outer("ips").alias("ip")).select("host", "ip", addresses.nibbles(F.col("ip")).alias("n")).dropDuplicates(["host", "n"])
    asked = ips.select("host", "n", F.explode(F.array(*(addresses.lookup_name(F.col("ip"), F.lit(z)) for z in zones))).alias("query_name"))
    hit = asked.join(blocklist.select("query_name", F.lit(True).alias("hit")).distinct().hint("shuffle_merge"), "query_name", "left").groupBy("host", "n").agg(F.bool_or("hit").alias("hit"))
    per = hit.groupBy("host").agg(F.count("n").alias("ips"), F.count_if(F.coalesce("hit", F.lit(False))).alias("listed"))
    return per.select("host", F.when(F.col("ips") == 0, "RBL_NO_IP").when(F.col("listed") > 0, "HOSTING_RBL_LISTED").otherwise("HOSTING_RBL_CLEAN").alias("code"), "ips", "listed")


def ip_blocklisted(observations: DataFrame, zones: list[str], blocklist: DataFrame) -> DataFrame:
    """(host, code) of observations(host, ips) against blocklist(query_name)."""
    if not zones:
        return observations.select("host", F.lit("HOSTING_RBL_DISABLED").alias("code"))
    asked = observations.select("host", F.explode_outer("ips").alias("ip")).select("host", "ip", F.explode(F.array(*map(F.lit, zones))).alias("zone"))
    hit = asked.withColumn("query_name", reversed_key(F.col("ip"), F.col("zone"))).join(blocklist.select("query_name", F.lit(1).alias("hit")).distinct().hint("shuffle_hash"), "query_name", "left")
    per = hit.groupBy("host").agg(F.count("ip").alias("ips"), F.count("hit").alias("hits"))
    return per.select("host", F.when(F.col("ips") == 0, "RBL_NO_IP").when(F.col("hits") > 0, "HOSTING_RBL_LISTED").otherwise("HOSTING_RBL_CLEAN").alias("code"))


def dns(observations: DataFrame) -> DataFrame:
    """(host, code, shown) of observations(host, ips, ns_ok, ns): ten names shown, the rest counted."""
    shown = lambda a: F.concat(F.array_join(F.slice(a, 1, 10), ","), F.when(F.size(a) > 10, F.concat(F.lit(" +"), (F.size(a) - 10).cast("string"))).otherwise(""))
    ip = F.when(F.size("ips") > 0, F.struct(F.lit("HOST_IPS").alias("code"), shown("ips").alias("shown"))).otherwise(F.struct(F.lit("DNS_NO_A_AAAA").alias("code"), F.lit("").alias("shown")))
    ns = F.when(~F.col("ns_ok"), F.struct(F.lit("DNS_NS_LOOKUP_FAILED").alias("code"), F.lit("").alias("shown"))).when(F.size("ns") > 0, F.struct(F.lit("HOST_NS").alias("code"), shown("ns").alias("shown"))).otherwise(F.struct(F.lit("DNS_NO_NS").alias("code"), F.lit("").alias("shown")))
    return observations.select("host", F.explode(F.array(ip, ns)).alias("x")).select("host", "x.*")


def ns_zone(hosts: DataFrame, records: DataFrame, steps: int = 6) -> DataFrame:
    """(host, zone): the nearest zone above a host that has name servers."""
    labels = F.split("host", r"\.")
    up = hosts.select("host", F.posexplode(F.transform(F.sequence(F.lit(1), F.least(F.size(labels) - 1, F.lit(steps))), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))).alias("step", "zone"))
    return up.join(records.select("zone").hint("shuffle_merge"), "zone").groupBy("host").agg(F.min_by("zone", "step").alias("zone"))


def pagespeed(observations: DataFrame, strategy: str = "MOBILE") -> DataFrame:
    """(host, score, speed_index, code) of observations(host, psi_json)."""
    ddl = "struct<lighthouseResult:struct<finalUrl:string,categories:struct<performance:struct<score:double>>,audits:map<string,struct<numericValue:double>>>>"
    r = F.from_json("psi_json", ddl)["lighthouseResult"]
    out = observations.select("host", F.round(r["categories"]["performance"]["score"] * 100).cast("int").alias("score"), r["audits"]["speed-index"]["numericValue"].alias("speed_index"))
    return out.withColumn("code", F.when(F.col("score").isNull(), f"{strategy}_PSI_FAILED").when(F.col("score") < 50, f"{strategy}_PSI_SCORE_LOW").when(F.col("score") < 90, f"{strategy}_PSI_SCORE_NEEDS_IMPROVEMENT"))


#: The audits that a result keeps, with their columns.
AUDITS = {"first-contentful-paint": "fcp_ms", "largest-contentful-paint": "lcp_ms", "speed-index": "speed_index_ms", "total-blocking-time": "tbt_ms", "cumulative-layout-shift": "cls", "interaction-to-next-paint": "inp_ms"}


def pagespeed_targets(fetches: DataFrame) -> DataFrame:
    """(host, strategy, url): the root of each host that answered with a page, one row a strategy; its scheme is that of the first such page."""
    page = F.col("status_code").between(200, 399) & F.lower("content_type").contains("html")
    roots = fetches.where(page).groupBy("host").agg(F.min_by(F.concat(F.regexp_extract("final_url", "^(https?://[^/?#]+)", 1), F.lit("/")), "seq").alias("url"))
    return roots.select("host", F.explode(F.array(F.lit("MOBILE"), F.lit("DESKTOP"))).alias("strategy"), "url")


def pagespeed_results(observations: DataFrame) -> DataFrame:
    """Observations(host, strategy, url, psi_json) as results: success (an answer that is JSON), score of 100, six metrics, final_url and code."""
    ddl = "struct<lighthouseResult:struct<finalUrl:string,categories:struct<performance:struct<score:double>>,audits:map<string,struct<numericValue:double>>>,_corrupt_record:string>"
    read = observations.withColumn("r", F.from_json("psi_json", ddl, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    light = F.col("r")["lighthouseResult"]
    score = F.round(light["categories"]["performance"]["score"] * 100).cast("int")
    success = F.col("r").isNotNull() & F.col("r")["_corrupt_record"].isNull()
    out = read.select("host", "strategy", "url", success.alias("success"), score.alias("score"), *(light["audits"][a]["numericValue"].alias(c) for a, c in AUDITS.items()), light["finalUrl"].alias("final_url"))
    code = F.when(~F.col("success"), "PSI_FAILED").when(F.col("score") < 50, "PSI_SCORE_LOW").when(F.col("score") < 90, "PSI_SCORE_NEEDS_IMPROVEMENT")
    return out.withColumn("code", F.concat("strategy", F.lit("_"), code))


def pagespeed_report(results: DataFrame, n: int = 50) -> DataFrame:
    """(host, strategy, tested, succeeded, failed, avg_score, worst): counters, and the n urls of the lowest scores joined by blanks."""
    per = results.groupBy("host", "strategy").agg(F.count("*").alias("tested"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), F.avg(F.when(F.col("success"), F.col("score"))).alias("avg_score"))
    nth = F.row_number().over(Window.partitionBy("host", "strategy").orderBy("score", "url"))
    worst = results.where("success and score is not null").select("host", "strategy", "url", nth.alias("nth")).where(F.col("nth") <= n)
    shown = worst.groupBy("host", "strategy").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "url"))), lambda s: s["url"]), " ").alias("worst"))
    return per.join(shown.hint("shuffle_merge"), ["host", "strategy"], "left").na.fill("", ["worst"])


def host_audit(ends: DataFrame) -> DataFrame:
    """(host, https, consistent, canonical): of ends(host, url, final_url, ok); the canonical address is https naked, https www, then any."""
    final = F.col("final_url")
    rank = F.when(final.rlike(r"^https://(?!www\.)"), 0).when(final.startswith("https://"), 1).otherwise(2)
    from ..functions.urls import canonical_key

    return ends.groupBy("host").agg(F.bool_or(F.col("ok") & final.startswith("https://")).alias("https"), (F.count_distinct(canonical_key(final)) <= 1).alias("consistent"), F.min_by("final_url", F.struct(rank, final)).alias("canonical"))


def host_issues(ends: DataFrame) -> DataFrame:
    """(host, code, severity) of ends(host, url, final_url, ok): url a variant of the host's address, final_url where it led, ok whether it answered."""
    from ..functions.urls import canonical_key

    safe = lambda c: F.col(c).startswith("https://")
    per = ends.where("ok").groupBy("host").agg(
        F.bool_or(safe("url")).alias("https"), F.bool_or(~safe("url")).alias("http"), F.bool_or(~safe("url") & safe("final_url")).alias("led"), F.count_distinct(canonical_key(F.col("final_url"))).alias("keys")
    )
    rules = {
        "HTTPS_UNAVAILABLE": (~F.col("https") & F.col("http"), "Error"), "NO_HTTP_TO_HTTPS_REDIRECT_HOST": (F.col("http") & ~F.col("led"), "Warning"),
        "DOMAIN_VARIANTS_INCONSISTENT": (F.col("keys") > 1, "Warning"),
    }
    from .checks import issues

    return issues(per, "host", rules, "host")
