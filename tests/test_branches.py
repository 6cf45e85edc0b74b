"""Addresses, suffixes, answers without a schema, codes, reports and streams on odd rows."""

import ipaddress
import os

import pytest
from pyspark.sql import functions as F

from webgauge.functions import addresses
from webgauge.operators import content, documents, hosts, reports, robots, suffixes
from webgauge.sources import shared
from webgauge.streaming import streams

IPS = ["8.8.8.8", "::1", "::", "2001:db8::5", "2a00:1450:4001:80b::200e", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::2::3", "1:2:3", "12345::", "fe80::1%eth0", "256.1.1.1", "", "host", None, "64:ff9b::192.0.2.33", "1:2:3:4:5:6:7:8:9", "FE80::A", "1.2.3", ":", ":::"]


def read(ip):
    """A scope isn't part of an address."""
    try:
        return None if "%" in (ip or "") else ipaddress.ip_address(ip)
    except ValueError:
        return None


def test_addresses_equal_the_standard_library(spark):
    df = spark.createDataFrame([(x,) for x in IPS], "ip string")
    for r in df.select("ip", addresses.nibbles(F.col("ip")).alias("n"), addresses.lookup_name(F.col("ip"), F.lit("z")).alias("k"), addresses.bits(F.col("ip")).alias("b")).collect():
        a = read(r.ip)
        number = a and (int(a) if a.version == 6 else 0xFFFF << 32 | int(a))
        assert r.n == (a and f"{number:032x}") and r.b == (a and f"{number:0128b}"), r.ip
        assert r.k == (a and a.reverse_pointer.removesuffix(".ip6.arpa").removesuffix(".in-addr.arpa") + ".z"), r.ip


def test_the_longest_network_counts(spark):
    ranges = [("2001:db8::/32", "DE"), ("2001:db8::5/128", "FR"), ("0.0.0.0/0", "XX"), ("8.8.0.0/16", "US"), ("8.8.8.8/32", None), ("bad", "Q"), ("8.8.8.0/99", "Q"), (None, "Q"), ("::/0", "ZZ"), ("2a00::/12", "B"), ("2a00::/12", "A")]
    df = spark.createDataFrame([(x,) for x in IPS * 2], "ip string")
    got = {r.ip: r.c for r in addresses.in_networks(df, spark.createDataFrame(ranges, "cidr string, c string"), "c").collect()}
    nets = [(ipaddress.ip_network(n), c) for n, c in ranges if n and n not in ("bad", "8.8.8.0/99")]
    for ip in set(IPS):
        a = read(ip)
        own = [(n.prefixlen + 96 * (n.version == 4), c or "") for n, c in nets if a and a in n]
        own += [(0, "ZZ")] * bool(a and a.version == 4) + [(96, "XX")] * bool(a and a.version == 6 and a.ipv4_mapped)
        longest = max((k for k, _ in own), default=None)
        assert got[ip] == (min(c for k, c in own if k == longest) or None if own else None), ip
    assert {r.c for r in addresses.in_networks(df, spark.createDataFrame([], "cidr string, c string"), "c").collect()} == {None}


def test_suffix_rules(spark):
    want = {
        "a.b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", None), "uk": ("uk", None), "www.ck": ("ck", "www.ck"), "a.www.ck": ("ck", "www.ck"), "x.ck": ("x.ck", None), "z.y.x.ck": ("x.ck", "y.x.ck"), "example": ("example", None), "": (None, None), None: (None, None),
        "A.COM.": ("com", "a.com"), "..": (None, None), "city.kobe.jp": ("kobe.jp", "city.kobe.jp"), "a.city.kobe.jp": ("kobe.jp", "city.kobe.jp"), "b.kobe.jp": ("b.kobe.jp", None), "d.c.b.kobe.jp": ("b.kobe.jp", "c.b.kobe.jp"),
    }
    names = spark.createDataFrame([(h,) for h in [*want, "uk"]], "host string")
    rules = spark.createDataFrame([(x,) for x in ["com", "UK", "co.uk", "*.ck", "!www.ck", "jp", "*.kobe.jp", "!city.kobe.jp", "", None, "uk"]], "rule string")
    assert {r.host: (r.suffix, r.domain) for r in suffixes.registrable_domains(names, rules).collect()} == want
    assert {r.suffix for r in suffixes.registrable_domains(names.where("host = 'a.b.co.uk'"), rules.limit(0)).collect()} == {"uk"}


def test_answers_of_any_shape(spark):
    psi = [None, "", "nope", "[1]", "{}", '{"lighthouseResult":{"categories":{"performance":{"score":"0.895"}},"audits":{"speed-index":{"numericValue":5}}}}', '{"lighthouseResult":{"categories":{"performance":[1]},"audits":[]}}']
    rows = spark.createDataFrame([("h", "MOBILE", f"u{k}", j) for k, j in enumerate(psi)], "host string, strategy string, url string, psi_json string")
    got = {r.url: r for r in documents.pagespeed_results(rows).collect()}
    assert [got[f"u{k}"].success for k in range(7)] == [False] * 4 + [True] * 3 and (got["u5"].score, got["u5"].speed_index_ms, got["u5"].shape) == (90, 5.0, "OBJECT<score: STRING>")
    assert got["u6"].score is None and got["u6"].shape == "ARRAY<BIGINT>"
    answers = [
        ("a", '{"events":[{"eventAction":"Registration","eventDate":"2015-02-03"},5,{"eventAction":"expiration","eventDate":["x"]},{"eventAction":"expiration","eventDate":"2024-02-10T00:00:00Z"}],"entities":[{"country":"x"},{"country":"de"}]}'),
        ("b", '{"events":{"x":1},"cc":"FR"}'), ("c", None), ("d", "zzz"), ("e", '{"country":1,"countryCode":"nl","entities":"no"}'),
    ]
    made = {r.host: tuple(map(str, r[1:4])) for r in documents.rdap_dates(spark.createDataFrame(answers, "host string, json string")).collect()}
    assert made == {"a": ("2015-02-03", "2024-02-10", "DE"), "b": ("None", "None", "FR"), "c": ("None",) * 3, "d": ("None",) * 3, "e": ("None", "None", "NL")}


def test_domain_codes_come_together(spark):
    rows = [("a", "paid-till: 2020-01-01"), ("b", "nothing"), ("c", None), ("d", "created: 2019-01-01\npaid-till: 2024-01-20")]
    dates = hosts.whois(spark.createDataFrame(rows, "host string, whois_raw string"), "2024-01-15")
    got = {}
    for r in hosts.whois_issues(dates).collect():
        got.setdefault(r.host, set()).add(r.code)
    assert got == {"a": {"WHOIS_CREATED_UNKNOWN", "DOMAIN_EXPIRED"}, "b": {"WHOIS_CREATED_UNKNOWN", "WHOIS_EXPIRES_UNKNOWN"}, "c": {"WHOIS_UNAVAILABLE"}, "d": {"DOMAIN_EXPIRING_SOON"}}


def test_robots_of_odd_hosts(spark):
    rows = [("a", "http", 200, None), ("a", "https", None, None), ("b", "https", 200, "User-agent: *\nDisallow: /"), ("b", "https", 200, "User-agent: *\nDisallow: /"), ("c", "ftp", 410, "x")]
    got = {}
    for r in robots.host_issues(spark.createDataFrame([(h,) for h in "abcdd"], "host string"), spark.createDataFrame(rows, "host string, scheme string, status_code int, body string")).collect():
        got.setdefault(r.host, []).append(r.code)
    assert {h: sorted(v) for h, v in got.items()} == {"a": ["ROBOTS_NO_GROUP_FOR_UA", "ROBOTS_ONLY_HTTP"], "b": ["ROBOTS_BLOCKS_ALL"], "c": ["ROBOTS_HTTP_ERROR", "ROBOTS_MISSING_OR_UNAVAILABLE"], "d": ["ROBOTS_FETCH_FAILED", "ROBOTS_MISSING_OR_UNAVAILABLE"]}


def test_content_report_of_odd_texts(spark):
    long = " ".join(f"word{k} and more text beside it" for k in range(200))
    rows = [("h", 1, "u1", long, 9000), ("h", 2, "u2", long, 9000), ("h", 3, "u3", None, None), ("h", 4, "u4", "", 10), ("h", 5, "u5", "spam " * 200, 1000), ("g", 6, "u6", long + " x y z", 10**9)]
    df = spark.createDataFrame(rows, "host string, seq bigint, url string, text string, html_chars int")
    got = {r.host: r for r in reports.content_report(df).collect()}
    h, g = got["h"], got["g"]
    assert (h.pages, h.thin, h.thin_urls, h.stuffed, h.stuffed_urls, h.exact_groups, h.near_pairs, h.nearest_pairs) == (5, 2, "u3 u4", 3, "u1 u2 u5", 1, 1, "u2~u1=0") and h.largest_groups.endswith("=2")
    assert (g.pages, g.thin, g.exact_groups, g.near_pairs, g.nearest_pairs) == (1, 1, 0, 0, "")
    assert not reports.content_report(df.limit(0)).collect()


def test_observation_files_keep_bad_lines(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"host":"a","n":1}\n{"host":"b","n":"x"}\nnot json\n\n{"host":"c"}\n{"host":"d","n":1,"extra":[]}\n')
    good, bad = shared.split_bad(shared.read_observations(spark, str(tmp_path), "host string, n int"))
    assert sorted((r.host, r.n) for r in good.collect()) == [("a", 1), ("c", None), ("d", 1)] and sorted(r.record for r in bad.collect()) == ['not json', '{"host":"b","n":"x"}']


def test_clear_removes_what_this_application_wrote(spark):
    written = shared.materialize(spark.range(3).selectExpr("id", "'x' AS v"))
    assert written.count() == 3
    folder = written.inputFiles()[0].rsplit("/", 2)[0].removeprefix("file://")
    assert os.path.isdir(folder) and spark.sparkContext.applicationId in folder
    shared.clear(spark)
    assert not os.path.exists(folder)
    shared.clear(spark)


def drain(stream, out, checkpoint, without_rows="true"):
    """without_rows: batches without data move a watermark on, but never end where state expires by the clock."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", without_rows)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    return spark.read.schema(stream.schema).parquet(out).collect()


def test_repeats_over_a_restart(spark, tmp_path):
    rows = [("h", k, s, f"u{s}") for s, k in enumerate(["a", "b", "a", "", None, "c", "a", "b", "c", "d"])] + [("g", "a", 20, "u20"), (None, "a", 21, "n"), (None, "a", 22, "n")]
    schema = "host string, key string, seq bigint, url string"
    want = {(r.host, r.key, r.seq) for r in content.repeated(spark.createDataFrame([r for r in rows if r[0]], schema), F.col("key")).collect()} | {(None, "a", 22)}
    for part in (rows[:5], rows[5:]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(str(tmp_path / "in"))
        made = drain(streams.repeated(streams.arriving(spark, str(tmp_path / "in"), schema), shares=3), str(tmp_path / "out"), str(tmp_path / "c"), "false")
    assert {(r.host, r.key, r.seq) for r in made} == want and len(made) == len(want)


def test_late_probes_join_sessions_until_the_watermark(spark, tmp_path):
    schema = "host string, ts timestamp, status_code int"
    parts = [[("h", "00:00:00"), ("h", "00:30:00")], [("h", "00:15:00"), ("h", "03:00:00")], [("h", "00:20:00"), ("h", "05:00:00")]]
    for part in parts:
        rows = spark.createDataFrame([(h, f"2024-01-01 {t}", 200) for h, t in part], "host string, ts string, status_code int").withColumn("ts", F.to_timestamp("ts"))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        made = drain(streams.probe_sessions(streams.arriving(spark, str(tmp_path / "in"), schema), "20 minutes", late="1 hour"), str(tmp_path / "out"), str(tmp_path / "c"))
    # The row of 00:15 comes late but in time and joins two sessions; that of 00:20 comes after the watermark and is dropped.
    assert sorted((str(r.start)[11:], str(r.end)[11:], r.n) for r in made)[:1] == [("00:00:00", "00:50:00", 3)]


@pytest.mark.parametrize("slide", [None, "5 minutes"])
def test_windows_of_a_stream_equal_a_batch(spark, tmp_path, slide):
    rows = spark.range(60).select(F.lit("h").alias("host"), F.timestamp_seconds(F.col("id") * 97).alias("ts"), F.lit(200).alias("status_code"))
    rows.write.parquet(str(tmp_path / "in"))
    q = streams.probe_windows(streams.arriving(spark, str(tmp_path / "in"), rows.schema), "10 minutes", slide).writeStream.format("memory").queryName(f"w{slide is None}").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(str, spark.table(f"w{slide is None}").collect())) == sorted(map(str, streams.probe_windows(rows, "10 minutes", slide).collect()))
