"""Observation operators on odd rows: nulls, empty tables, ties, repeated rows, and against plain Python."""

import random

from pyspark.sql import functions as F

from webgauge.operators import graph, hosts, robots


def test_uniformity_alerts_look_by_look(spark):
    rnd = random.Random(5)
    rows = [(h, i, 7 if rnd.random() < p else rnd.randrange(1, 5)) for h, n, p in (("a", 300, 0.9), ("b", 49, 1.0), ("c", 400, 0.76), ("d", 130, 0.4), ("e", 60, 0.8)) for i in range(n)]
    rows += [("a", 1000, None), ("b", 1000, 0), (None, 1, 5)]
    want = {}
    for h in "abcde":
        sizes = [x for g, _, x in rows if g == h and x]
        for n in range(50, len(sizes) + 1):
            top = max(sizes[:n].count(x) for x in set(sizes[:n]))
            if h not in want and (n == 50 or n % 25 == 0) and top >= 0.75 * n:
                want[h] = (n, top)
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "host string, seq long, content_length long").repartition(7)
    assert {r.host: (r.pages, r.top_count) for r in graph.uniformity_alerts(df).collect()} == want and "a" in want and "b" not in want
    assert graph.uniformity_alerts(df.limit(0)).count() == 0


def test_pagespeed_of_odd_answers(spark):
    rows = [("h", "MOBILE", f"u{i}", j) for i, j in enumerate([None, "", "nope", "{}", '{"lighthouseResult":{"categories":{"performance":{"score":0.895}},"audits":{}}}', '{"lighthouseResult":{"categories":null}}'])]
    got = {r.url: r for r in hosts.pagespeed_results(spark.createDataFrame(rows, "host string, strategy string, url string, psi_json string")).collect()}
    assert [got[f"u{i}"].success for i in range(6)] == [False, False, False, True, True, True]
    assert got["u4"].score == 90 and got["u4"].code is None and got["u3"].score is None and got["u0"].code == "MOBILE_PSI_FAILED"
    report = hosts.pagespeed_report(hosts.pagespeed_results(spark.createDataFrame(rows, "host string, strategy string, url string, psi_json string"))).first()
    assert (report.tested, report.succeeded, report.failed, report.avg_score, report.worst) == (6, 3, 3, 90.0, "u4")


def test_public_addresses(spark):
    ips = {
        "8.8.8.8": True, "10.1.1.1": False, "127.0.0.1": False, "169.254.0.1": False, "172.15.0.1": True, "172.16.0.1": False, "192.168.1.1": False, "224.0.0.1": False, "255.1.1.1": False, "::1": False,
        "0:0:0:0:0:0:0:1": False, "fe80::1": False, "fec0::1": False, "ff02::1": False, "fd00::1": False, "fd::1": True, "2001::1": False, "2001:0:1::2": False, "2001:db8::1": True, "2606:4700::1111": True, "": False, "host": False,
    }
    df = spark.createDataFrame([(k,) for k in ips], "ip string")
    assert {r.ip: r.ok for r in df.select("ip", hosts.public_ip(F.col("ip")).alias("ok")).collect()} == ips


def test_sitemap_report_of_odd_files(spark):
    files = [
        ("a", "https://a/sitemap.xml", 200, "<urlset><url><loc>https://a/x</loc></url><url><loc>https://a/x?q=1</loc></url><url><loc> </loc></url></urlset>"), ("a", "https://a/2.xml", None, None), ("a", "https://a/3.xml", 200, None),
        ("b", "https://b/s.xml", 200, "<rss><loc>https://b/x</loc></rss>"), ("gone", "https://gone/sitemap.xml", 200, "<urlset></urlset>"),
    ]
    states = [("a", "https://a/x", "indexable"), ("a", "https://a/y", "indexable"), ("b", "https://b/x", "noindex_meta"), ("c", None, None)]
    f = spark.createDataFrame(files, "host string, url string, status_code int, body string")
    s = spark.createDataFrame(states, "host string, url string, state string")
    got = {r.host: r for r in robots.sitemap_report(f, s).collect()}
    assert set(got) == {"a", "b", "c"}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a.found, a.files, a.elements, a.urls, a.html_estimate, a.has_sitemap_xml, a.errors, a.warnings, a.not_crawled, a.not_in_sitemap) == (True, 2, 2, 1, 1, True, 2, 0, 0, 1)
    assert (b.found, b.files, b.urls, b.errors, b.warnings) == (False, 1, 0, 1, 2)
    assert (c.found, c.files, c.errors, c.warnings) == (False, 0, 1, 0)
    assert robots.sitemap_report(f.limit(0), s.limit(0)).count() == 0
    assert [r.warnings for r in robots.sitemap_report(f, s.where("host = 'a'"), max_urls=0).collect()] == [1]


def test_rdap_candidates(spark):
    names = spark.createDataFrame([("www.shop.example.com",), ("example.com",), ("x.org",)], "host string")
    asked = sorted((r.host, r.nth, r.domain) for r in hosts.rdap_candidates(names).collect())
    assert asked == [("example.com", 0, "example.com"), ("www.shop.example.com", 0, "www.shop.example.com"), ("www.shop.example.com", 1, "shop.example.com"), ("www.shop.example.com", 2, "example.com"), ("x.org", 0, "x.org")]
    answers = spark.createDataFrame([("example.com", "{}"), ("shop.example.com", None)], "domain string, json string")
    got = {r.host: (r.domain, r.code) for r in hosts.rdap_by_candidates(names, answers, "2024-01-01").collect()}
    assert got == {"www.shop.example.com": ("example.com", "DOMAIN_WHOIS_FAILED"), "example.com": ("example.com", "DOMAIN_WHOIS_FAILED"), "x.org": (None, "DOMAIN_WHOIS_FAILED")}
