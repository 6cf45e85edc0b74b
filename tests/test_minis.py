"""Small golden cases and properties."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SF
from webgauge.functions import text, urls
from webgauge.operators import checks, content, extract, graph, hosts, robots
from webgauge.plans.fixtures import view
from webgauge.sources import shared
from webgauge.streaming import streams


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols))
    return df.select(expr.alias("x")).first().x


def test_url_cases(spark):
    c = F.col
    cases = [("https://a.b/x/y", "../z", "https://a.b/z"), ("https://a.b/x/", "./q?k=1", "https://a.b/x/q?k=1"), ("http://a.b/x", "//c.d/e", "http://c.d/e"), ("http://a.b", "p", "http://a.b/p"), ("http://a.b/x", "/../../z", "http://a.b/z"), ("http://a.b/x/y", "..", "http://a.b/"), ("http://a.b/x", "?s", "http://a.b/x?s")]
    df = spark.createDataFrame(cases, ["base", "ref", "expected"]).withColumn("got", urls.resolve(c("base"), c("ref")))
    assert [(r.ref, r.got) for r in df.collect()] == [(r, e) for _, r, e in cases]
    norm = [("HTTP://A.b:80/X/", "http://a.b/X"), ("https://a.b:443", "https://a.b/"), ("a.b/c?q#f", "https://a.b/c?q"), ("", None), ("http://a b/", None), ("http://a.b:8080/", "http://a.b:8080/")]
    df = spark.createDataFrame(norm, "raw string, expected string").withColumn("got", urls.crawl_url(c("raw")))
    assert [r.got for r in df.collect()] == [e for _, e in norm]
    again = df.withColumn("twice", urls.crawl_url(c("got")))
    assert all(r.got == r.twice for r in again.collect())


def test_robots_cases(spark):
    body = "User-agent: a\nUser-agent: b\nDisallow: /x\n\nUser-agent: *\nDisallow:\nDisallow: /p*q$\nAllow: /x\nUser-agent: a\nAllow: /x/ok # note\n"
    r = robots.rules(spark.createDataFrame([("h", body)], "host string, body string"))
    cases = [("a", "/x", False), ("a", "/x/ok", True), ("c", "/p1q", False), ("c", "/p1q2", True), ("c", "/x", True), ("b", "/x/ok", False)]
    for agent, path, expected in cases:
        page = spark.createDataFrame([("h", f"https://h{path}")], "host string, url string")
        assert robots.allowed(page, r, agent).first().allowed is expected, (agent, path)
    tie = robots.rules(spark.createDataFrame([("h", "User-agent: *\nDisallow: /a\nAllow: /a\n")], "host string, body string"))
    assert robots.allowed(spark.createDataFrame([("h", "https://h/a")], "host string, url string"), tie).first().allowed


def test_whois_dates_and_certificates(spark):
    for raw in ("2020-03-01", "2020-03-01T10:00:00Z", "01.03.2020", "2020.03.01", "01-Mar-2020", "2020/03/01"):
        assert str(one(spark, hosts.parse_date(F.col("v")), v=raw)) == "2020-03-01"
    match = lambda h, n: one(spark, hosts.cert_matches(F.col("h"), F.col("n")), h=h, n=[n])
    assert match("a.b.c", "*.b.c") and match("x.a.b.c", "*.b.c") and match("b.c", "B.C") and not match("b.c", "*.b.c") and not match("xb.c", "*.b.c")


def test_visible_text_cases(spark):
    cases = ["<body><main>a<div style='display: none'>b<div>c</div></div>d</main>e</body>", "<body><nav><p>x</p></nav>y&nbsp;&amp; z<!-- n --></body>", "plain", None, "<article>one</article><article>two</article>"]
    df = spark.createDataFrame(list(enumerate(cases)), "page_id bigint, html string")
    assert [r.visible_text for r in extract.visible_text(df).orderBy("page_id").collect()] == ["a d", "y & z", "plain", "", "one"]


def test_visible_text_of_hostile_pages(spark):
    """Very many open elements take time in proportion, and a declaration that is none is a comment."""
    import time

    took = {}
    for n in (4000, 16000):
        start = time.perf_counter()
        assert extract._visible("<body>" + "<div>x</i>" * n) == " ".join("x" * n)
        took[n] = time.perf_counter() - start
    assert took[16000] < 12 * took[4000]
    df = spark.createDataFrame([(1, "a", "<body>one<![foo[ two ]]>three", 5), (2, "b", None, None)], "page_id bigint, host string, html string, error int")
    got = extract.visible_text(df, keep=["host"]).orderBy("page_id").collect()
    assert [(r.host, r.error) for r in got] == [("a", None), ("b", None)] and got[0].visible_text.startswith("one") and got[1].visible_text == ""


def test_nested_markup(spark):
    df = spark.createDataFrame([(0, "<a>x<a>y</a></a><form><form></form></form>"), (1, "<p><b></p>"), (2, None)], "page_id bigint, html string")
    assert [tuple(r)[1:] for r in checks.tag_balance(df).orderBy("page_id").collect()][:2] == [(1, 1, 0), (0, 0, 1)]


def fnv(s):
    h = 14695981039346656037
    for u in memoryview(s.encode("utf-16-le")).cast("H"):
        h = ((h ^ (u & 255)) * 1099511628211) % (1 << 64)
    return h - (1 << 64) if h >= 1 << 63 else h


def test_fnv(spark):
    words = ["a", "слово", "café", "x" * 40]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.fnv1a(F.col("w")).alias("h"))
    assert {r.w: r.h for r in df.collect()} == {w: fnv(w) for w in words}


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=2, max_size=12))
def test_near_pairs_are_true_pairs(spark, values):
    rows = [("h", i, v) for i, v in enumerate(values)]
    pairs = content.near_pairs(spark.createDataFrame(rows, "host string, seq bigint, simhash bigint")).collect()
    assert all(bin((values[p.seq] ^ values[p.other]) & (2**64 - 1)).count("1") == p.distance <= 5 and p.other < p.seq for p in pairs)


def test_near_pairs_lose_none(spark):
    """Against all pairs: 300 hashes that share a band, some of them equal, so that no bucket limit could hide a late pair."""
    import random

    draw = random.Random(5)
    apart = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    base = [draw.getrandbits(47) << 16 | 0xBEEF for _ in range(60)]
    values = []
    for _ in range(300):
        v = draw.choice(base)
        for k in draw.sample(range(63), draw.randrange(8)):
            v ^= 1 << k
        values.append(v)
    bands = lambda a, b: any(not (a ^ b) >> 16 * k & 0xFFFF for k in range(4))
    best = {}
    for i, v in enumerate(values):
        found = [(apart(v, w), j) for j, w in enumerate(values[:i]) if apart(v, w) <= 5 and bands(v, w)]
        if found:
            best[i] = min(found)
    made = content.near_pairs(spark.createDataFrame([("h", i, v) for i, v in enumerate(values)], "host string, seq bigint, simhash bigint")).collect()
    assert {r.seq: (r.distance, r.other) for r in made} == best and len(best) > 50


def test_large_pages_and_failed_checks(spark):
    o = checks.Options(large_html_chars=10)
    pages = spark.createDataFrame([(1, "https://h/", "<!doctype html><p>long enough"), (2, "https://h/2", "<p>x")], "page_id bigint, url string, html string")
    assert [r.page_id for r in checks.markup(pages, o).where("code = 'HTML_LARGE_PAGE_BODY'").collect()] == [1]
    fetches = spark.createDataFrame([(n, "https://h/", "https://h/", status, "text/html", size, 0.1) for n, status, size in ((1, 200, 2_000_001), (2, 302, 2_000_001), (3, 200, 2_000_000), (4, 404, 9_000_000))], "seq bigint, original_url string, final_url string, status_code int, content_type string, content_length bigint, load_seconds double")
    assert sorted(r.seq for r in checks.fetch_issues(fetches).where("code = 'HTML_LARGE_PAGE'").collect()) == [1, 2]
    read = spark.createDataFrame([(1, None), (2, "RecursionError")], "page_id bigint, error string")
    assert [tuple(r) for r in checks.failed_checks(read).collect()] == [(2, "runner", "CHECK_FAILED", "Error")]


def test_invalid_and_misplaced_canonicals(spark):
    html = ['<html><head><link rel="canonical" href="http://[bad"></head><body></body></html>', '<html><head></head><body><link rel="canonical" href="https://h/1"></body></html>', "<html></html>"]
    pages = spark.createDataFrame([(k, "h", f"https://h/{k}", x) for k, x in enumerate(html)], "page_id bigint, host string, url string, html string")
    assert sorted((r.page_id, r.code) for r in checks.canonical_issues(pages).collect()) == [(0, "CANONICAL_INVALID_URL"), (1, "CANONICAL_IN_BODY")]


def test_frontier_goes_to_the_end(spark):
    edges = [("h", f"p{k}", f"P{k + 1}") for k in range(54)] + [("h", "p3", "p0"), ("h", "p4", "q"), ("h", "q", "r"), ("g", "p0", "p1"), ("h", "x", "y")]
    depth, level = {"p0": 0}, ["p0"]
    while level:
        level = sorted({d.lower() for h, a, d in edges if h == "h" and a in level} - {"q", *depth})
        depth |= {u: max(depth.values()) + 1 for u in level}
    made = graph.frontier(spark.createDataFrame(edges, "host string, src string, dst string"), spark.createDataFrame([("h", "p0")], "host string, url string"), blocked=spark.createDataFrame([("h", "q")], "host string, url string"))
    assert {r.url: r.depth for r in made.collect()} == depth and max(depth.values()) == 54


def test_issues_do_not_depend_on_partitioning(spark):
    pages = view(spark, SF, "pages_ext")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(checks.seo(pages)) == key(checks.seo(pages.repartition(5)))


def test_empty_tables(spark):
    pages = view(spark, SF, "pages_ext").limit(0)
    assert checks.run_checks(pages).count() == 0
    assert content.near_pairs(content.simhash(spark.createDataFrame([], "host string, seq bigint, text string"))).count() == 0


def test_replace_hosts(spark, tmp_path):
    path = str(tmp_path / "t")
    shared.replace_hosts(spark.createDataFrame([("a", 1), ("b", 2)], "host string, v int"), path)
    shared.replace_hosts(spark.createDataFrame([("b", 3)], "host string, v int"), path)
    assert {(r.host, r.v) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 3)}


def test_whole_files(spark, tmp_path):
    import gzip

    (tmp_path / "a.xml").write_text("<urlset>\n</urlset>")
    (tmp_path / "b.xml.gz").write_bytes(gzip.compress(b"<x>\n</x>"))
    assert {r.body for r in shared.read_whole_files(spark, str(tmp_path)).collect()} == {"<urlset>\n</urlset>", "<x>\n</x>"}


def drain(df, name, spark, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_streams_equal_batches(spark, tmp_path):
    fetches = view(spark, SF, "fetches").drop("html")
    fetches.repartition(3).write.parquet(str(tmp_path / "f"))
    stream = streams.arriving(spark, str(tmp_path / "f"), fetches.schema)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(drain(streams.fetch_issues(stream), "st1", spark)) == key(checks.fetch_issues(fetches))
    probes = view(spark, SF, "probes")
    probes.write.parquet(str(tmp_path / "p"))
    arriving = spark.readStream.schema(probes.schema).parquet(str(tmp_path / "p"))
    assert key(drain(streams.probe_windows(arriving, "10 minutes"), "st4", spark, "complete")) == key(streams.probe_windows(probes, "10 minutes"))


def test_uniformity_alert_once(spark, tmp_path):
    rows = [(i, "h", 10 if i % 5 else 20) for i in range(120)] + [(i, "g", i) for i in range(120)]
    df = spark.createDataFrame(rows, "seq bigint, host string, content_length bigint")
    df.coalesce(1).write.parquet(str(tmp_path / "u"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "u"))
    assert [tuple(r) for r in drain(streams.uniformity_alerts(stream), "st2", spark).collect()] == [("h", 50, 10, 40)]


def test_first_seen(spark, tmp_path):
    rows = [("h", "k", "2024-01-01 00:00:00"), ("h", "k", "2024-01-01 00:00:05"), ("h", "m", "2024-01-01 00:00:01")]
    df = spark.createDataFrame(rows, "host string, key string, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "s"))
    assert drain(streams.first_seen(stream), "st3", spark).count() == 2


def test_whois_keys_begin_lines(spark):
    raw = "\n".join(["% Registered nowhere", "created: not a date", "Created on: 2011-02-03", "domain: x", "paid till  ", "Expiry Date: unknown", "\tEXPIRES: 2030-05-06\r", "paid-till: 2031-01-01"])
    rows = [("a", raw), ("b", "Registered: 2001-01-01\nCreation Date: 2002-01-01T00:00:00Z\nexpire: 2024-02-01"), ("c", ""), ("d", "nothing here")]
    got = {r.host: r for r in hosts.whois(spark.createDataFrame(rows, "host string, whois_raw string"), "2024-01-15").collect()}
    assert (str(got["a"].created), str(got["a"].expires), got["a"].code) == ("2011-02-03", "2030-05-06", None)
    assert (str(got["b"].created), got["b"].days_left, got["b"].code) == ("2002-01-01", 17, "DOMAIN_EXPIRING_SOON")
    assert got["c"].code == "WHOIS_UNAVAILABLE" and got["d"].code == "WHOIS_EXPIRES_UNKNOWN"


def test_suffixes_and_directives(spark):
    df = spark.createDataFrame([("shop.example.com.cn",), ("a.b.NE.jp",), ("x.y.co.nz",), ("one",)], "h string")
    assert [r[0] for r in df.select(urls.registrable_domain(F.col("h"))).collect()] == ["example.com.cn", "b.NE.jp", "co.nz", "one"]
    files = spark.createDataFrame([("h", "User-agent: *\nDisallow: /\nClean-param: x\nHost: y\nNoindex: /")], "host string, body string")
    assert {(r.line, r.code) for r in robots.lint(files).collect()} == {(3, "ROBOTS_UNKNOWN_DIRECTIVE"), (5, "ROBOTS_UNKNOWN_DIRECTIVE")}
