"""What shows only on tables that aren't joined up into one partition, or whose addresses repeat."""

import duckdb
import pytest

from pyspark.sql import functions as F

from webgauge.functions import text
from webgauge.operators import checks, content, graph, rule_automaton
from webgauge.plans import registry


@pytest.fixture
def apart(spark):
    """Shuffles keep their partitions, as they do on large tables."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_rules_meet_their_pages_in_each_partition(apart):
    """Keys of two integer types sent pages and rules of a group to different tasks."""
    pages = apart.createDataFrame([(k, f"h{k % 7}", f"http://h{k % 7}/a/{k}") for k in range(70)], "seq bigint, host string, url string")
    rules = apart.createDataFrame([(f"h{k}", "*", False, "/a") for k in range(7)], "host string, agent string, allow boolean, pattern string")
    for group in (3, 10, 1000):
        got = rule_automaton.allowed(pages, rules, group=group).collect()
        assert len(got) == 70 and not any(r.allowed for r in got) and {r.specificity for r in got} == {2}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """1,300 pages of one host, of which the last hundred repeat addresses; every third title is cut within a reference."""
    path = tmp_path_factory.mktemp("pages")
    duckdb.sql(f"""COPY (SELECT i AS page_id, 'http://h.example.org/en/' || i % 1200 || CASE WHEN i % 5 = 0 THEN '#top' ELSE '' END AS url,
     '<!DOCTYPE html><html><head><title>t</title></head><body><nav>n</nav><article><h1>Page ' || i || CASE i % 3 WHEN 0 THEN ' a&amp;&amp' WHEN 1 THEN ' b&lt' ELSE ' c&amp;lt' END || '</h1><p>text</p></article></body></html>' AS html
     FROM range(1300) r(i)) TO '{path}/pages.parquet'""")
    return str(path)


@pytest.mark.parametrize("name", ["a15_crawl_counters", "j8_redirect_chains", "u19_p26_visible_text", "p21_u19_thin_pages", "d3_u19_page_copies", "p3_p7_p8_p10_p11_p25_p27_p33_fetch_issues"])
def test_repeated_addresses_and_cut_references(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    cur = con.execute(registry.ORACLES[name])
    cols = [c[0] for c in cur.description]
    got = registry.QUERIES[name](spark, folder).select(*cols).collect()
    assert got and sorted(map(repr, map(tuple, got))) == sorted(map(repr, cur.fetchall()))


def test_whole_crawl_has_no_page_limit(spark, folder):
    assert [r.visited for r in registry.QUERIES["a15_crawl_counters"](spark, folder).collect()] > [1000]


def test_least_answer_of_an_address_counts(spark):
    url = "http://h/1"
    edges = spark.createDataFrame([("h", url, url)], "host string, src string, dst string")
    pages = spark.createDataFrame([("h", url)], "host string, url string")
    results = spark.createDataFrame([("h", url, 404, "text/html", False), ("h", url, 200, "text/html", False)], "host string, url string, status_code int, content_type string, truncated boolean")
    for rows in (results, results.orderBy("status_code")):
        got = graph.crawl_counters(edges, pages, pages.limit(0), pages.limit(0), rows).first()
        assert (got.visited, got.skipped_http_errors) == (1, 0)


def test_fetches_tell_whether_a_redirect_stays_in_its_domain(spark):
    ends = [(1, "http://a.org/", "http://www.a.org/"), (2, "http://a.org/", "http://b.org/"), (3, "http://a.org/", "http://a.org/x")]
    fetches = spark.createDataFrame([(k, a, b, 200, "text/html", 1, 0.1) for k, a, b in ends], "seq bigint, original_url string, final_url string, status_code int, content_type string, content_length bigint, load_seconds double")
    got = checks.fetch_issues(fetches).where("code like 'REDIRECT_TO_%'").orderBy("seq").collect()
    assert [(r.seq, r.code) for r in got] == [(1, "REDIRECT_TO_SUBDOMAIN"), (2, "REDIRECT_TO_OTHER_DOMAIN")]


def test_tokens_stay_with_their_document(apart):
    """Texts are dealt out once; what is counted after that is counted where it is, also for rows that share a seq."""
    rows = [("h", k % 40, f"one two{k} two{k} ЖУК 𝒜b {'long' * 9}") for k in range(60)] + [("h", 99, ""), ("h", 98, None), (None, None, "some words")]
    docs = apart.createDataFrame(rows, "host string, seq bigint, text string")
    for made in (content.simhash(docs), content.stuffing(docs)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Join" not in plan
    token = docs.select("host", "seq", F.explode(text.tokenize(F.col("text"))).alias("token"))
    want = {}
    for r in token.collect():
        h = 14695981039346656037
        for b in r.token.encode("utf-16-be")[1::2]:
            h = (h ^ b) * 1099511628211 % (1 << 64)
        bits, n = want.setdefault((r.host, r.seq), ([0] * 64, [0]))
        n[0] += 1
        for k in range(64):
            bits[k] += h >> k & 1
    hashes = {k: sum(1 << i for i in range(64) if 2 * bits[i] > n[0]) for k, (bits, n) in want.items()}
    assert {(r.host, r.seq): r.simhash % (1 << 64) for r in content.simhash(docs).collect()} == hashes
