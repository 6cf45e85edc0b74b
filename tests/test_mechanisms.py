"""Rule automata, user checks, XML, crawl budgets, redirect pointers and near pairs by blocks, against brute force and on odd rows."""

import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SF
from webgauge.operators import graph, near_blocks, robots, row_checks, rule_automaton, sitemap_xml
from webgauge.plans.fixtures import view

# --- robots rules


def longest(rules, path):
    best = None
    for pattern, allow in rules:
        closed = pattern.endswith("$")
        body = pattern[:-1] if closed else pattern
        if re.match("^" + ".*".join(map(re.escape, body.split("*"))) + ("$" if closed else ""), path):
            best = max(best or (len(pattern), allow), (len(pattern), allow))
    return best


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("/ab*$", min_size=1, max_size=7), st.booleans()), max_size=8), st.lists(st.text("/ab*$", max_size=10), max_size=6))
def test_automaton_equals_regular_expressions(rules, paths):
    made = rule_automaton.Automaton(rules)
    for path in paths:
        assert made.match(path) == longest(rules, path), (rules, path)


def test_automaton_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(rule_automaton, "REMEMBERED", 5)
    draw = random.Random(2)
    rules = [("".join(draw.choice("/ab*") for _ in range(draw.randrange(1, 8))), draw.random() < 0.5) for _ in range(40)]
    made = rule_automaton.Automaton(rules)
    for _ in range(300):
        path = "/" + "".join(draw.choice("/abc") for _ in range(draw.randrange(12)))
        assert made.match(path) == longest(rules, path)


def test_time_is_flat_in_the_number_of_rules():
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    rules = [(f"/{word()}/{word()}", k % 2 == 0) for k in range(990)] + [(f"/*{word()}", True) for _ in range(10)]
    paths = [f"/{word()}/{word()}/{word()}" for _ in range(300)] + [p for p, _ in rules[:100]]
    took = {}
    for n in (20, 1000):
        made = rule_automaton.Automaton(rules[-n:])
        [made.match(p) for p in paths]
        took[n] = min(_timed(lambda: [made.match(p) for p in paths]) for _ in range(5))
    assert took[1000] < 4 * took[20]


def _timed(f):
    start = time.perf_counter()
    f()
    return time.perf_counter() - start


def test_rules_of_many_hosts_equal_the_columns(spark):
    draw = random.Random(4)
    rules = [(f"h{draw.randrange(6)}", draw.choice(["*", "mycrawler", "other"]), draw.random() < 0.5, "/" + "".join(draw.choice("ab*/") for _ in range(draw.randrange(1, 6))) + draw.choice(["", "$"])) for _ in range(200)]
    rules += [("big", "*", k % 3 == 0, f"/{k}$") for k in range(1000)] + [("big", "*", False, "/*9")]
    pages = [(k, f"h{draw.randrange(8)}", "https://x/" + "".join(draw.choice("ab/") for _ in range(draw.randrange(8)))) for k in range(300)]
    pages += [(1000 + k, "big", f"https://big/{k}{'?q=1' * (k % 2)}") for k in range(900)] + [(5, "big", None), (None, "big", "https://big/9"), (None, None, "https://n/"), (7, "h1", "https://x")] * 2
    p, r = spark.createDataFrame(pages, "seq bigint, host string, url string"), spark.createDataFrame(rules, "host string, agent string, allow boolean, pattern string")
    got = rule_automaton.allowed(p, r, group=100)
    compiled = r.selectExpr("host", "agent", "allow", "pattern", "length(pattern) AS specificity").withColumn("regex", robots.pattern(r["pattern"]))
    key = lambda df: sorted(map(str, df.select("seq", "host", "allowed").collect()))
    assert key(got) == key(robots.allowed(p.where("url is not null"), compiled).unionByName(p.where("url is null").selectExpr("seq", "host", "url", "true AS allowed")))
    assert not rule_automaton.allowed(p.limit(0), r).collect()
    assert all(x.allowed and x.specificity is None for x in rule_automaton.allowed(p, r.limit(0)).collect())


# --- user checks


def test_user_checks_are_isolated(spark):
    def fine(page):
        return [("FINE", "Info", {"n": page.n})]

    def half(page):
        yield "FIRST", "Warning", None
        if page.n == 2:
            raise ValueError("two")

    def nothing(page):
        return None

    def wrong(page):
        return [("X", "Fatal", None)] if page.n == 1 else []

    checks = {"fine": fine, "half": half, "nothing": nothing, "wrong": wrong, "broken": lambda page: page.absent}
    df = spark.createDataFrame([(1, 1, "a"), (2, 2, None), (2, 2, None), (None, 3, "c")], "page_id bigint, n int, `check` string")
    got = row_checks.run_row_checks(df.repartition(2), checks, ["page_id"], ["n"])
    assert got.columns == ["page_id", "check", "code", "severity", "detail"]
    rows = sorted(((r.page_id, r["check"], r.code, r.severity) for r in got.collect()), key=str)
    failed = lambda k, name: (k, name, "CHECK_FAILED", "Error")
    each = lambda k, extra: [(k, "fine", "FINE", "Info"), failed(k, "broken"), *extra]
    want = each(1, [(1, "half", "FIRST", "Warning"), failed(1, "wrong")]) + 2 * each(2, [failed(2, "half")]) + each(None, [(None, "half", "FIRST", "Warning")])
    assert rows == sorted(want, key=str)
    assert {r.detail["message"] for r in got.where("code = 'CHECK_FAILED' and `check` = 'half'").collect()} == {"half: two"}
    assert not row_checks.run_row_checks(df.limit(0), checks, ["page_id"], ["n"]).collect()


# --- XML


def test_sitemap_xml_of_odd_files(spark):
    many = "".join(f"<url><loc>https://h/{k}</loc></url>" for k in range(25_000))
    bodies = {
        "declared": '﻿<?xml version="1.0" encoding="UTF-16"?>\n<urlset><url><loc>https://h/é</loc></url></urlset>', "many": f"<urlset>{many}</urlset>", "null": None, "blank": " \n", "text": "no xml",
        "laughs": '<!DOCTYPE u [<!ENTITY a "' + "x" * 2000 + '"><!ENTITY b "' + "&a;" * 2000 + '"><!ENTITY c "' + "&b;" * 2000 + '">]><urlset><url><loc>&c;</loc></url></urlset>',
        "outside": '<!DOCTYPE u [<!ENTITY f SYSTEM "file:///etc/passwd">]><urlset><url><loc>a&f;b</loc></url></urlset>', "nested": "<urlset><url><x><loc>no</loc></x><loc> https://h/1 </loc></url><loc>stray</loc></urlset>",
        "deep": "<urlset>" + "<a>" * 5000 + "</a>" * 5000 + "<url><loc>https://h/2</loc></url></urlset>", "tags": "<urlset><url><loc>https://h/<b>3</b></loc></url></urlset>", "cut": f"<urlset>{many}",
        "upper": "<SITEMAPINDEX><LOC>https://h/i</LOC><Loc/></SITEMAPINDEX>", "two": "<urlset/><urlset/>",
    }
    df = spark.createDataFrame([("h", k, v) for k, v in bodies.items()] + [(None, "nested", bodies["nested"])], "host string, url string, body string")
    got = {}
    for r in sitemap_xml.sitemap_urls(df.repartition(3)).where("host is not null").collect():
        got.setdefault(r.file, []).append((r.kind, r.loc, r.error))
    kinds = {k: {x[0] for x in v} for k, v in got.items()}
    broken = {"null", "blank", "text", "laughs", "cut", "two"}
    assert {k for k, v in kinds.items() if v == {"broken"}} == broken and all(x[1] is None and x[2] for k in broken for x in got[k])
    locs = {k: [x[1] for x in v] for k, v in got.items()}
    assert locs["declared"] == ["https://h/é"] and len(locs["many"]) == 25_000 and locs["many"][-1] == "https://h/24999" and locs["nested"] == ["https://h/1"]
    assert locs["deep"] == ["https://h/2"] and locs["tags"] == ["https://h/3"] and locs["upper"] == ["https://h/i"] and locs["outside"] == ["ab"] and kinds["upper"] == {"index"}
    assert sitemap_xml.parse(df.where("url = 'many'")).count() == 3
    assert {(r.file, r.code, r.n) for r in sitemap_xml.sitemap_problems(df.where("url in ('many', 'text', 'blank')"), 20_000).collect()} == {("many", "SITEMAP_URL_LIMIT_REACHED", 25_000), ("text", "SITEMAP_XML_PARSE_ERROR", 1), ("blank", "SITEMAP_XML_ERROR", 1)}
    assert not sitemap_xml.sitemap_urls(df.limit(0)).collect()


# --- crawl budget and redirects


def test_a_trap_host_ends(spark):
    """A calendar that always leads on, and a small host beside it."""
    edges = [("trap", f"/{k}", f"/{k + 1}") for k in range(3000)] + [("trap", f"/{k}", f"/x{k}") for k in range(3000)] + [("small", "/0", "/1"), ("small", "/1", "/0"), ("small", "/1", "/2")]
    made = graph.frontier(spark.createDataFrame(edges, "host string, src string, dst string"), spark.createDataFrame([("trap", "/0"), ("small", "/0"), ("alone", "/0")], "host string, url string"), max_pages=6)
    got = {}
    for r in made.collect():
        got.setdefault(r.host, {})[r.url] = r.depth
    assert got == {"trap": {"/0": 0, "/1": 1, "/x0": 1, "/2": 2, "/x1": 2, "/3": 3}, "small": {"/0": 0, "/1": 1, "/2": 2}, "alone": {"/0": 0}}
    starts = spark.createDataFrame([("h", f"/{k}") for k in range(9)], "host string, url string")
    assert sorted(r.url for r in graph.frontier(spark.createDataFrame(edges, "host string, src string, dst string"), starts, max_pages=4).collect()) == ["/0", "/1", "/2", "/3"]
    assert not graph.frontier(spark.createDataFrame(edges, "host string, src string, dst string"), starts.limit(0)).collect()


def test_redirect_pointers_equal_steps(spark):
    draw = random.Random(6)
    hops = [(f"c{n}-{k}", f"c{n}-{k + 1}") for n in range(16) for k in range(n)] + [("l0", "l1"), ("l1", "l2"), ("l2", "l0"), ("self", "self"), ("in", "l1"), (None, "x"), ("c3-3", None)]
    hops += [(f"r{draw.randrange(40)}", f"r{draw.randrange(40)}") for _ in range(40)]
    to = {}
    for a, b in hops:
        if a is not None and b is not None:
            to[a] = min(to.get(a, b), b)
    starts = sorted({x for h in hops for x in h if x}) + ["nowhere", "nowhere"]
    for limit in (0, 1, 5, 10, 16):
        want = {}
        for s in starts:
            at, n = s, 0
            while n < limit and at in to:
                at, n = to[at], n + 1
            want[s] = (at, n, at in to)
        made = graph.resolve_redirects(spark.createDataFrame(hops, "from_url string, location string"), spark.createDataFrame([(s,) for s in starts], "url string"), limit)
        rows = made.collect()
        assert {r.url: (r.final_url, r.hops, r.too_many) for r in rows} == want and len(rows) == len(want)


# --- near pairs


def hashes(n, seed, width=64):
    """Close families, all with one band in common if width is small."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 62, max(1, n // 6))
    if width < 64:
        base = base >> np.int64(64 - width) << np.int64(16) | 0xBEEF
    values = base[rng.integers(0, len(base), n)]
    for _ in range(5):
        values = values ^ np.where(rng.random(n) < 0.6, np.int64(1) << rng.integers(16, 62, n), 0)
    return values


def brute(rows):
    best = {}
    for i, (h, seq, v) in enumerate(rows):
        found = [((v ^ w) & (2**64 - 1), s) for g, s, w in rows if g == h and s < seq]
        found = [(bin(x).count("1"), s) for x, s in found if any(not x >> 16 * k & 0xFFFF for k in range(4))]
        if found and min(found)[0] <= 5:
            best[h, seq] = min(found)
    return best


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_near_pairs_by_blocks_equal_all_pairs(spark, block):
    rows = [("h", k, int(v)) for k, v in enumerate(hashes(250, 1, 24))] + [("g", k, int(v)) for k, v in enumerate(hashes(120, 2))] + [(None, k, int(v)) for k, v in enumerate(hashes(60, 3, 24))] + [("", k, 5) for k in range(4)]
    df = spark.createDataFrame(rows + rows[:20] + [("h", None, 5), ("h", 9000, None)], "host string, seq bigint, simhash bigint").repartition(5)
    made = near_blocks.near_pairs(df, block=block).collect()
    want = brute(rows)
    assert {(r.host, r.seq): (r.distance, r.other) for r in made} == want and len(made) == len(want) and len(want) > 100
    assert not near_blocks.near_pairs(df.limit(0)).collect()


def test_a_full_bucket_gives_a_row_for_each_hash_at_most(spark):
    values = np.unique(hashes(60_000, 4, 40))
    df = spark.createDataFrame([("h", k, int(v)) for k, v in enumerate(values)], "host string, seq bigint, simhash bigint")
    made = near_blocks.near_pairs(df).collect()
    assert 0 < len(made) <= len(values) and len({r.seq for r in made}) == len(made)
    draw = random.Random(1)
    for r in draw.sample(made, 50):
        apart = np.bitwise_count((values[: r.seq] ^ values[r.seq]).view(np.uint64))
        assert r.distance == apart.min() and r.other == int(np.flatnonzero(apart == apart.min())[0])


def test_registered_rules_have_branches(spark):
    made = view(spark, SF, "robots_many")
    assert made.groupBy("host").count().agg({"count": "max"}).first()[0] > 3
