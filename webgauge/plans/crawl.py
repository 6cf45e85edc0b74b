"""Queries over fetches, links, redirects and probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import checks, content, extract, graph
from ..sources import shared
from . import duck as d
from .fixtures import view
from .pages import CANONICAL, HEAD, IMAGES, OUTGOING, LINKS, LAST, SEGMENTS  # noqa: F401
from .registry import query


@query("SELECT host, scheme, status_code, body FROM robots_files")
def s5_w1_pick_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = view(spark, sf_dir, "robots_files")
    plain = files.withColumn("scheme", F.lit("http")).withColumn("body", F.lit(""))
    return shared.pick_robots(plain.unionByName(files))


@query("SELECT seq, url FROM (SELECT page_id AS seq, url FROM pages ORDER BY 1 LIMIT 20 OFFSET 10) x")
def s7_paged_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.paged(view(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), "url"), 10, 20)


@query("SELECT p.page_id, f.status_code, CASE WHEN f.seq IS NULL THEN 'NOT_CHECKED_YET' END AS error FROM pages p LEFT JOIN (SELECT * FROM fetches WHERE seq % 3 <> 0) f ON p.page_id = f.seq")
def s8_results_with_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = view(spark, sf_dir, "pages").select("page_id", F.col("page_id").alias("url"))
    results = view(spark, sf_dir, "fetches").where("seq % 3 <> 0").select(F.col("seq").alias("url"), "status_code")
    return graph.with_results(found, results).drop("url")


EDGES = f"SELECT host, {d.normalize('src', force_https=True)} AS src, {d.normalize('dst', force_https=True)} AS dst FROM site_edges"
DISCOVERED = f"SELECT DISTINCT host, {d.normalize('url', force_https=True)} AS url FROM pages_ext UNION SELECT host, dst FROM (SELECT page_id, host, {d.normalize('(' + d.resolve('url', 'ref') + ')', force_https=True)} AS dst FROM raw_links WHERE NOT regexp_matches(ref, {d.q(urls.NOT_A_LINK)})) l WHERE dst IS NOT NULL"
INBOUND = f"SELECT d.host, d.url, coalesce(n, 0) AS inbound FROM discovered d LEFT JOIN (SELECT host, dst, count(*) AS n FROM (SELECT DISTINCT host, {d.normalize('url', force_https=True)} AS src, {d.normalize('(' + d.resolve('url', 'ref') + ')', force_https=True)} AS dst FROM raw_links WHERE NOT regexp_matches(ref, {d.q(urls.NOT_A_LINK)})) e GROUP BY ALL) c ON d.host = c.host AND d.url = c.dst WHERE coalesce(n, 0) < 5 AND (len({SEGMENTS}) <= 1 OR starts_with(lower({SEGMENTS}[-1]), 'index.')) QUALIFY row_number() OVER (PARTITION BY d.host ORDER BY coalesce(n, 0), d.url) <= 200"


@query(INBOUND, discovered=DISCOVERED, raw_links=LINKS)
def j1_a7_inbound_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = view(spark, sf_dir, "pages_ext")
    links = shared.materialize(extract.links(pages).select("host", "src", "dst").distinct())
    found = pages.select("host", urls.graph_url(F.col("url")).alias("url")).unionByName(links.select("host", F.col("dst").alias("url"))).where("url is not null").distinct()
    return graph.inbound(links, found)


IMAGE_ROWS = f"SELECT DISTINCT host, page_id, {d.normalize('(' + d.resolve('url', '(' + d.attr('tag', 'src') + ')') + ')', keep_slash=True)} AS image FROM raw_images"
IMAGE_COUNTS = "SELECT host, image, count(*) AS n FROM image_rows WHERE image IS NOT NULL GROUP BY ALL"


@query("SELECT p.host, count(*) AS pages, count(*) FILTER (u IS NULL) AS without_images, count(*) FILTER (u = 0) AS without_unique, count(*) FILTER (r = 0) AS without_rare, any_value(i.images) AS images FROM pages_ext p LEFT JOIN (SELECT page_id, max(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS u, max(CASE WHEN n < 10 THEN 1 ELSE 0 END) AS r FROM image_rows JOIN image_counts USING (host, image) GROUP BY page_id) x USING (page_id) LEFT JOIN (SELECT host, count(*) AS images FROM image_counts GROUP BY host) i ON i.host = p.host GROUP BY p.host", raw_images=IMAGES, image_rows=IMAGE_ROWS, image_counts=IMAGE_COUNTS)
def j2_a6_image_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = view(spark, sf_dir, "pages_ext")
    return graph.image_use(extract.images(pages), pages)


WALK = {
    "starts": "SELECT host, lower(min_by(url, page_id)) AS url FROM pages_ext GROUP BY host",
    "sizes": "SELECT host, count(*) AS n FROM pages_ext GROUP BY host",
    "steps": "SELECT DISTINCT e.host, lower(src) AS src, lower(dst) AS dst, n FROM site_edges e JOIN sizes USING (host)",
    "walk": "SELECT host, url, 0 AS depth FROM starts UNION SELECT s.host, s.dst, w.depth + 1 FROM walk w JOIN steps s ON w.host = s.host AND w.url = s.src WHERE w.depth < s.n",
    "depths": "SELECT host, url, min(depth) AS depth FROM walk GROUP BY host, url",
}


def _starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "pages_ext").groupBy("host").agg(F.min_by("url", "page_id").alias("url"))


@query("SELECT host, url, depth FROM depths QUALIFY row_number() OVER (PARTITION BY host ORDER BY depth, url) <= 1000", **WALK)
def j7_a15_crawl_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To the end: no bound on depth."""
    return graph.frontier(view(spark, sf_dir, "site_edges"), _starts(spark, sf_dir))


@query("SELECT host, url, depth FROM depths QUALIFY row_number() OVER (PARTITION BY host ORDER BY depth, url) <= 4", **WALK)
def j7_crawl_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget of four pages, which many hosts use up."""
    return graph.frontier(view(spark, sf_dir, "site_edges"), _starts(spark, sf_dir), max_pages=4)


@query("SELECT DISTINCT host, lower(host) AS ascii FROM pages_ext UNION ALL SELECT DISTINCT 'пример.' || host, 'xn--e1afmkfd.' || lower(host) FROM pages_ext")
def u13_ascii_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = view(spark, sf_dir, "pages_ext").select("host")
    return urls.ascii_hosts(hosts.unionByName(hosts.select(F.concat(F.lit("пример."), "host").alias("host"))))


HOP = "SELECT from_url, min(location) AS location FROM redirects GROUP BY from_url"
LONG_HOP = "SELECT from_url, min(location) AS location FROM hop_chains GROUP BY from_url UNION ALL SELECT from_url, location FROM hop WHERE from_url NOT IN (SELECT from_url FROM hop_chains)"


def _followed(hop: str, starts: str) -> dict[str, str]:
    """Chains hop by hop, to the eleventh at most."""
    return {"ways": f"SELECT DISTINCT url, url AS place, 0 AS n FROM ({starts}) s UNION ALL SELECT w.url, h.location, w.n + 1 FROM ways w JOIN {hop} h ON w.place = h.from_url WHERE w.n < 11", "ends": "SELECT url, arg_max(place, n) FILTER (n <= 10) AS final_url, max(n) FILTER (n <= 10) AS hops, max(n) > 10 AS too_many FROM ways GROUP BY url"}


@query("SELECT * FROM ends", hop=HOP, **_followed("hop", "SELECT original_url AS url FROM fetches"))
def j8_redirect_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.resolve_redirects(view(spark, sf_dir, "redirects"), view(spark, sf_dir, "fetches").select(F.col("original_url").alias("url")))


@query("SELECT * FROM ends", hop=HOP, long_hop=LONG_HOP, **_followed("long_hop", "SELECT from_url AS url FROM hop_chains UNION ALL SELECT original_url FROM fetches"))
def j8_redirect_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of up to thirteen hops, and loops."""
    chains = view(spark, sf_dir, "hop_chains")
    rest = view(spark, sf_dir, "redirects").join(chains.select("from_url").hint("shuffle_merge"), "from_url", "left_anti")
    starts = chains.select(F.col("from_url").alias("url")).unionByName(view(spark, sf_dir, "fetches").select(F.col("original_url").alias("url")))
    return graph.resolve_redirects(chains.select("from_url", "location").unionByName(rest.select("from_url", "location")), starts)


@query("SELECT DISTINCT host, 'DOMAIN_VARIANTS_PROBLEM' AS code FROM pages_ext")
def j9_domain_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.domain_variants(view(spark, sf_dir, "pages_ext").select("host").distinct(), view(spark, sf_dir, "redirects"))


@query("SELECT host AS wanted, count(*) AS n FROM fetches GROUP BY host")
def j13_alias_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = view(spark, sf_dir, "fetches")
    return graph.alias_host(f, f.select("host")).groupBy("wanted").agg(F.count("*").alias("n"))


@query(f"SELECT c.host, count(*) AS pages, count(*) FILTER (len(canonicals) > 0) AS with_canonical, count(*) FILTER (len(canonicals) > 1) AS multiple, count(*) FILTER ({d.host('target')} <> c.host) AS cross_domain FROM canonical c GROUP BY c.host", canonical=CANONICAL, head=HEAD)
def a3_canonical_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = checks.canonical_facts(view(spark, sf_dir, "pages_ext"))
    n = F.size("canonicals")
    return c.groupBy("host").agg(F.count("*").alias("pages"), F.count_if(n > 0).alias("with_canonical"), F.count_if(n > 1).alias("multiple"), F.count_if(urls.host(F.col("target")) != F.col("host")).alias("cross_domain"))


@query("SELECT f.host, count(DISTINCT original_url) AS noindex FROM fetches f JOIN head h ON f.seq = h.page_id WHERE coalesce(contains(x_robots_tag, 'noindex'), false) OR len(h.noindex) > 0 GROUP BY f.host", head=HEAD)
def a4_noindex_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = view(spark, sf_dir, "fetches").select("host", F.col("original_url").alias("url"), "x_robots_tag", extract.metas(F.col("html")).alias("metas"))
    hit = f.where(checks.noindex_header() | checks.noindex_meta())
    return hit.groupBy("host").agg(F.count_distinct("url").alias("noindex"))


@query(f"SELECT p.host, count(DISTINCT p.page_id) AS pages, count(tag) AS images, count(tag) FILTER (trim(coalesce({d.attr('tag', 'alt')}, '')) = '' AND NOT regexp_matches(lower({d.attr('tag', 'src')}), '(^data:image|\\.svg(\\?|$))')) AS empty_alt FROM pages_ext p LEFT JOIN raw_images i USING (page_id) GROUP BY p.host", raw_images=IMAGES)
def a5_images_meta_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.image_meta(view(spark, sf_dir, "pages_ext")).groupBy("host").agg(F.count("*").alias("pages"), F.sum("images").alias("images"), F.sum("empty_alt").alias("empty_alt"))


@query("SELECT host, count(*) AS pages, count(*) FILTER (internal = 0) AS no_internal, count(*) FILTER (internal > 200) AS many_internal, count(*) FILTER (external > 0) AS any_external FROM outgoing o JOIN pages_ext p USING (page_id) GROUP BY host", outgoing=OUTGOING, raw_links=LINKS)
def a8_outgoing_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = checks.outgoing(view(spark, sf_dir, "pages_ext"))
    return o.groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("internal") == 0).alias("no_internal"), F.count_if(F.col("internal") > 200).alias("many_internal"), F.count_if(F.col("external") > 0).alias("any_external"))


@query("SELECT host, count(*) AS pages, avg(load_seconds) AS avg_seconds, max(load_seconds) AS max_seconds, count(*) FILTER (load_seconds >= 3) AS slow, arg_max(original_url, load_seconds) FILTER (load_seconds >= 3) AS slowest FROM (SELECT * FROM fetches ORDER BY host, load_seconds DESC, original_url) f GROUP BY host")
def a9_w4_performance_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.performance(view(spark, sf_dir, "fetches"))


@query("SELECT host, CAST(sum(n) AS BIGINT) AS pages, count(*) AS kinds, (list(content_length ORDER BY n DESC, content_length))[1] AS top_length, max(n) AS top_count, sum(n) >= 50 AND max(n) / sum(n) >= 0.75 AS suspicious FROM (SELECT host, content_length, count(*) AS n FROM fetches GROUP BY ALL) x GROUP BY host")
def a10_a11_content_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.content_lengths(view(spark, sf_dir, "fetches"))


@query("SELECT *, CASE WHEN ok_percent < 60 THEN 'SITE_AVAILABILITY_LOW' WHEN ok_percent < 100 THEN 'SITE_AVAILABILITY_UNSTABLE' END AS code FROM (SELECT host, count(*) AS probes, round_even(100.0 * count(*) FILTER (status_code BETWEEN 200 AND 399) / count(*), 0) AS ok_percent, avg(load_seconds) AS avg_seconds FROM probes GROUP BY host) x")
def a16_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.availability(view(spark, sf_dir, "probes"))


@query("SELECT *, CASE WHEN n < 2 THEN 'DOC_SIZE_CHECK_FAILED' WHEN largest - least > 2048 THEN 'DOC_SIZE_UNSTABLE' END AS code FROM (SELECT url, count(*) AS n, min(body_size) AS least, max(body_size) AS largest FROM probes GROUP BY url) x")
def a17_size_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.size_stability(view(spark, sf_dir, "probes"))


@query("SELECT code, count(*) AS n FROM (SELECT CASE WHEN status_code IN (404, 410) THEN NULL WHEN status_code = 200 THEN 'SOFT_404' ELSE 'FAKE_404_NOT_OK' END AS code FROM probes) x GROUP BY code")
def a18_soft_404(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.soft_404(view(spark, sf_dir, "probes")).groupBy("code").agg(F.count("*").alias("n"))


@query("SELECT host, page_id, url FROM pages_ext QUALIFY row_number() OVER (PARTITION BY host ORDER BY page_id) <= 3")
def w2_w3_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.top_samples(view(spark, sf_dir, "pages_ext"), 3, "page_id").select("host", "page_id", "url")


@query("SELECT lower(url) AS folded, arg_min(url, page_id) AS url FROM (SELECT page_id, url FROM pages UNION ALL SELECT page_id + 100000, upper(url) FROM pages) u GROUP BY 1")
def w8_case_insensitive_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "pages").select("page_id", "url")
    return graph.first_by_key(p.unionByName(p.select((F.col("page_id") + 100000).alias("page_id"), F.upper("url").alias("url"))), "url", "page_id")


@query("SELECT host, time_bucket(INTERVAL 10 MINUTE, ts) AS start, count(*) AS n, count(*) FILTER (status_code BETWEEN 200 AND 399) AS ok FROM probes GROUP BY ALL")
def st4_probe_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import streams

    return streams.probe_windows(view(spark, sf_dir, "probes"), "10 minutes").withColumn("start", F.col("start").cast("timestamp_ntz"))
