"""Queries for whole reports by host: counters with lists of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, extract, reports
from . import duck as d
from .crawl import IMAGE_COUNTS, IMAGE_ROWS
from .fixtures import view
from .pages import CANONICAL, HEAD, IMAGES, LINKS, NO_SCHEME, OUTGOING
from .registry import query


def _list(value: str, order: str, n: int, where: str = "true") -> str:
    return f"coalesce(array_to_string((list({value} ORDER BY {order}) FILTER ({where}))[1:{n}], ' '), '')"


def _flags(flags: dict[str, str]) -> str:
    return ", ".join(f"count(*) FILTER ({c}) AS {k}" for k, c in flags.items())


HEADER = "coalesce(contains(x_robots_tag, 'noindex'), false)"
CANON_CODES = f"SELECT c.page_id, max(CASE WHEN f.status_code >= 400 THEN 'error' ELSE 'blocked' END) AS code FROM canonical c JOIN fetches f ON {d.normalize('c.target')} = {d.normalize('f.original_url')} WHERE f.status_code >= 400 OR {HEADER} GROUP BY c.page_id"
CANON_ROWS = f"SELECT c.page_id, c.host, c.url, len(canonicals) AS n, coalesce({NO_SCHEME}, false) AS bare, trim(first) AS first, {d.host('target')} AS other, code, regexp_matches(html, '(?is)<body.*<link[^>]*rel=\"[^\"]*canonical') AS in_body FROM canonical c JOIN pages_ext USING (page_id) LEFT JOIN canon_codes USING (page_id)"
CANON_FLAGS = {
    "with_canonical": "n > 0", "multiple": "n > 1", "in_body": "in_body", "missing_scheme": "bare", "cross_domain": "NOT bare AND other <> host", "target_http_errors": "code = 'error'", "target_blocked": "code = 'blocked'",
    "invalid": "n > 0 AND first <> '' AND other IS NULL",
}


@query("SELECT host, count(*) AS pages, " + _flags(CANON_FLAGS) + "".join(f", {_list('url', 'page_id', 50, CANON_FLAGS[k])} AS {k}_urls" for k in ("invalid", "target_http_errors", "target_blocked", "cross_domain")) + " FROM canon_rows GROUP BY host", canon_rows=CANON_ROWS, canon_codes=CANON_CODES, canonical=CANONICAL, head=HEAD)
def a3_canonical_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.canonical_report(view(spark, sf_dir, "pages_ext"), view(spark, sf_dir, "fetches"), checks.noindex_header())


@query(f"SELECT host, count(*) AS noindex, {_list('url', 'url', 200)} AS urls FROM (SELECT DISTINCT f.host, f.original_url AS url FROM fetches f JOIN head h ON f.seq = h.page_id WHERE {HEADER} OR len(h.noindex) > 0) x GROUP BY host", head=HEAD)
def a4_noindex_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = view(spark, sf_dir, "fetches").select("host", F.col("original_url").alias("url"), "x_robots_tag", extract.metas(F.col("html")).alias("metas"))
    return reports.noindex_report(f.where(checks.noindex_header() | checks.noindex_meta()))


META_ROWS = f"SELECT p.page_id, any_value(p.host) AS host, any_value(p.url) AS url, count(tag) AS images, count(tag) FILTER (trim(coalesce({d.attr('tag', 'alt')}, '')) = '' AND NOT regexp_matches(lower({d.attr('tag', 'src')}), '(^data:image|\\.svg(\\?|$))')) AS empty_alt, count(tag) FILTER (trim(coalesce({d.attr('tag', 'title')}, '')) = '') AS empty_title FROM pages_ext p LEFT JOIN raw_images i ON p.page_id = i.page_id GROUP BY p.page_id"


@query(f"SELECT host, count(*) AS pages, CAST(sum(images) AS BIGINT) AS images, avg(images) AS avg_images, CAST(sum(empty_alt) AS BIGINT) AS empty_alt, CAST(sum(empty_title) AS BIGINT) AS empty_title, {_list('url', 'empty_alt DESC, url', 200, 'empty_alt > 0')} AS empty_alt_urls, {_list('url', 'empty_title DESC, url', 200, 'empty_title > 0')} AS empty_title_urls FROM meta_rows GROUP BY host", meta_rows=META_ROWS, raw_images=IMAGES)
def a5_image_meta_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.image_meta_report(view(spark, sf_dir, "pages_ext"))


OUT_FLAGS = {"no_internal": "internal = 0", "many_internal": "internal > 200", "any_external": "external > 0"}


@query(f"SELECT host, count(*) AS pages, {_flags(OUT_FLAGS)}, {_list('url', 'url', 200, 'internal = 0')} AS no_internal_urls, {_list('url', 'internal DESC, url', 200, 'internal > 200')} AS many_internal_urls, {_list('url', 'external DESC, url', 200, 'external > 0')} AS any_external_urls FROM outgoing JOIN pages_ext USING (page_id) GROUP BY host", outgoing=OUTGOING, raw_links=LINKS)
def a8_outgoing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.outgoing_report(view(spark, sf_dir, "pages_ext"))


@query(f"SELECT host, count(*) AS pages, avg(load_seconds) AS avg_seconds, max(load_seconds) AS max_seconds, count(*) FILTER (load_seconds >= 3) AS slow, (list(original_url ORDER BY load_seconds DESC, original_url) FILTER (load_seconds >= 3))[1] AS slowest, {_list('original_url', 'load_seconds DESC, original_url', 200)} AS slow_pages FROM fetches GROUP BY host")
def a9_performance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.performance_report(view(spark, sf_dir, "fetches"))


@query(
    f"SELECT host, pages, kinds, top_length, top_count, top_count / pages AS top_share, pages >= 50 AND top_count / pages >= 0.75 AS suspicious, CASE WHEN pages >= 50 AND top_count / pages >= 0.75 THEN 'CONTENT_LENGTH_UNIFORMITY' END AS code, histogram FROM (SELECT host, CAST(sum(n) AS BIGINT) AS pages, count(*) AS kinds, (list(content_length ORDER BY n DESC, content_length))[1] AS top_length, max(n) AS top_count, {_list('content_length || chr(58) || n', 'n DESC, content_length', 20)} AS histogram FROM lengths GROUP BY host) x",
    lengths="SELECT host, content_length, count(*) AS n FROM fetches WHERE content_length > 0 GROUP BY ALL",
)
def a10_length_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.length_report(view(spark, sf_dir, "fetches"))


USE_FLAGS = {"without_images": "u IS NULL", "without_unique": "u = 0", "without_rare": "r = 0"}
USE_LISTS = "".join(f", {_list('url', 'url', 100, c)} AS {k}_urls" for k, c in USE_FLAGS.items())
USE = "SELECT p.host, p.url, u, r FROM pages_ext p LEFT JOIN (SELECT page_id, max(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS u, max(CASE WHEN n < 10 THEN 1 ELSE 0 END) AS r FROM image_rows JOIN image_counts USING (host, image) GROUP BY page_id) x USING (page_id)"
SHARED = f"SELECT host, count(*) AS images, {_list('image || chr(61) || n', 'n DESC, image', 50)} AS most_shared FROM image_counts GROUP BY host"


@query(f"SELECT u.*, coalesce(s.images, 0) AS images, coalesce(s.most_shared, '') AS most_shared FROM (SELECT host, count(*) AS pages, {_flags(USE_FLAGS)}{USE_LISTS} FROM image_use GROUP BY host) u LEFT JOIN shared s USING (host)", image_use=USE, shared=SHARED, raw_images=IMAGES, image_rows=IMAGE_ROWS, image_counts=IMAGE_COUNTS)
def j2_a6_image_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = view(spark, sf_dir, "pages_ext")
    return reports.image_use_report(extract.images(pages), pages)
