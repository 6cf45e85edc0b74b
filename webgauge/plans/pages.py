"""Queries over pages and fetches: extraction and page checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import checks, extract
from . import duck as d
from .fixtures import view
from .registry import query

CHECKABLE = f"NOT regexp_matches(ref, {d.q(urls.NOT_A_LINK)})"


@query("SELECT url, substr(html, 1, 2000) AS html, length(html) > 2000 AS truncated FROM pages")
def s2_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.truncate(view(spark, sf_dir, "pages"), 2000).select("url", "html", "truncated")


@query("SELECT CASE WHEN status_code < 200 OR status_code >= 300 THEN 'http_error' WHEN NOT contains(lower(content_type), 'html') THEN 'non_html' ELSE 'html' END AS class, count(*) AS n FROM fetches GROUP BY 1")
def s3_accept_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.accept(view(spark, sf_dir, "fetches")).groupBy("class").agg(F.count("*").alias("n"))


@query(f"SELECT url, {d.normalize('url', True, keep_query=True)} AS crawl, {d.normalize('url', keep_slash=True)} AS image, {d.normalize('url', force_https=True)} AS graph, {d.normalize('url')} AS sitemap, regexp_replace({d.normalize('url', force_https=True)}, '^https://(www\\.)?', '') AS canon FROM variants", variants="SELECT url FROM pages UNION ALL SELECT upper(url) FROM pages UNION ALL SELECT regexp_replace(url, '^https?://', '') FROM pages UNION ALL SELECT regexp_replace(url, '^(https?://[^/]+)', '\\1:443') || '/' FROM pages UNION ALL SELECT 'www. bad url'")
def u1_u5_normalize_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = view(spark, sf_dir, "pages").select("url")
    made = url.unionByName(url.select(F.upper("url").alias("url"))).unionByName(url.select(F.regexp_replace("url", "^https?://", "").alias("url")))
    made = made.unionByName(url.select(F.concat(F.regexp_replace("url", "^(https?://[^/]+)", "$1:443"), F.lit("/")).alias("url"))).unionByName(spark.sql("SELECT 'www. bad url' AS url"))
    u = F.col("url")
    return made.select("url", urls.crawl_url(u).alias("crawl"), urls.image_url(u).alias("image"), urls.graph_url(u).alias("graph"), urls.sitemap_url(u).alias("sitemap"), urls.canonical_key(u).alias("canon"))


LINKS = f"SELECT page_id, host, url, pos, trim({d.attr('tag', 'href')}) AS ref FROM (SELECT page_id, host, url, unnest(t) AS tag, unnest(range(len(t))) AS pos FROM (SELECT page_id, host, url, {d.tags('html', 'a')} AS t FROM pages_ext) x) y"


@query(f"SELECT page_id, host, CAST(pos AS INTEGER) AS pos, ref, {d.normalize('url', force_https=True)} AS src, {d.normalize('(' + d.resolve('url', 'ref') + ')', force_https=True)} AS dst FROM raw_links WHERE {CHECKABLE}", raw_links=LINKS)
def u6_u7_u14_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.links(view(spark, sf_dir, "pages_ext"))


SEGMENTS = f"list_filter(string_split({d.part('url', 4)}, '/'), lambda s: s <> '')"
LAST = f"lower(regexp_extract({d.part('url', 4)}, '([^/]*)$', 1))"


@query(
    f"SELECT url, len({SEGMENTS}) <= 1 OR starts_with(lower({SEGMENTS}[-1]), 'index.') AS landing, NOT contains({LAST}, '.') OR regexp_matches({LAST}, '\\.html?$') AS html, array_to_string(string_split(host, '.')[-2:], '.') AS root2, "
    f"CASE WHEN array_to_string(string_split(host, '.')[-2:], '.') IN ('co.uk', 'org.uk', 'gov.uk', 'ac.uk', 'com.au', 'net.au', 'org.au', 'co.jp', 'ne.jp', 'com.br', 'com.tr', 'com.cn', 'net.cn', 'org.cn') THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE array_to_string(string_split(host, '.')[-2:], '.') END AS domain, "
    "NOT regexp_matches(ref, '(?i)^(/|\\./|\\.\\./|#|https?:)') AND contains(ref, '.') AND NOT contains(ref, ' ') AS missing FROM (SELECT url, host, regexp_replace(url, '^https?://', '') AS ref FROM pages_ext UNION ALL SELECT 'https://a.b.co.uk/', 'a.b.co.uk', '/x') y"
)
def u8_u12_url_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = view(spark, sf_dir, "pages_ext").select("url", "host", F.regexp_replace("url", "^https?://", "").alias("ref")).unionByName(spark.sql("SELECT 'https://a.b.co.uk/' AS url, 'a.b.co.uk' AS host, '/x' AS ref"))
    u, h = F.col("url"), F.col("host")
    return made.select("url", urls.is_landing(u).alias("landing"), urls.looks_like_html(u).alias("html"), urls.root2(h).alias("root2"), urls.registrable_domain(h).alias("domain"), urls.missing_scheme(F.col("ref")).alias("missing"))


IMAGES = f"SELECT page_id, host, url, unnest(t) AS tag, unnest(range(len(t))) AS pos FROM (SELECT page_id, host, url, {d.tags('html', 'img')} AS t FROM pages_ext) x"


@query(f"SELECT page_id, CAST(pos AS INTEGER) AS pos, {d.attr('tag', 'src')} AS src, {d.attr('tag', 'alt')} AS alt, {d.attr('tag', 'title')} AS title, {d.normalize('(' + d.resolve('url', '(' + d.attr('tag', 'src') + ')') + ')', keep_slash=True)} AS image_url FROM raw_images", raw_images=IMAGES)
def u15_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.images(view(spark, sf_dir, "pages_ext")).select("page_id", "pos", "src", "alt", "title", "image_url")


def _refs(kind: str, tag: str, name: str) -> str:
    ref = f"trim({d.attr('t', name)})"
    sheet = f"AND contains(lower({d.attr('t', 'rel')}), 'stylesheet')" if kind == "css" else ""
    return f"SELECT page_id, host, url, '{kind}' AS kind, list_transform(list_filter({d.tags('html', tag)}, lambda t: coalesce(NOT regexp_matches({ref}, {d.q(urls.NOT_A_RESOURCE)}) {sheet}, false)), lambda t: {ref})[1:15] AS refs FROM pages_ext"


RESOURCES = f"SELECT page_id, host, kind, CAST(pos AS INTEGER) AS pos, {d.resolve('url', 'ref')} AS target FROM (SELECT page_id, host, url, kind, unnest(refs) AS ref, unnest(range(len(refs))) AS pos FROM ({' UNION ALL '.join(_refs(k, *v) for k, v in extract.KINDS.items())}) a) b"


@query("SELECT * FROM resources", resources=RESOURCES)
def u16_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.resources(view(spark, sf_dir, "pages_ext"))


EXTERNAL = f"SELECT DISTINCT page_id, host, external FROM (SELECT page_id, host, {d.host('ref')} AS external, ref FROM (SELECT page_id, host, coalesce({d.attr('tag', 'href')}, {d.attr('tag', 'src')}) AS ref FROM (SELECT page_id, host, unnest({d.tags('html', 'a|img|script|link|iframe')}) AS tag FROM pages_ext) a) b) c WHERE regexp_matches(ref, '(?i)^\\s*https?://') AND external <> host"


@query("SELECT * FROM external", external=EXTERNAL)
def u17_external_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.external_hosts(view(spark, sf_dir, "pages_ext"))


def _inner(tag: str) -> str:
    stripped = f"regexp_replace(s, '<[^>]*>', '', 'g')"
    return f"list_transform(regexp_extract_all(html, '(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>', 1), lambda s: trim(regexp_replace({d.entities(stripped)}, {d.q(text.SPACE)}, ' ', 'g')))"


def _descriptions() -> str:
    value = d.entities(f"coalesce({d.attr('t', 'content')}, '')")
    return f"list_filter(list_transform(list_filter({d.tags('html', 'meta')}, lambda t: coalesce(lower({d.attr('t', 'name')}) = 'description', false)), lambda t: trim(regexp_replace({value}, {d.q(text.SPACE)}, ' ', 'g'))), lambda x: x <> '')"


HEAD = (
    f"SELECT *, coalesce(titles[1], '') AS title, coalesce(h1s[1], '') AS h1, coalesce(descriptions[1], '') AS description FROM (SELECT page_id, host, url, html, {_inner('title')} AS titles, {_inner('h1')} AS h1s, {_descriptions()} AS descriptions, "
    f"list_transform(list_filter({d.tags('html', 'link')}, lambda t: coalesce(contains(lower({d.attr('t', 'rel')}), 'canonical'), false)), lambda t: coalesce({d.attr('t', 'href')}, '')) AS canonicals, "
    f"list_filter({d.tags('html', 'meta')}, lambda t: coalesce(lower({d.attr('t', 'name')}) IN ('robots', 'googlebot', 'yandex') AND contains(lower({d.attr('t', 'content')}), 'noindex'), false)) AS noindex, "
    "lower(regexp_extract(html, '(?i)<!doctype\\s+([^>]*)>', 1)) AS doctype FROM pages_ext) h"
)


@query("SELECT page_id, len(titles) AS n_titles, title, h1, len(h1s) AS n_h1s, description, len(canonicals) AS n_canonicals, doctype FROM head", head=HEAD)
def u18_head_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = lambda c: F.size(c).cast("bigint").alias(f"n_{c}")
    return checks.seo_facts(view(spark, sf_dir, "pages_ext")).select("page_id", size("titles"), "title", "h1", size("h1s"), "description", size("canonicals"), "doctype")


def _flat(body: str = "regexp_replace(html, '(?is)^.*<body[^>]*>', '')", decode: Callable[[str], str] = d.entities) -> str:
    for tag in extract.HIDDEN.split("|"):
        body = f"regexp_replace({body}, '(?is)<{tag}(\\s[^>]*)?>.*?</{tag}>', ' ', 'g')"
    bare = f"regexp_replace(regexp_replace({body}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
    return f"trim(regexp_replace({decode(bare)}, {d.q(text.SPACE)}, ' ', 'g'))"


FLAT = f"SELECT page_id, host, url, html, {_flat()} AS visible FROM pages_ext"
#: All pages have one article, in which nothing hidden nests.  The parser reads references without a semicolon too, as titles that were cut have them.
ROOTED = f"SELECT page_id, host, url, html, {_flat("regexp_extract(html, '(?s)<article>(.*)</article>', 1)", d.references)} AS visible FROM pages_ext"


@query("SELECT page_id, visible FROM flat", flat=FLAT)
def u19_visible_text_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "pages_ext").select("page_id", extract.visible_text_flat(F.col("html")).alias("visible"))


@query("SELECT page_id, visible AS visible_text, NULL AS error FROM rooted", rooted=ROOTED)
def u19_p26_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.visible_text(view(spark, sf_dir, "pages_ext"))


@query(f"SELECT doc_id, {d.fold('text')} AS folded, len(string_split({d.fold('text')}, ' ')) AS words, len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nd}}]{{2,}}')) AS tokens, CASE WHEN length(flat) > 200 THEN substr(flat, 1, 200) || '…' ELSE flat END AS preview FROM (SELECT doc_id, text, trim(regexp_replace(text, '[\\r\\n]+', ' ', 'g')) AS flat FROM documents) t")
def u20_u23_text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return view(spark, sf_dir, "documents").select("doc_id", text.fold(t).alias("folded"), text.word_count(t).cast("bigint").alias("words"), F.size(text.tokenize(t)).cast("bigint").alias("tokens"), text.preview(t, 200).alias("preview"))


def _same(a: str, b: str) -> str:
    return f"{a} <> '' AND lower({a}) = lower({b})"


#: Meta tags that describe a page, an empty text included.
DESCRIBED = f"len(list_filter({d.tags('html', 'meta')}, lambda t: coalesce(lower({d.attr('t', 'name')}) = 'description' AND ({d.attr('t', 'content')}) IS NOT NULL, false)))"

SEO_RULES = {
    "SEO_MISSING_TITLE": "len(titles) = 0", "SEO_MULTIPLE_TITLE": "len(titles) > 1", "SEO_MISSING_DESCRIPTION": f"{DESCRIBED} = 0", "SEO_MULTIPLE_DESCRIPTION": f"{DESCRIBED} > 1",
    "NO_TITLE": "len(titles) = 0", "MULTI_TITLE": "len(titles) > 1", "NO_DESCRIPTION": "len(descriptions) = 0", "MULTI_DESCRIPTION": "len(descriptions) > 1", "NO_H1": "len(h1s) = 0", "H1_MULTIPLE": "len(h1s) > 1",
    "SEO_MISSING_H1": "len(h1s) = 0 OR h1 = ''", "HTML_DOCTYPE_MISSING": "doctype = ''", "HTML_DOCTYPE_NOT_HTML": "doctype <> '' AND NOT starts_with(doctype, 'html')",
    "SEO_TITLE_EQUALS_H1": _same("title", "h1"), "SEO_TITLE_EQUALS_DESCRIPTION": _same("title", "description"), "SEO_DESCRIPTION_EQUALS_H1": _same("description", "h1"),
    "SEO_TITLE_TOO_SHORT": "title <> '' AND len(string_split(title, ' ')) < 2", "SEO_DESCRIPTION_TOO_SHORT": "description <> '' AND len(string_split(description, ' ')) < 5", "SEO_DESCRIPTION_TOO_LONG": "length(description) > 320",
}


@query(d.issues("head", "seo", SEO_RULES, "page_id"), head=HEAD)
def p1_p6_seo_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.seo(view(spark, sf_dir, "pages_ext"))


@query(d.issues("fetches", "fetch", {
    "NO_HTTPS": ("starts_with(final_url, 'http://')", "Error"), "PORT_443_IN_URL": ("regexp_matches(original_url, '^http://[^/]+:443')", "Info"), "PORT_443_IN_FINAL_URL": ("regexp_matches(final_url, '^http://[^/]+:443')", "Info"),
    "HTTP_TO_HTTPS_REDIRECT": ("starts_with(original_url, 'http://') AND starts_with(final_url, 'https://')", "Info"), "NO_HTTP_TO_HTTPS_REDIRECT": "starts_with(original_url, 'http://') AND starts_with(final_url, 'http://')",
    "REDIRECT_OTHER_DOMAIN": "split_part(original_url, '/', 3) <> split_part(final_url, '/', 3)", "REDIRECT_TO_SUBDOMAIN": ("'www.' || split_part(original_url, '/', 3) = split_part(final_url, '/', 3)", "Info"),
    "URL_EXPLICIT_443": "regexp_matches(original_url, '^https?://[^/]+:443/?$')", "URL_NO_SCHEME": "NOT regexp_matches(original_url, '^https?://')", "PERF_SLOW_PAGE": "load_seconds >= 3.0",
    "BIG_PAGE": "status_code = 200 AND contains(content_type, 'html') AND content_length >= 2000000", "HTML_LARGE_PAGE": "status_code BETWEEN 200 AND 399 AND contains(content_type, 'html') AND content_length > 2000000", "HTTP_CLIENT_ERROR": "status_code BETWEEN 400 AND 499", "HTTP_SERVER_ERROR": ("status_code >= 500", "Error"),
}, "seq"))
def p3_p7_p8_p10_p11_p25_p27_p33_fetch_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.fetch_issues(view(spark, sf_dir, "fetches"))


@query(d.issues("pages_ext", "markup", {
    "MIXED_CONTENT": "starts_with(url, 'https://') AND (regexp_matches(html, '(?i)\\s(src|href)\\s*=\\s*[\"'']\\s*http://') OR regexp_matches(html, '(?i)\\sstyle\\s*=\\s*[\"''][^\"'']*http://') OR regexp_matches(html, '(?is)<style[^>]*>[^<]*http://'))",
    "HTML_LARGE_PAGE_BODY": "length(html) > 2000000", "IFRAME_PRESENT": ("regexp_matches(html, '(?i)<iframe[\\s>]')", "Info"), "SERVER_ERROR_LEAK": (f"regexp_matches(html, {d.q(checks.LEAKS)})", "Error"), "NO_DOCTYPE": "NOT contains(lower(html), '<!doctype')",
}, "page_id"))
def p3_p9_p28_p29_markup_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.markup(view(spark, sf_dir, "pages_ext"))


@query("SELECT f.seq, coalesce(contains(f.x_robots_tag, 'noindex'), false) AS by_header, len(h.noindex) > 0 AS by_meta FROM fetches f JOIN head h ON f.seq = h.page_id", head=HEAD)
def p12_noindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = view(spark, sf_dir, "fetches").select("seq", "x_robots_tag", extract.metas(F.col("html")).alias("metas"))
    return f.select("seq", checks.noindex_header().alias("by_header"), checks.noindex_meta().alias("by_meta"))


OUTGOING = f"SELECT p.page_id, count(ref) FILTER (h = l.host) AS internal, count(ref) FILTER (h <> l.host) AS external FROM pages_ext p LEFT JOIN (SELECT page_id, host, ref, {d.host('(' + d.resolve('url', 'ref') + ')')} AS h FROM raw_links WHERE {CHECKABLE}) l ON p.page_id = l.page_id GROUP BY p.page_id"


@query("SELECT * FROM outgoing", outgoing=OUTGOING, raw_links=LINKS)
def p14_p31_outgoing_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.outgoing(view(spark, sf_dir, "pages_ext")).select("page_id", F.col("internal").cast("bigint").alias("internal"), F.col("external").cast("bigint").alias("external"))


@query(f"SELECT p.page_id, count(tag) AS images, count(tag) FILTER (trim(coalesce({d.attr('tag', 'alt')}, '')) = '' AND NOT regexp_matches(lower({d.attr('tag', 'src')}), '(^data:image|\\.svg(\\?|$))')) AS empty_alt, count(tag) FILTER (trim(coalesce({d.attr('tag', 'title')}, '')) = '') AS empty_title FROM pages_ext p LEFT JOIN raw_images i ON p.page_id = i.page_id GROUP BY p.page_id", raw_images=IMAGES)
def p15_p30_image_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = lambda c: F.col(c).cast("bigint").alias(c)
    return checks.image_meta(view(spark, sf_dir, "pages_ext")).select("page_id", long("images"), long("empty_alt"), long("empty_title"))


CANONICAL = f"SELECT page_id, host, url, canonicals, canonicals[1] AS first, CASE WHEN trim(canonicals[1]) <> '' THEN {d.resolve('url', 'canonicals[1]')} END AS target FROM head"
NO_SCHEME = "NOT regexp_matches(first, '(?i)^(/|\\./|\\.\\./|#|https?:)') AND contains(first, '.') AND NOT contains(first, ' ')"


@query(d.issues("canonical", "canonical", {"CANONICAL_MULTIPLE": "len(canonicals) > 1", "CANONICAL_EMPTY_HREF": "first = ''", "CANONICAL_MISSING_SCHEME": NO_SCHEME, "CANONICAL_CROSS_DOMAIN": f"NOT ({NO_SCHEME}) AND {d.host('target')} <> host"}, "page_id"), canonical=CANONICAL, head=HEAD)
def p16_p32_canonical_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.canonical_issues(view(spark, sf_dir, "pages_ext"))


@query("SELECT page_id, string_agg(id, ',' ORDER BY n DESC, id) AS ids, max(n) AS most FROM (SELECT page_id, id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<[a-z][^>]*?\\sid\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1)) AS id FROM pages_ext) a GROUP BY ALL HAVING count(*) > 1) b GROUP BY page_id")
def p18_duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.duplicate_ids(view(spark, sf_dir, "pages_ext"))


RAW_TAGS = "SELECT page_id, lower(unnest(t)) AS tag, unnest(range(len(t))) AS pos FROM (SELECT page_id, regexp_extract_all(html, '(</?[A-Za-z][A-Za-z0-9]*)(?:[\\s/][^>]*)?>', 1) AS t FROM pages_ext) x"
A_DEPTH = "SELECT page_id, tag, sum(CASE WHEN tag = '<a' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id ORDER BY pos) AS depth FROM raw_tags WHERE tag IN ('<a', '</a')"
APART = f"SELECT page_id, sum(abs(n)) AS unbalanced FROM (SELECT page_id, regexp_replace(tag, '^</?', '') AS name, sum(CASE WHEN starts_with(tag, '</') THEN -1 ELSE 1 END) AS n FROM raw_tags WHERE NOT regexp_matches(tag, '^</?({checks.VOID})$') GROUP BY ALL) y GROUP BY page_id"


@query("SELECT a.page_id, coalesce(n, 0) AS nested_anchors, CAST(unbalanced AS BIGINT) AS unbalanced FROM apart a LEFT JOIN (SELECT page_id, count(*) AS n FROM a_depth WHERE tag = '<a' AND depth >= 2 GROUP BY page_id) d ON a.page_id = d.page_id", raw_tags=RAW_TAGS, a_depth=A_DEPTH, apart=APART)
def p19_p20_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.tag_balance(view(spark, sf_dir, "pages_ext")).select("page_id", F.col("nested_anchors").cast("bigint").alias("nested_anchors"), F.col("unbalanced").cast("bigint").alias("unbalanced"))


@query(f"SELECT r.page_id, CASE kind WHEN 'link' THEN 'BROKEN_LINKS' WHEN 'js' THEN 'MISSING_JS' WHEN 'css' THEN 'MISSING_CSS' ELSE 'MISSING_IMAGES' END AS code, count(*) AS broken FROM resources r JOIN url_status s ON r.target = s.url WHERE s.status_code IN (404, 410) AND (kind <> 'link' OR {d.host('target')} = r.host) GROUP BY r.page_id, kind", resources=RESOURCES)
def p23_broken_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.broken_resources(view(spark, sf_dir, "pages_ext"), view(spark, sf_dir, "url_status")).drop("samples")


BLOCKLIST = "SELECT * FROM (VALUES ('example.org', 'zone-a'), ('example.org', 'zone-b'), ('bad.example', 'zone-a')) AS b(domain, zone)"


@query("SELECT page_id, domain, string_agg(DISTINCT zone, ',' ORDER BY zone) AS zones FROM (SELECT page_id, regexp_replace(external, '^www\\.', '') AS domain FROM external UNION SELECT page_id, array_to_string(string_split(external, '.')[-2:], '.') FROM external) c JOIN blocklist USING (domain) GROUP BY page_id, domain", external=EXTERNAL, blocklist=BLOCKLIST)
def p24_outgoing_blocklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.outgoing_blocklisted(view(spark, sf_dir, "pages_ext"), spark.sql(BLOCKLIST))


OUT_TEXT = "SELECT page_id, count(*) FILTER (trim(regexp_replace(a, '<[^>]*>', '', 'g')) = '') AS empty_text FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)(<a(?:\\s[^>]*)?>.*?)</a>', 1)) AS a FROM pages_ext) x GROUP BY page_id"
OUT_BARE = f"SELECT page_id, count(*) AS missing_scheme FROM raw_links WHERE NOT regexp_matches(trim(ref), '(?i)^(/|\\./|\\.\\./|#|https?:)') AND contains(ref, '.') AND NOT contains(trim(ref), ' ') AND NOT regexp_matches(ref, {d.q(urls.NOT_A_RESOURCE)}) GROUP BY page_id"
META = f"SELECT p.page_id, count(tag) FILTER (trim(coalesce({d.attr('tag', 'alt')}, '')) = '' AND NOT regexp_matches(lower({d.attr('tag', 'src')}), '(^data:image|\\.svg(\\?|$))')) AS empty_alt, count(tag) FILTER (trim(coalesce({d.attr('tag', 'title')}, '')) = '') AS empty_title FROM pages_ext p LEFT JOIN raw_images i ON p.page_id = i.page_id GROUP BY p.page_id"
NESTED = "SELECT a.page_id, coalesce(n, 0) AS nested_anchors, unbalanced FROM apart a LEFT JOIN (SELECT page_id, count(*) AS n FROM a_depth WHERE tag = '<a' AND depth >= 2 GROUP BY page_id) d ON a.page_id = d.page_id"
MARKUP_RULES = {
    "MIXED_CONTENT": "starts_with(url, 'https://') AND (regexp_matches(html, '(?i)\\s(src|href)\\s*=\\s*[\"'']\\s*http://') OR regexp_matches(html, '(?i)\\sstyle\\s*=\\s*[\"''][^\"'']*http://') OR regexp_matches(html, '(?is)<style[^>]*>[^<]*http://'))",
    "NO_DOCTYPE": "NOT contains(lower(html), '<!doctype')",
}
ALL_ISSUES = " UNION ALL ".join([
    d.issues("head", "seo", SEO_RULES, "page_id"), d.issues("pages_ext", "markup", MARKUP_RULES, "page_id"),
    d.issues("(SELECT * FROM outgoing LEFT JOIN out_text USING (page_id) LEFT JOIN out_bare USING (page_id)) o", "outgoing", {"URL_MISSING_SCHEME": "missing_scheme > 0", "OUT_NO_INTERNAL_LINKS": "internal = 0", "OUT_TOO_MANY_INTERNAL_LINKS": "internal > 200", "OUT_MANY_EXTERNAL_LINKS": "external >= 50", "LINK_TEXT_EMPTY": "empty_text > 0"}, "page_id"),
    d.issues("meta_rows", "images", {"IMAGES_WITHOUT_ALT": "empty_alt > 0", "IMAGES_WITHOUT_TITLE": ("empty_title > 0", "Info")}, "page_id"),
    d.issues("canonical", "canonical", {"CANONICAL_MULTIPLE": "len(canonicals) > 1", "CANONICAL_EMPTY_HREF": "first = ''", "CANONICAL_MISSING_SCHEME": NO_SCHEME, "CANONICAL_CROSS_DOMAIN": f"NOT ({NO_SCHEME}) AND {d.host('target')} <> host"}, "page_id"),
    d.issues("nested", "structure", {"HTML_NESTED_ANCHORS": "nested_anchors > 0", "HTML_MARKUP_PARSE_ERRORS": ("unbalanced >= 15", "Error")}, "page_id"),
])


@query(ALL_ISSUES, head=HEAD, outgoing=OUTGOING, raw_links=LINKS, out_text=OUT_TEXT, out_bare=OUT_BARE, meta_rows=META, raw_images=IMAGES, canonical=CANONICAL, nested=NESTED, raw_tags=RAW_TAGS, a_depth=A_DEPTH, apart=APART)
def e1_w7_all_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.run_checks(view(spark, sf_dir, "pages_ext"))
