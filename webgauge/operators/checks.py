"""Page checks: each is a condition on page facts.  All checks of one grain share a scan: an array of issues, filtered, exploded."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls
from . import extract


@dataclass(frozen=True)
class Options:
    """Effective limits of the checks."""

    max_html_chars: int = 1_500_000
    big_page_bytes: int = 2_000_000
    slow_seconds: float = 3.0
    min_title_words: int = 2
    min_description_words: int = 5
    max_description_chars: int = 320
    max_internal_links: int = 200
    many_external_links: int = 50
    thin_chars: int = 600
    thin_words: int = 120
    thin_share: float = 0.05
    spam_tokens: int = 120
    spam_ratio: float = 0.09
    spam_unique: float = 0.35
    spam_count: int = 80
    markup_errors: int = 15
    large_page_bytes: int = 2_000_000
    large_html_chars: int = 2_000_000


SEVERITIES = {"Info": 0, "Warning": 1, "Error": 2}


def html_ok(low: int = 200, high: int = 300) -> Column:
    return (F.col("status_code") >= low) & (F.col("status_code") < high) & F.coalesce(F.lower("content_type").contains("html"), F.lit(False))


def accept(fetches: DataFrame) -> DataFrame:
    """Classify fetches: http_error, non_html, or html."""
    return fetches.withColumn("class", F.when((F.col("status_code") < 200) | (F.col("status_code") >= 300), "http_error").when(~F.coalesce(F.lower("content_type").contains("html"), F.lit(False)), "non_html").otherwise("html"))


def truncate(pages: DataFrame, limit: int = Options.max_html_chars) -> DataFrame:
    return pages.withColumn("truncated", F.coalesce(F.length("html") > limit, F.lit(False))).withColumn("html", F.substring("html", 1, limit))


def issues(facts: DataFrame, check: str, rules: dict[str, Column | tuple[Column, str]], *keys: str) -> DataFrame:
    """(keys, check, code, severity): a row for each rule that holds.  A rule is a condition, or one with its severity; null is no issue."""
    made = [F.when(c[0] if isinstance(c, tuple) else c, F.struct(F.lit(code).alias("code"), F.lit(c[1] if isinstance(c, tuple) else "Warning").alias("severity"))) for code, c in rules.items()]
    return facts.select(*keys, F.explode(F.filter(F.array(*made), lambda i: i.isNotNull())).alias("i")).select(*keys, F.lit(check).alias("check"), "i.code", "i.severity")


Check = Callable[[DataFrame], DataFrame]
CHECKS: dict[str, Check] = {}


def register(name: str) -> Callable[[Check], Check]:
    """Add a check: a function from pages with fetch columns to issues(page_id, check, code, severity)."""

    def add(f: Check) -> Check:
        CHECKS[name] = f
        return f

    return add


def run_checks(pages: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Issues of all registered checks, in the order of registration."""
    out = None
    for name in names or CHECKS:
        part = CHECKS[name](pages)
        out = part if out is None else out.unionByName(part)
    return out


def meta(name: str) -> Column:
    return F.filter("metas", lambda m: m["name"] == name)


def seo_facts(pages: DataFrame) -> DataFrame:
    head = extract.head_facts(pages)
    described = F.size(F.filter(meta("description"), lambda m: m["content"].isNotNull()))
    description = F.transform(meta("description"), lambda m: F.trim(F.regexp_replace(text.decode_entities(F.coalesce(m["content"], F.lit(""))), text.SPACE, " ")))
    return head.withColumn("n_described", described).withColumn("descriptions", F.filter(description, lambda d: d != "")).withColumn("title", F.coalesce(F.get("titles", F.lit(0)), F.lit(""))).withColumn("h1", F.coalesce(F.get("h1s", F.lit(0)), F.lit(""))).withColumn("description", F.coalesce(F.get("descriptions", F.lit(0)), F.lit("")))


@register("seo")
def seo(pages: DataFrame, o: Options = Options()) -> DataFrame:
    """Presence, number, equality and length of title, h1 and description."""
    same = lambda a, b: (F.col(a) != "") & (F.lower(a) == F.lower(b))
    rules = {
        "NO_TITLE": F.size("titles") == 0, "MULTI_TITLE": F.size("titles") > 1,
        "NO_DESCRIPTION": F.size("descriptions") == 0, "MULTI_DESCRIPTION": F.size("descriptions") > 1,
        "SEO_MISSING_TITLE": F.size("titles") == 0, "SEO_MULTIPLE_TITLE": F.size("titles") > 1, "SEO_MISSING_DESCRIPTION": F.col("n_described") == 0, "SEO_MULTIPLE_DESCRIPTION": F.col("n_described") > 1,
        "NO_H1": F.size("h1s") == 0, "H1_MULTIPLE": F.size("h1s") > 1, "SEO_MISSING_H1": (F.size("h1s") == 0) | (F.col("h1") == ""),
        "HTML_DOCTYPE_MISSING": F.col("doctype") == "", "HTML_DOCTYPE_NOT_HTML": (F.col("doctype") != "") & ~F.col("doctype").startswith("html"),
        "SEO_TITLE_EQUALS_H1": same("title", "h1"), "SEO_TITLE_EQUALS_DESCRIPTION": same("title", "description"), "SEO_DESCRIPTION_EQUALS_H1": same("description", "h1"),
        "SEO_TITLE_TOO_SHORT": (F.col("title") != "") & (F.size(F.split("title", " ")) < o.min_title_words),
        "SEO_DESCRIPTION_TOO_SHORT": (F.col("description") != "") & (F.size(F.split("description", " ")) < o.min_description_words),
        "SEO_DESCRIPTION_TOO_LONG": F.length("description") > o.max_description_chars,
    }
    return issues(seo_facts(pages), "seo", rules, "page_id")


def fetch_rules(o: Options = Options()) -> dict[str, Column | tuple[Column, str]]:
    """Rules on a fetch row alone: no HTML is read.  By its two ends a redirect stays within the last two labels or not; redirect_issues tells it by the chain."""
    a, b = F.col("original_url"), F.col("final_url")
    ha, hb = urls.host(a), urls.host(b)
    http = lambda u: F.lower(urls.part(u, 1)) == "http"
    moved = F.coalesce(ha != hb, F.lit(False))
    return {
        "NO_HTTPS": (http(b), "Error"), "PORT_443_IN_URL": (http(a) & (urls.part(a, 3) == ":443"), "Info"), "PORT_443_IN_FINAL_URL": (http(b) & (urls.part(b, 3) == ":443"), "Info"),
        "HTTP_TO_HTTPS_REDIRECT": (http(a) & ~http(b), "Info"), "NO_HTTP_TO_HTTPS_REDIRECT": http(a) & http(b), "REDIRECT_OTHER_DOMAIN": moved,
        "REDIRECT_TO_SUBDOMAIN": (moved & (urls.root2(ha) == urls.root2(hb)), "Info"), "REDIRECT_TO_OTHER_DOMAIN": moved & (urls.root2(ha) != urls.root2(hb)),
        "URL_EXPLICIT_443": a.rlike(r"(?i)^https?://[^/]+:443/?$"), "URL_NO_SCHEME": ~a.rlike(urls.HAS_SCHEME),
        "PERF_SLOW_PAGE": F.col("load_seconds") >= o.slow_seconds, "BIG_PAGE": html_ok() & (F.col("content_length") >= o.big_page_bytes), "HTML_LARGE_PAGE": html_ok(200, 400) & (F.col("content_length") > o.large_page_bytes),
        "HTTP_REDIRECT_STATUS": (F.col("status_code").between(300, 399), "Info"), "HTTP_CLIENT_ERROR": F.col("status_code").between(400, 499), "HTTP_SERVER_ERROR": (F.col("status_code") >= 500, "Error"), "HTTP_FETCH_FAILED": (F.col("status_code") == 0, "Error"),
    }


def fetch_issues(fetches: DataFrame, o: Options = Options()) -> DataFrame:
    return issues(fetches, "fetch", fetch_rules(o), "seq")


def redirect_issues(fetches: DataFrame) -> DataFrame:
    """(seq, check, code, severity) of fetches(seq, original_url, redirects), redirects an array with `location`.  The first absolute location on another host
    tells whether a chain stays within the last two labels; a fetch without redirects has no row."""
    own = urls.host(F.col("original_url"))
    away = F.filter(F.transform("redirects", lambda r: urls.host(r["location"])), lambda h: h.isNotNull() & (h != F.col("own")))
    facts = fetches.withColumn("own", own).withColumn("other", F.get(away, F.lit(0)))
    near = urls.root2(F.col("own")) == urls.root2(F.col("other"))
    return issues(facts, "redirects", {"MULTI_REDIRECTS": (F.size("redirects") > 1, "Info"), "REDIRECT_TO_SUBDOMAIN": (near, "Info"), "REDIRECT_TO_OTHER_DOMAIN": ~near}, "seq")


def noindex_issues(fetches: DataFrame) -> DataFrame:
    """INDEX_NOINDEX of HTML pages with status 200 to 399: by header or by meta tag."""
    facts = fetches.where(html_ok(200, 400)).select("seq", "x_robots_tag", extract.metas(F.col("html")).alias("metas"))
    return issues(facts, "noindex", {"INDEX_NOINDEX": noindex_header() | noindex_meta()}, "seq")


def landing_issues(pages: DataFrame) -> DataFrame:
    """Landing pages that can't be indexed, of pages(seq, url, allowed, x_robots_tag, html); `allowed` comes from robots.allowed."""
    facts = pages.where(urls.is_landing(F.col("url"))).select("seq", "allowed", "x_robots_tag", extract.metas(F.col("html")).alias("metas"))
    return issues(facts, "landing", {"LANDING_BLOCKED_BY_ROBOTS": ~F.col("allowed"), "LANDING_NOINDEX_HEADER": noindex_header(), "LANDING_NOINDEX_META": noindex_meta()}, "seq")


def failed_checks(read: DataFrame) -> DataFrame:
    """A row for each page that a check couldn't read, of read(page_id, error)."""
    return issues(read, "runner", {"CHECK_FAILED": (F.col("error").isNotNull(), "Error")}, "page_id")


#: Fixed value: texts of server errors that leak into pages.
LEAKS = r"(?i)(Fatal error: |Stack trace:|Traceback \(most recent call last\)|Unhandled exception|SQLSTATE\[|ORA-[0-9]{5}|You have an error in your SQL syntax)"


def mixed_content(html: Column) -> Column:
    """A source, address or style of a page goes by plain http."""
    return html.rlike(r"(?i)\s(src|href)\s*=\s*[\"']\s*http://") | html.rlike(r"(?i)\sstyle\s*=\s*[\"'][^\"']*http://") | html.rlike(r"(?is)<style[^>]*>[^<]*http://")


@register("markup")
def markup(pages: DataFrame, o: Options = Options()) -> DataFrame:
    html = F.col("html")
    rules = {"HTML_LARGE_PAGE_BODY": F.length(html) > o.large_html_chars, "MIXED_CONTENT": F.lower("url").startswith("https://") & mixed_content(html), "IFRAME_PRESENT": (F.regexp_count(html, F.lit(r"(?i)<iframe[\s>]")) > 0, "Info"), "SERVER_ERROR_LEAK": (html.rlike(LEAKS), "Error"), "NO_DOCTYPE": ~F.coalesce(F.lower(html).contains("<!doctype"), F.lit(False))}
    return issues(pages, "markup", rules, "page_id")


def noindex_meta() -> Column:
    return F.exists("metas", lambda m: m["name"].isin("robots", "googlebot", "yandex") & F.coalesce(F.lower(m["content"]).contains("noindex"), F.lit(False)))


def noindex_header() -> Column:
    return F.coalesce(F.lower("x_robots_tag").contains("noindex"), F.lit(False))


def outgoing(pages: DataFrame) -> DataFrame:
    """(page_id, internal, external, missing_scheme, empty_text) of each page, pages without links included."""
    anchors = F.slice(F.regexp_extract_all(F.col("html"), F.lit(r"(?is)(<a(?:\s[^>]*)?>.*?)</a>"), F.lit(1)), 1, 2000)
    refs = F.filter(F.transform(F.slice(extract.tags(F.col("html"), "a"), 1, 2000), lambda t: F.trim(extract.attribute(t, "href"))), lambda r: urls.is_checkable(r))
    hosts = F.transform(refs, lambda r: urls.host(urls.resolve(F.col("url"), r)))
    count = lambda a, f: F.size(F.filter(a, f))
    return pages.select(
        "page_id", "host", "url", count(hosts, lambda h: h == F.col("host")).alias("internal"), count(hosts, lambda h: h != F.col("host")).alias("external"),
        count(refs, lambda r: urls.missing_scheme(r)).alias("missing_scheme"), count(anchors, lambda t: F.trim(F.regexp_replace(t, "<[^>]*>", "")) == "").alias("empty_text"),
    )


@register("outgoing")
def outgoing_issues(pages: DataFrame, o: Options = Options()) -> DataFrame:
    rules = {"URL_MISSING_SCHEME": F.col("missing_scheme") > 0, "OUT_NO_INTERNAL_LINKS": F.col("internal") == 0, "OUT_TOO_MANY_INTERNAL_LINKS": F.col("internal") > o.max_internal_links, "OUT_MANY_EXTERNAL_LINKS": F.col("external") >= o.many_external_links, "LINK_TEXT_EMPTY": F.col("empty_text") > 0}
    return issues(outgoing(pages), "outgoing", rules, "page_id")


def image_meta(pages: DataFrame) -> DataFrame:
    """(page_id, images, empty_alt, empty_title) of each page; decorative images need no alt."""
    tag = F.slice(extract.tags(F.col("html"), "img"), 1, 500)
    a = extract.attribute
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    decorative = lambda t: F.coalesce((F.lower(a(t, "role")) == "presentation"), F.lit(False)) | F.coalesce(F.lower(a(t, "aria-hidden")) == "true", F.lit(False)) | F.coalesce(F.lower(a(t, "class")).contains("icon"), F.lit(False)) | F.coalesce(F.lower(a(t, "src")).rlike(r"(^data:image|\.svg(\?|$))"), F.lit(False))
    return pages.select("page_id", "host", "url", F.size(tag).alias("images"), F.size(F.filter(tag, lambda t: blank(a(t, "alt")) & ~decorative(t))).alias("empty_alt"), F.size(F.filter(tag, lambda t: blank(a(t, "title")))).alias("empty_title"))


@register("images")
def image_issues(pages: DataFrame) -> DataFrame:
    return issues(image_meta(pages), "images", {"IMAGES_WITHOUT_ALT": F.col("empty_alt") > 0, "IMAGES_WITHOUT_TITLE": (F.col("empty_title") > 0, "Info")}, "page_id")


def canonical_facts(pages: DataFrame) -> DataFrame:
    """(page_id, host, url, canonicals, first, target, in_body), each from its own row."""
    body = F.regexp_extract("html", r"(?is)<body(?:\s[^>]*)?>(.*)$", 1)
    in_body = F.exists(extract.tags(body, "link"), lambda t: F.coalesce(F.lower(extract.attribute(t, "rel")).contains("canonical"), F.lit(False)))
    facts = pages.select("page_id", "host", "url", extract.canonicals(F.col("html")).alias("canonicals"), in_body.alias("in_body"))
    first = F.get("canonicals", F.lit(0))
    return facts.withColumn("first", first).withColumn("target", F.when(F.trim(first) != "", urls.resolve(F.col("url"), first)))


@register("canonical")
def canonical_issues(pages: DataFrame) -> DataFrame:
    there = F.size("canonicals") > 0
    other = urls.host(F.col("target"))
    rules = {
        "CANONICAL_MULTIPLE": F.size("canonicals") > 1, "CANONICAL_IN_BODY": F.col("in_body"), "CANONICAL_EMPTY_HREF": there & (F.trim("first") == ""),
        "CANONICAL_MISSING_SCHEME": there & urls.missing_scheme(F.col("first")), "CANONICAL_INVALID_URL": there & (F.trim("first") != "") & other.isNull(),
        "CANONICAL_CROSS_DOMAIN": there & ~urls.missing_scheme(F.col("first")) & (other != F.col("host")),
    }
    return issues(canonical_facts(pages), "canonical", rules, "page_id")


def duplicate_ids(pages: DataFrame) -> DataFrame:
    """(page_id, ids): element ids used more than once, most used first."""
    ids = F.transform(F.regexp_extract_all(F.col("html"), F.lit(r"(?i)<[a-z][^>]*?\sid\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1)), lambda x: x)
    counted = pages.select("page_id", F.explode(ids).alias("id")).groupBy("page_id", "id").count().where("count > 1")
    pack = F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("minus"), "id")))
    return counted.groupBy("page_id").agg(F.array_join(F.transform(pack, lambda s: s["id"]), ",").alias("ids"), F.max("count").alias("most"))


#: Fixed value: elements that are never closed.
VOID = "area|base|br|col|embed|hr|img|input|link|meta|param|source|track|wbr"


def tag_balance(pages: DataFrame) -> DataFrame:
    """(page_id, nested_anchors, nested_forms, unbalanced): depth along the page by a fold over its tags in order, without a shuffle.

    A tag opens inside another of its kind if the depth is over 0 there.  unbalanced: how far opening and closing tags of each kind are apart, summed.
    """
    all_tags = F.transform(F.regexp_extract_all(F.col("html"), F.lit(r"(</?[A-Za-z][A-Za-z0-9]*)(?:[\s/][^>]*)?>"), F.lit(1)), lambda t: F.lower(t))
    html = pages.select("page_id", F.filter(all_tags, lambda t: ~t.rlike(rf"^</?({VOID})$")).alias("tags"))
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("nested"))

    def nested(kind: str) -> Column:
        return F.aggregate(
            F.filter("tags", lambda t: t.isin(f"<{kind}", f"</{kind}")), zero,
            lambda acc, t: F.struct(F.when(t == f"<{kind}", acc["depth"] + 1).otherwise(F.greatest(acc["depth"] - 1, F.lit(0))).alias("depth"), (acc["nested"] + F.when((t == f"<{kind}") & (acc["depth"] > 0), 1).otherwise(0)).alias("nested")),
            lambda acc: acc["nested"],
        )

    names = F.array_distinct(F.transform("tags", lambda t: F.regexp_replace(t, "^</?", "")))
    apart = F.aggregate(F.transform(names, lambda n: F.abs(F.size(F.filter("tags", lambda t: t == F.concat(F.lit("<"), n))) - F.size(F.filter("tags", lambda t: t == F.concat(F.lit("</"), n))))), F.lit(0), lambda a, x: a + x)
    return html.select("page_id", nested("a").alias("nested_anchors"), nested("form").alias("nested_forms"), apart.alias("unbalanced"))


@register("structure")
def structure_issues(pages: DataFrame, o: Options = Options()) -> DataFrame:
    rules = {"HTML_NESTED_ANCHORS": F.col("nested_anchors") > 0, "HTML_NESTED_FORMS": F.col("nested_forms") > 0, "HTML_MARKUP_PARSE_ERRORS": (F.col("unbalanced") >= o.markup_errors, "Error")}
    return issues(tag_balance(pages), "structure", rules, "page_id")


def broken_resources(pages: DataFrame, url_status: DataFrame) -> DataFrame:
    """(page_id, code, broken, samples): resources that answer 404 or 410; links count only on the page's own host."""
    found = extract.resources(pages).where((F.col("kind") != "link") | (urls.host(F.col("target")) == F.col("host")))
    bad = url_status.where(F.col("status_code").isin(404, 410)).select(F.col("url").alias("target"))
    hit = found.join(bad.hint("shuffle_merge"), "target").groupBy("page_id", "kind").agg(F.count("*").alias("broken"), F.array_join(F.slice(F.array_sort(F.collect_set("target")), 1, 5), " ").alias("samples"))
    code = F.when(F.col("kind") == "link", "BROKEN_LINKS").when(F.col("kind") == "js", "MISSING_JS").when(F.col("kind") == "css", "MISSING_CSS").otherwise("MISSING_IMAGES")
    return hit.select("page_id", code.alias("code"), "broken", "samples")


def outgoing_blocklisted(pages: DataFrame, blocklist: DataFrame) -> DataFrame:
    """(page_id, domain, zones): external hosts, without www. or by their last two labels, that a blocklist has."""
    bare = F.regexp_replace("external", r"^www\.", "")
    candidates = extract.external_hosts(pages).select("page_id", F.explode(F.array_distinct(F.array(bare, urls.root2(bare)))).alias("domain"))
    return candidates.join(blocklist.hint("shuffle_hash"), "domain").groupBy("page_id", "domain").agg(F.array_join(F.array_sort(F.collect_set("zone")), ",").alias("zones"))


def blocklist_issues(hits: DataFrame, top: int = 5) -> DataFrame:
    """(page_id, check, code, severity, shown) of outgoing_blocklisted: one issue for a page, with the domains that most zones list, `top` of them."""
    order = F.array_sort(F.collect_list(F.struct((-F.size(F.split("zones", ","))).alias("minus"), "domain", "zones")))
    shown = F.array_join(F.transform(F.slice(order, 1, top), lambda x: F.concat(x["domain"], F.lit(": "), F.replace(x["zones"], F.lit(","), F.lit(", ")))), "; ")
    per = hits.groupBy("page_id").agg(shown.alias("shown"))
    return per.select("page_id", F.lit("outgoing").alias("check"), F.lit("OUTGOING_DOMAIN_DNSBL").alias("code"), F.lit("Warning").alias("severity"), "shown")


def thin_page(o: Options = Options()) -> Column:
    """On columns chars, words and html_chars."""
    return (F.col("chars") < o.thin_chars) | (F.col("words") < o.thin_words) | (F.col("chars") / F.greatest(F.col("html_chars"), F.lit(1)) < o.thin_share)
