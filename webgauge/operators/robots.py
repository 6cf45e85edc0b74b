"""robots.txt rules and lint, sitemaps, and set comparisons between crawl, sitemap and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..sources.shared import materialize

AGENT, RULE = "user-agent", ("allow", "disallow")
#: Directives that robots files may have, in lower case.
KNOWN = ["user-agent", "disallow", "allow", "sitemap", "crawl-delay", "host"]


def lines(files: DataFrame) -> DataFrame:
    """(host, line, text, key, value): lines of robots files without comments and blanks; key is null where there's no colon."""
    raw = files.select("host", F.posexplode(F.split("body", "\r?\n")).alias("pos", "raw"))
    text = F.trim(F.regexp_replace("raw", "#.*$", ""))
    rows = raw.select("host", (F.col("pos") + 1).alias("line"), text.alias("text")).where("text <> ''")
    colon = F.col("text").contains(":")
    return rows.withColumn("key", F.when(colon, F.lower(F.trim(F.regexp_extract("text", "^([^:]*):", 1))))).withColumn("value", F.when(colon, F.trim(F.regexp_extract("text", "^[^:]*:(.*)$", 1))))


def _grouped(found: DataFrame) -> DataFrame:
    """Lines of agents and rules with their group: an agent line after a rule begins the next one."""
    by = Window.partitionBy("host").orderBy("line")
    kept = found.where(F.col("key").isin(AGENT, *RULE))
    begins = (F.col("key") == AGENT) & (F.coalesce(F.lag("key").over(by), F.lit("allow")) != AGENT)
    return kept.withColumn("begins", begins.cast("int")).withColumn("group", F.sum("begins").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("begins")


def pattern(value: Column) -> Column:
    """A rule's path as a regular expression: * matches anything, a last $ the end."""
    escaped = F.regexp_replace(F.regexp_replace(value, r"([\\.+?^{}()|\[\]])", r"\\$1"), r"\*", ".*")
    ends = value.endswith("$")
    bare = F.regexp_replace(F.when(ends, F.substring(escaped, 1, F.length(escaped) - 1)).otherwise(escaped), r"\$", r"\\\$")
    return F.concat(F.lit("^"), bare, F.when(ends, "$").otherwise(""))


def rules(files: DataFrame) -> DataFrame:
    """(host, agent, allow, pattern, regex, specificity); an agent's groups are merged, empty rules don't count."""
    grouped = _grouped(lines(files))
    agents = grouped.where((F.col("key") == AGENT) & (F.col("value") != "")).select("host", "group", F.lower("value").alias("agent"))
    kept = grouped.where((F.col("key") != AGENT) & (F.col("value") != "")).select("host", "group", (F.col("key") == "allow").alias("allow"), F.col("value").alias("pattern"))
    return agents.join(kept.hint("shuffle_merge"), ["host", "group"]).select("host", "agent", "allow", "pattern", pattern(F.col("pattern")).alias("regex"), F.length("pattern").alias("specificity")).distinct()


def allowed(pages: DataFrame, rules_: DataFrame, agent: str = "mycrawler") -> DataFrame:
    """pages(host, url) with `allowed`: of the agent's own rules, or else of those for all, the longest that matches path and query decides; allow wins a tie.

    The rules of a host are few; they go to the pages by host.  Each page gathers one maximum, so rows don't stay multiplied.
    """
    own = rules_.where(F.col("agent").isin(agent.lower(), "*")).withColumn("own", F.col("agent") != "*")
    best = own.groupBy("host").agg(F.max("own").alias("has_own"))
    used = own.join(best.hint("shuffle_merge"), "host").where(F.col("own") == F.col("has_own")).groupBy("host").agg(F.collect_list(F.struct("specificity", "allow", "regex")).alias("rules"))
    path = F.concat(F.when(urls.part(F.col("url"), 4) == "", "/").otherwise(urls.part(F.col("url"), 4)), urls.part(F.col("url"), 5))
    hit = F.array_max(F.transform(F.filter("rules", lambda r: F.rlike("path", r["regex"])), lambda r: F.struct(r["specificity"], r["allow"])))
    return pages.withColumn("path", path).join(used.hint("shuffle_merge"), "host", "left").withColumn("hit", hit).withColumn("allowed", F.coalesce(F.col("hit.allow"), F.lit(True))).drop("rules", "path", "hit")


def lint(files: DataFrame) -> DataFrame:
    """(host, line, code); line 0 is the file."""
    by = Window.partitionBy("host").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    found = lines(files).withColumn("seen", F.coalesce(F.max(((F.col("key") == AGENT) & (F.col("value") != "")).cast("int")).over(by), F.lit(0)) == 1)
    seen = F.col("seen")
    key, value = F.col("key"), F.col("value")
    rule = F.coalesce(key.isin(*RULE), F.lit(False))
    codes = [
        (key.isNull() | (key == ""), "ROBOTS_BAD_LINE"), ((key != "") & ~key.isin(KNOWN), "ROBOTS_UNKNOWN_DIRECTIVE"), ((key == AGENT) & (value == ""), "ROBOTS_EMPTY_USER_AGENT"),
        (rule & ~seen, "ROBOTS_RULE_BEFORE_UA"), (rule & (value == ""), "ROBOTS_EMPTY_RULE"), (rule & (value != "") & ~value.rlike(r"^[/*$]"), "ROBOTS_RULE_NOT_PATHLIKE"),
        ((key == "sitemap") & ~value.rlike(r"(?i)^https?://[^\s/]+"), "ROBOTS_BAD_SITEMAP_URL"), ((key == "crawl-delay") & value.try_cast("double").isNull(), "ROBOTS_BAD_CRAWL_DELAY"),
    ]
    made = F.filter(F.array(*(F.when(c, F.lit(code)) for c, code in codes)), lambda c: c.isNotNull())
    rows = found.select("host", "line", F.explode(made).alias("code"))
    # A file without any line is one without agents, too.
    agents = found.groupBy("host").agg(F.count_if((key == AGENT) & (value != "")).alias("named"), F.count_if(key == AGENT).alias("n"))
    counts = files.select("host").distinct().join(agents.hint("shuffle_merge"), "host", "left").na.fill(0)
    whole = F.array(F.when(F.col("named") == 0, F.lit("ROBOTS_NO_USER_AGENT")), F.when(F.col("n") == 0, F.lit("ROBOTS_NO_UA_LINES")))
    return rows.unionByName(counts.select("host", F.lit(0).alias("line"), F.explode(F.filter(whole, lambda c: c.isNotNull())).alias("code")))


def host_issues(hosts: DataFrame, fetched: DataFrame, agent: str = "mycrawler") -> DataFrame:
    """(host, code, severity) of a host's robots files, of fetched(host, scheme, status_code, body): https where it exists, else http.

    A file exists if its status is below 400; status 0 or null, and a host without any row, were not fetched.  A host without a file has the reason (of https, where
    that was tried) and ROBOTS_MISSING_OR_UNAVAILABLE; one with a file has ROBOTS_ONLY_HTTP, ROBOTS_NO_GROUP_FOR_UA and ROBOTS_BLOCKS_ALL as they hold.  Repeated
    rows count once, null bodies are empty.
    """
    there = F.coalesce(F.col("status_code").between(1, 399), F.lit(False))
    order = F.struct((~there).cast("int"), (F.col("scheme") != "https").cast("int"), F.coalesce("status_code", F.lit(0)), F.coalesce("body", F.lit("")))
    picked = fetched.groupBy("host").agg(F.min_by(F.struct("scheme", "status_code", "body"), order).alias("f")).select("host", "f.*")
    files = materialize(hosts.select("host").distinct().join(picked.hint("shuffle_merge"), "host", "left").withColumn("there", there))
    read = files.where("there").select("host", F.coalesce("body", F.lit("")).alias("body"))
    groups = lines(read).where((F.col("key") == AGENT) & F.lower("value").isin(agent.lower(), "*")).select("host", F.lit(True).alias("has_group")).distinct()
    roots = allowed(read.select("host", F.concat(F.lit("https://"), "host", F.lit("/")).alias("url")), rules(read), agent).select("host", F.col("allowed").alias("root"))
    facts = files.join(groups.hint("shuffle_merge"), "host", "left").join(roots.hint("shuffle_merge"), "host", "left")
    got, status = F.col("there"), F.coalesce("status_code", F.lit(0))
    codes = [
        (~got, "ROBOTS_MISSING_OR_UNAVAILABLE"), (status == 404, "ROBOTS_MISSING"), ((status >= 400) & (status != 404), "ROBOTS_HTTP_ERROR"), (status == 0, "ROBOTS_FETCH_FAILED"), (got & (F.col("scheme") != "https"), "ROBOTS_ONLY_HTTP"),
        (got & F.col("has_group").isNull(), "ROBOTS_NO_GROUP_FOR_UA"), (got & ~F.coalesce("root", F.lit(True)), "ROBOTS_BLOCKS_ALL"),
    ]
    return facts.select("host", F.explode(F.filter(F.array(*(F.when(c, F.lit(code)) for c, code in codes)), lambda c: c.isNotNull())).alias("code"), F.lit("Warning").alias("severity"))


def host_state(hosts: DataFrame, files: DataFrame, agent: str = "mycrawler") -> DataFrame:
    """(host, code) of what a host's robots file is: missing, failed, plain http only, without a group for the agent, or blocking all."""
    r = rules(files)
    groups = lines(files).where(F.col("key") == AGENT).groupBy("host").agg(F.bool_or(F.lower("value").isin(agent.lower(), "*")).alias("has_group"))
    root = allowed(hosts.select("host", F.concat(F.lit("https://"), F.col("host"), F.lit("/")).alias("url")), r, agent).select("host", F.col("allowed").alias("root_allowed"))
    all_ = hosts.select("host").join(files.select("host", "scheme", "status_code").hint("shuffle_merge"), "host", "left").join(groups.hint("shuffle_merge"), "host", "left").join(root.hint("shuffle_merge"), "host", "left")
    codes = [(F.col("status_code").isNull() | (F.col("status_code") == 0), "ROBOTS_FETCH_FAILED"), (F.col("status_code").isin(404, 410), "ROBOTS_MISSING"), ((F.col("status_code") >= 400) & ~F.col("status_code").isin(404, 410), "ROBOTS_HTTP_ERROR"), (F.col("scheme") == "http", "ROBOTS_ONLY_HTTP"), ((F.col("status_code") == 200) & ~F.coalesce("has_group", F.lit(False)), "ROBOTS_NO_GROUP_FOR_UA"), (~F.col("root_allowed"), "ROBOTS_BLOCKS_ALL")]
    return all_.select("host", F.explode(F.filter(F.array(*(F.when(c, F.lit(code)) for c, code in codes)), lambda c: c.isNotNull())).alias("code"))


def sitemaps_of(files: DataFrame) -> DataFrame:
    base = F.concat(F.lit("https://"), F.col("host"), F.lit("/robots.txt"))
    return lines(files).where((F.col("key") == "sitemap") & (F.col("value") != "")).select("host", urls.resolve(base, F.col("value")).alias("sitemap_url")).distinct()


def _sitemap_body() -> Column:
    """A sitemap without comments, CDATA marks and what pictures, videos and news add to an entry."""
    bare = F.regexp_replace("body", r"(?s)<!--.*?-->", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), r"(?is)<((?:image|video|news):\w+)\b[^>]*>.*?</\1\s*>", "")


def sitemap_kind(body: Column) -> Column:
    """index, urlset, unknown (another root) or broken (no root, or its end is missing)."""
    root = F.lower(F.regexp_extract(body, r"<(?:[\w.\-]+:)?([A-Za-z]+)[\s>]", 1))
    whole = body.rlike(r"(?i)</(?:[\w.\-]+:)?(urlset|sitemapindex)\s*>\s*$")
    return F.when((root == "") | body.isNull(), "broken").when(~root.isin("urlset", "sitemapindex"), "unknown").when(~whole, "broken").when(root == "urlset", "urlset").otherwise("index")


def sitemap_urls(files: DataFrame) -> DataFrame:
    """(host, file, kind, loc): entries of sitemap files(host, url, body).  kind: index, urlset, unknown or broken; files that say nothing keep a row without loc.

    Entries are read by local name with any prefix, blank ones left out; a regular expression doesn't fail on broken markup.
    """
    body = _sitemap_body()
    kind = sitemap_kind(body)
    found = F.regexp_extract_all(body, F.lit(r"(?is)<(?:[\w.\-]+:)?loc\s*>\s*(.*?)\s*</(?:[\w.\-]+:)?loc\s*>"), F.lit(1))
    locs = F.filter(F.transform(found, lambda s: F.replace(s, F.lit("&amp;"), F.lit("&"))), lambda s: s != "")
    return files.select("host", F.col("url").alias("file"), kind.alias("kind"), F.explode_outer(F.when(kind.isin("urlset", "index"), locs)).alias("loc"))


def sitemap_closure(files: DataFrame, roots: DataFrame, max_files: int = 200) -> DataFrame:
    """(host, file, depth): sitemap files that the roots(host, url) lead to over indexes; a file is entered once, `max_files` of a host."""
    known = sitemap_urls(files).where("kind = 'index' and loc is not null").select("host", F.col("file").alias("src"), F.col("loc").alias("dst"))
    from .graph import frontier

    seen = frontier(known, roots, max_files)
    return seen.select("host", F.col("url").alias("file"), "depth")


def indexability(fetches: DataFrame, noindex_header: Column, noindex_meta: Column) -> DataFrame:
    """fetches with `allowed` get `state`: the first that holds of robots, http error, header, not html, meta."""
    state = F.when(~F.col("allowed"), "robots_blocked").when(F.col("status_code") >= 400, "http_error").when(noindex_header, "noindex_header").when(~F.coalesce(F.lower("content_type").contains("html"), F.lit(False)), "indexable").when(noindex_meta, "noindex_meta").otherwise("indexable")
    return fetches.withColumn("state", state)


def site_indexability(homes: DataFrame) -> DataFrame:
    """(host, code) of homepages with `allowed`, `by_header`, `by_meta` and status_code; one row for each host.  With `robots_fetched`, also whether the rules
    could be read; where they couldn't, nothing is known to be blocked."""
    codes = [(~F.col("robots_fetched"), "SITE_INDEX_ROBOTS_FETCH_FAILED")] if "robots_fetched" in homes.columns else []
    codes += [(~F.col("allowed"), "SITE_INDEX_BLOCKED_BY_ROBOTS"), (F.col("status_code") >= 400, "SITE_INDEX_HOMEPAGE_HTTP_ERROR"), (F.col("by_header"), "SITE_INDEX_HOMEPAGE_NOINDEX_HEADER"), (F.col("by_meta"), "SITE_INDEX_HOMEPAGE_NOINDEX_META")]
    return homes.select("host", F.explode(F.filter(F.array(*(F.when(c, F.lit(code)) for c, code in codes)), lambda c: c.isNotNull())).alias("code"))


def sitemap_audit(entries: DataFrame, states: DataFrame) -> dict[str, DataFrame]:
    """Set comparisons between sitemap entries(host, loc) and crawled pages(host, url, state).  Keys are normalised on both sides."""
    listed = entries.select("host", urls.sitemap_url(F.col("loc")).alias("key")).where("key is not null").distinct()
    crawled = states.select("host", "url", "state", urls.sitemap_url(F.col("url")).alias("key"))
    return {
        "not_crawled": listed.join(crawled.hint("shuffle_merge"), ["host", "key"], "left_anti"),
        "not_in_sitemap": crawled.where("state = 'indexable'").join(listed.hint("shuffle_merge"), ["host", "key"], "left_anti").select("host", "key"),
        "not_indexable": listed.join(crawled.where("state in ('robots_blocked', 'noindex_header', 'noindex_meta')").hint("shuffle_merge"), ["host", "key"]).select("host", "key", "state"),
    }


def sitemap_samples(entries: DataFrame, states: DataFrame, n: int = 50) -> DataFrame:
    """(host, kind, nth, url, state): the first n addresses of each of sitemap_audit's sets, by address."""
    from .content import top_samples

    sets = sitemap_audit(entries, states)
    out = None
    for kind, rows in sets.items():
        one = top_samples(rows.select("host", F.col("key").alias("url"), F.col("state") if "state" in rows.columns else F.lit(None).cast("string").alias("state")).distinct(), n, "url", "state").select("host", F.lit(kind).alias("kind"), "nth", "url", "state")
        out = one if out is None else out.unionByName(one)
    return out


def sitemap_report(files: DataFrame, states: DataFrame, max_urls: int = 200_000) -> DataFrame:
    """By host of states(host, url, state): what its sitemap files(host, url, status_code, body), each address once, hold, and how that meets the crawl.

    found: a file was read and gave an address.  errors: files not fetched, broken files, and one where nothing was found.  warnings: other roots,
    entries that are no address, files without any address, more than max_urls addresses; all of them are counted all the same.
    """
    got = F.coalesce(F.col("status_code") == 200, F.lit(False))
    kind = sitemap_kind(_sitemap_body())
    of_files = files.select("host", got.alias("got"), kind.alias("kind"), F.lower(urls.part(F.col("url"), 4)).alias("path")).groupBy("host").agg(
        F.count_if("got").alias("files"), F.count_if(~F.col("got")).alias("unfetched"), F.count_if(F.col("got") & (F.col("kind") == "broken")).alias("broken"),
        F.count_if(F.col("got") & (F.col("kind") == "unknown")).alias("unknown"), F.coalesce(F.bool_or(F.col("got") & (F.col("path") == "/sitemap.xml")), F.lit(False)).alias("has_sitemap_xml"),
    )
    entries = materialize(sitemap_urls(files.where(got)).where("loc is not null").select("host", "kind", "loc", F.when(F.col("kind") == "urlset", urls.sitemap_url(F.col("loc"))).alias("key")))
    keys = entries.groupBy("host", "key").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "urlset").alias("listed"))
    of_urls = keys.groupBy("host").agg(F.sum("n").alias("elements"), F.count("key").alias("urls"), F.count_if(F.col("key").isNotNull() & urls.looks_like_html(F.col("key"))).alias("html_estimate"), F.sum(F.when(F.col("key").isNull(), F.col("listed")).otherwise(0)).alias("bad_urls"))
    crawl = materialize(states.select("host", "url", "state"))
    sets = [rows.groupBy("host").agg(F.count("*").alias(name)) for name, rows in sitemap_audit(entries.where("kind = 'urlset'"), crawl).items()]
    out = crawl.select("host").distinct()
    for one in [of_files, of_urls, *sets]:
        out = out.join(one.hint("shuffle_merge"), "host", "left")
    out = out.na.fill(0).na.fill(False).withColumn("found", (F.col("files") > 0) & (F.col("urls") > 0))
    errors = F.col("unfetched") + F.col("broken") + (~F.col("found")).cast("bigint")
    warnings = F.col("unknown") + F.col("bad_urls") + ((F.col("files") > 0) & (F.col("urls") == 0)).cast("bigint") + (F.col("urls") > max_urls).cast("bigint")
    return out.select("host", "found", "files", "elements", "urls", "html_estimate", "has_sitemap_xml", errors.alias("errors"), warnings.alias("warnings"), "not_crawled", "not_in_sitemap", "not_indexable")
