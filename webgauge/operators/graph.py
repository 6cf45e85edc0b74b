"""Link graph, crawl frontier, redirects, and reports by host."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..sources.shared import materialize, new_path
from .content import top_samples


def inbound(edges: DataFrame, discovered: DataFrame, least: int = 5, top: int = 200) -> DataFrame:
    """(host, url, inbound): landing pages with fewer than `least` distinct inbound links on their host, the fewest first; 0 where there is none."""
    counts = edges.select("host", "src", "dst").distinct().groupBy("host", F.col("dst").alias("url")).agg(F.count("*").alias("inbound"))
    poor = discovered.where(urls.is_landing(F.col("url"))).join(counts.hint("shuffle_merge"), ["host", "url"], "left").select("host", "url", F.coalesce("inbound", F.lit(0)).alias("inbound")).where(F.col("inbound") < least)
    return top_samples(poor, top, "inbound", "url").drop("nth")


def image_use(images: DataFrame, pages: DataFrame, rare: int = 10) -> DataFrame:
    """(host, pages, without_images, without_unique, without_rare, images): how pages share their images.

    Image counts combine before the shuffle and are joined back to the page-image rows."""
    rows = images.where("image_url is not null").select("host", "page_id", "image_url").distinct()
    counts = rows.groupBy("host", "image_url").agg(F.count("*").alias("n"))
    per = rows.join(counts.hint("shuffle_merge"), ["host", "image_url"]).groupBy("host", "page_id").agg(F.max((F.col("n") == 1).cast("int")).alias("unique"), F.max((F.col("n") < rare).cast("int")).alias("rare"))
    by_page = pages.select("host", "page_id").join(per.hint("shuffle_merge"), ["host", "page_id"], "left").groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("unique").isNull()).alias("without_images"), F.count_if(F.col("unique") == 0).alias("without_unique"), F.count_if(F.col("rare") == 0).alias("without_rare"))
    return by_page.join(counts.groupBy("host").agg(F.count("*").alias("images")).hint("shuffle_merge"), "host", "left").na.fill(0)


def frontier(edges: DataFrame, starts: DataFrame, max_pages: int = 1000, max_depth: int | None = None, allow_query: bool = True, blocked: DataFrame | None = None) -> DataFrame:
    """(host, url, depth): breadth-first from starts(host, url) over edges(host, src, dst), unique by lower-case address, `max_pages` of a host by depth and
    address (0 or less: all).  blocked(host, url) aren't entered.  Without max_depth it goes on until no new page comes.

    A level is a join with the links, an anti join with what was visited, and a cut by what is left of its host's budget; it is appended to the visited
    pages as a part of its own, so no page is written twice.  A host that has used up its budget leaves the loop, and so an endless site ends.
    """
    spark, key = edges.sparkSession, lambda c: F.lower(c)
    budget = max_pages if max_pages > 0 else (1 << 62)
    steps = edges.select("host", key("src").alias("src"), key("dst").alias("dst")).distinct()
    steps = materialize(steps if allow_query else steps.where(~F.col("dst").contains("?")))
    banned = None if blocked is None else materialize(blocked.select("host", key("url").alias("url")).distinct())
    visited = new_path(spark)
    found = starts.select("host", key("url").alias("url")).distinct()
    used = materialize(found.select("host").distinct().withColumn("used", F.lit(0).cast("bigint")))
    for depth in count() if max_depth is None else range(max_depth + 1):
        if depth and banned is not None:
            found = found.join(banned.hint("shuffle_merge"), ["host", "url"], "left_anti")
        if depth:
            found = found.join(spark.read.schema("host string, url string").parquet(visited).hint("shuffle_merge"), ["host", "url"], "left_anti")
        nth = F.row_number().over(Window.partitionBy("host").orderBy("url"))
        cut = found.withColumn("nth", nth).where(F.col("nth") <= budget).join(used.hint("shuffle_merge"), "host").where(F.col("nth") + F.col("used") <= budget)
        came = Observation()
        cut.select("host", "url").observe(came, F.count(F.lit(1)).alias("n")).write.parquet(f"{visited}/depth={depth}")
        if not came.get["n"]:
            break
        level = spark.read.schema("host string, url string").parquet(f"{visited}/depth={depth}")
        new = level.groupBy("host").agg(F.count("*").alias("n"))
        used = materialize(used.join(new.hint("shuffle_merge"), "host").select("host", (F.col("used") + F.col("n")).alias("used")).where(F.col("used") < budget))
        going = level.join(used.select("host").hint("shuffle_merge"), "host", "left_semi")
        found = going.join(steps.hint("shuffle_merge"), (going["host"] == steps["host"]) & (going["url"] == steps["src"])).select(steps["host"], F.col("dst").alias("url")).distinct()
    return spark.read.schema("host string, url string, depth int").parquet(visited)


def crawl_counters(edges: DataFrame, starts: DataFrame, seeds: DataFrame, blocked: DataFrame, results: DataFrame, max_pages: int = 1000, allow_query: bool = False) -> DataFrame:
    """(host, visited, seeded, skipped_robots, skipped_external, skipped_query, skipped_http_errors, skipped_non_html, truncated) of a crawl from starts and sitemap
    seeds(host, url) over edges(host, src, dst) to its end.  blocked(host, url): what robots files forbid.  results(host, url, status_code, content_type,
    truncated): what a visited address answered; of several answers the least by these columns counts.  Links are counted each time that a visited page has one: those to other hosts first, then those with a
    query, then blocked ones."""
    low = lambda df, *cs: df.select("host", *(F.lower(c).alias(c) for c in cs))
    banned = materialize(low(blocked, "url").distinct())
    open_seeds = low(seeds, "url").join(banned.hint("shuffle_merge"), ["host", "url"], "left_anti")
    links = materialize(edges.select("host", F.lower("src").alias("src"), F.lower("dst").alias("dst"), (F.lower(urls.host(F.col("dst"))) != F.col("host")).alias("away"), F.col("dst").contains("?").alias("asks")))
    seen = materialize(frontier(links.where(~F.col("away")), low(starts, "url").unionByName(open_seeds), max_pages, None, allow_query, banned).select("host", "url"))
    marked = links.join(seen.withColumnRenamed("url", "src").hint("shuffle_merge"), ["host", "src"]).withColumn("url", F.col("dst")).join(banned.withColumn("banned", F.lit(True)).hint("shuffle_merge"), ["host", "url"], "left")
    away, asks, banned_ = F.col("away"), F.lit(not allow_query) & F.col("asks"), F.col("banned").isNotNull()
    n = lambda c, name: F.count_if(c).alias(name)
    skipped = marked.groupBy("host").agg(n(away, "skipped_external"), n(~away & asks, "skipped_query"), n(~away & ~asks & banned_, "links_banned"))
    html = F.coalesce(F.lower("content_type").contains("html"), F.lit(False))
    good = F.col("status_code").between(200, 299)
    found = results.groupBy("host", F.lower("url").alias("url")).agg(F.min(F.struct("status_code", "content_type", "truncated")).alias("a")).select("host", "url", "a.*")
    answers = seen.join(found.hint("shuffle_merge"), ["host", "url"], "left").groupBy("host").agg(F.count("*").alias("visited"), n(~good, "skipped_http_errors"), n(good & ~html, "skipped_non_html"), n(good & html & F.col("truncated"), "truncated"))
    seeded = open_seeds.groupBy("host").agg(F.count("*").alias("seeded"))
    refused = low(seeds, "url").join(banned.hint("shuffle_merge"), ["host", "url"], "left_semi").groupBy("host").agg(F.count("*").alias("seeds_banned"))
    for part in (skipped, seeded, refused):
        answers = answers.join(part.hint("shuffle_merge"), "host", "left")
    out = answers.na.fill(0)
    return out.withColumn("skipped_robots", F.col("links_banned") + F.col("seeds_banned")).drop("links_banned", "seeds_banned")


def resolve_redirects(hops: DataFrame, starts: DataFrame, limit: int = 10) -> DataFrame:
    """(url, final_url, hops, too_many): follow hops(from_url, location) from starts(url), `limit` at most.  too_many: there is a further hop, as in a loop.  Of several locations of one
    address the first by name counts.

    Pointers of 1, 2, 4, ... hops come from joins of the pointers with themselves; those that make up the limit are followed.  An address that leads
    nowhere stands still, so a chain that ends early keeps its own number of hops.  There are as many joins as the limit has binary digits and ones.
    """
    at = starts.select("url", F.col("url").alias("final_url"), F.lit(0).alias("hops")).distinct()
    step = materialize(hops.where("from_url is not null and location is not null").groupBy(F.col("from_url").alias("at")).agg(F.min("location").alias("to")).withColumn("n", F.lit(1)))
    jump, rest = step, limit
    while rest:
        if rest & 1:
            at = materialize(at.join(jump.hint("shuffle_merge"), at["final_url"] == jump["at"], "left").select("url", F.coalesce("to", "final_url").alias("final_url"), (F.col("hops") + F.coalesce("n", F.lit(0))).alias("hops")))
        rest >>= 1
        if rest:
            on = jump.select(F.col("at").alias("to"), F.col("to").alias("further"), F.col("n").alias("more")).hint("shuffle_merge")
            jump = materialize(jump.join(on, "to", "left").select("at", F.coalesce("further", "to").alias("to"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")))
    more = at.join(step.select(F.col("at").alias("final_url"), F.lit(True).alias("more")).hint("shuffle_merge"), "final_url", "left")
    return more.select("url", "final_url", "hops", F.coalesce("more", F.lit(False)).alias("too_many"))


def domain_variants(hosts: DataFrame, hops: DataFrame) -> DataFrame:
    """(host, code): whether all four variants of a host (scheme, www.) end at the same scheme and host."""
    naked = F.regexp_replace("host", r"^www\.", "")
    variants = hosts.select("host", F.explode(F.array(*(F.concat(F.lit(s), naked, F.lit("/")) for s in ("http://", "https://", "http://www.", "https://www.")))).alias("url"))
    ends = resolve_redirects(hops, variants.select("url"))
    expected = F.concat(F.lit("https://"), F.col("host"))
    origin = F.regexp_extract("final_url", r"^(https?://[^/]+)", 1)
    return variants.join(ends.hint("shuffle_merge"), "url").groupBy("host").agg(F.bool_and(origin == expected).alias("ok")).select("host", F.when(F.col("ok"), "DOMAIN_VARIANTS_OK").otherwise("DOMAIN_VARIANTS_PROBLEM").alias("code"))


def uniformity_alerts(fetches: DataFrame, least: int = 50, every: int = 25, share: float = 0.75) -> DataFrame:
    """(host, pages, top_count): the first of a host's looks at which one content length has `share` of the pages known till then, in the order of seq.

    A look is at `least` pages and at each multiple of `every` beyond.  Pages are numbered in slices of the sorted table, so that no host is one
    task's work; the largest count till a look is a running maximum, since counts only grow.
    """
    rows = fetches.where("content_length > 0").select("host", "seq", "content_length").repartitionByRange("host", "seq")
    rows = materialize(rows.withColumn("slice", F.spark_partition_id()))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("host").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = rows.groupBy("host", "slice").agg(F.count("*").alias("n")).select("host", "slice", before.alias("before"))
    nth = F.row_number().over(Window.partitionBy("host", "slice").orderBy("seq", "content_length"))
    numbered = rows.withColumn("nth", nth).join(sizes.hint("shuffle_merge"), ["host", "slice"]).withColumn("nth", F.col("nth") + F.col("before"))
    look = F.when(F.col("nth") <= least, F.lit(least)).otherwise(F.ceil(F.col("nth") / every) * every).cast("bigint")
    counts = numbered.groupBy("host", "content_length", look.alias("look")).agg(F.count("*").alias("n"), F.max("nth").alias("last"))
    till = counts.withColumn("n", F.sum("n").over(Window.partitionBy("host", "content_length").orderBy("look")))
    looks = till.groupBy("host", "look").agg(F.max("n").alias("n"), F.max("last").alias("last")).withColumn("top_count", F.max("n").over(Window.partitionBy("host").orderBy("look")))
    hit = looks.where((F.col("last") == F.col("look")) & (F.col("top_count") >= share * F.col("look")))
    return hit.groupBy("host").agg(F.min_by(F.struct(F.col("look").alias("pages"), "top_count"), "look").alias("a")).select("host", "a.*")


def canonical_targets(canonicals: DataFrame, fetches: DataFrame, blocked: Column) -> DataFrame:
    """(page_id, code): canonical targets that fail, or that may not be indexed.  blocked: a condition on fetches."""
    known = fetches.select(urls.sitemap_url(F.col("original_url")).alias("key"), "status_code", blocked.alias("blocked"))
    wanted = canonicals.where("target is not null").select("page_id", urls.sitemap_url(F.col("target")).alias("key"))
    code = F.when(F.col("status_code") >= 400, "CANONICAL_TARGET_HTTP_ERROR").when(F.col("blocked"), "CANONICAL_TARGET_BLOCKED_OR_NOINDEX")
    return wanted.join(known, "key").select("page_id", code.alias("code")).where("code is not null")


def alias_host(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of each wanted host, or of the host with or without www. where it has none itself."""
    other = F.when(F.col("wanted").startswith("www."), F.substr("wanted", F.lit(5))).otherwise(F.concat(F.lit("www."), F.col("wanted")))
    w = wanted.select(F.col("host").alias("wanted")).distinct()
    own = w.join(rows, w["wanted"] == rows["host"])
    left = w.join(rows.select("host").distinct(), w["wanted"] == F.col("host"), "left_anti").withColumn("other", other)
    return own.unionByName(left.join(rows, left["other"] == rows["host"]).drop("other"))


def paged(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of rows by seq; limit within 1 and 5000."""
    return rows.orderBy("seq", "url").offset(max(0, offset)).limit(min(5000, max(1, limit)))


def with_results(discovered: DataFrame, results: DataFrame) -> DataFrame:
    """Each discovered address with its result, or a stub that says it hasn't been checked."""
    r = results.withColumn("found", F.lit(True))
    return discovered.join(r, "url", "left").withColumn("error", F.when(F.col("found").isNull(), "NOT_CHECKED_YET")).drop("found")


def performance(fetches: DataFrame, slow: float = 3.0, top: int = 200) -> DataFrame:
    rows = fetches.where(F.col("load_seconds") >= slow)
    worst = top_samples(rows.select("host", F.col("original_url").alias("url"), "load_seconds"), top, F.desc("load_seconds"), "url").groupBy("host").agg(F.max_by("url", -F.col("nth")).alias("slowest"))
    return fetches.groupBy("host").agg(F.count("*").alias("pages"), F.avg("load_seconds").alias("avg_seconds"), F.max("load_seconds").alias("max_seconds"), F.count_if(F.col("load_seconds") >= slow).alias("slow")).join(worst, "host", "left")


def content_lengths(fetches: DataFrame, min_pages: int = 50, share: float = 0.75) -> DataFrame:
    """(host, pages, kinds, top_length, top_count, suspicious): one length dominates a site of many pages."""
    by = fetches.groupBy("host", "content_length").agg(F.count("*").alias("n"))
    out = by.groupBy("host").agg(F.sum("n").alias("pages"), F.count("*").alias("kinds"), F.max(F.struct("n", (-F.col("content_length")).alias("minus"))).alias("top"))
    return out.select("host", "pages", "kinds", (-F.col("top.minus")).alias("top_length"), F.col("top.n").alias("top_count"), ((F.col("pages") >= min_pages) & (F.col("top.n") / F.col("pages") >= share)).alias("suspicious"))


def availability(probes: DataFrame) -> DataFrame:
    """(host, probes, ok_percent, avg_seconds, code)"""
    ok = F.bround(100.0 * F.count_if(F.col("status_code").between(200, 399)) / F.count("*"), 0)
    out = probes.groupBy("host").agg(F.count("*").alias("probes"), ok.alias("ok_percent"), F.avg("load_seconds").alias("avg_seconds"))
    return out.withColumn("code", F.when(F.col("ok_percent") < 60, "SITE_AVAILABILITY_LOW").when(F.col("ok_percent") < 100, "SITE_AVAILABILITY_UNSTABLE"))


def size_stability(probes: DataFrame, most: int = 2048) -> DataFrame:
    out = probes.groupBy("url").agg(F.count("*").alias("n"), F.min("body_size").alias("least"), F.max("body_size").alias("largest"))
    return out.withColumn("code", F.when(F.col("n") < 2, "DOC_SIZE_CHECK_FAILED").when(F.col("largest") - F.col("least") > most, "DOC_SIZE_UNSTABLE"))


def soft_404(probes: DataFrame) -> DataFrame:
    """For addresses that can't exist: what they answer."""
    root = F.regexp_extract("url", r"^https?://[^/?#]+(/[^?#]*)", 1) == "/"
    return probes.withColumn("code", F.when(F.col("status_code").isin(404, 410), None).when((F.col("status_code") == 200) | root, "SOFT_404").otherwise("FAKE_404_NOT_OK"))


def first_by_key(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """Distinct by the lower-case key; the first spelling stays."""
    return rows.groupBy(F.lower(key).alias("folded")).agg(F.min_by(key, F.struct(seq, key)).alias(key))


