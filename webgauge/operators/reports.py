"""Reports by host: counters, and lists of samples that are cut before they are gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls
from ..sources.shared import materialize
from . import checks, content, graph
from .content import top_samples
from .near_blocks import near_pairs


def listed(rows: DataFrame, name: str, n: int, *order: Column | str, value: Column | None = None) -> DataFrame:
    """(host, name): the first n values of each host by `order`, joined by blanks.  A window limit cuts each task's rows before the shuffle."""
    first = top_samples(rows.withColumn("shown", F.col("url") if value is None else value), n, *order)
    return first.groupBy("host").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "shown"))), lambda s: s["shown"]), " ").alias(name))


def with_lists(by_host: DataFrame, *lists: DataFrame) -> DataFrame:
    """Counters by host with their lists; an empty string where a host has no sample."""
    for one in lists:
        by_host = by_host.join(one.hint("shuffle_merge"), "host", "left")
    return by_host.na.fill("", [c for one in lists for c in one.columns if c != "host"])


def canonical_report(pages: DataFrame, fetches: DataFrame, blocked: Column, n: int = 50) -> DataFrame:
    """Nine counters and four lists of pages by page_id; a page whose target both fails and is blocked counts as failing."""
    facts = materialize(checks.canonical_facts(pages))
    codes = graph.canonical_targets(facts, fetches, blocked).groupBy("page_id").agg(F.max("code").alias("code"))
    there, first, other = F.size("canonicals") > 0, F.col("first"), urls.host(F.col("target"))
    bare = there & urls.missing_scheme(first)
    yes = lambda c: F.coalesce(c, F.lit(False))
    flags = {
        "with_canonical": there, "multiple": F.size("canonicals") > 1, "in_body": F.col("in_body"), "missing_scheme": bare, "cross_domain": there & ~bare & (other != F.col("host")),
        "target_http_errors": F.col("code") == "CANONICAL_TARGET_HTTP_ERROR", "target_blocked": F.col("code") == "CANONICAL_TARGET_BLOCKED_OR_NOINDEX", "invalid": there & (F.trim(first) != "") & other.isNull(),
    }
    rows = materialize(facts.join(codes.hint("shuffle_merge"), "page_id", "left").select("page_id", "host", "url", *(yes(c).alias(k) for k, c in flags.items())))
    counts = rows.groupBy("host").agg(F.count("*").alias("pages"), *(F.count_if(F.col(k)).alias(k) for k in flags))
    return with_lists(counts, *(listed(rows.where(k), f"{k}_urls", n, "page_id") for k in ("invalid", "target_http_errors", "target_blocked", "cross_domain")))


def noindex_report(found: DataFrame, n: int = 200) -> DataFrame:
    """(host, noindex, urls) of found(host, url): pages that say noindex."""
    distinct = found.select("host", "url").distinct()
    return with_lists(distinct.groupBy("host").agg(F.count("*").alias("noindex")), listed(distinct, "urls", n, "url"))


def image_meta_report(pages: DataFrame, n: int = 200) -> DataFrame:
    rows = materialize(checks.image_meta(pages))
    counts = rows.groupBy("host").agg(F.count("*").alias("pages"), F.sum("images").alias("images"), F.avg("images").alias("avg_images"), F.sum("empty_alt").alias("empty_alt"), F.sum("empty_title").alias("empty_title"))
    return with_lists(counts, *(listed(rows.where(F.col(k) > 0), f"{k}_urls", n, F.desc(k), "url") for k in ("empty_alt", "empty_title")))


def outgoing_report(pages: DataFrame, many: int = 200, n: int = 200) -> DataFrame:
    rows = materialize(checks.outgoing(pages).select("host", "url", "internal", "external"))
    counts = rows.groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("internal") == 0).alias("no_internal"), F.count_if(F.col("internal") > many).alias("many_internal"), F.count_if(F.col("external") > 0).alias("any_external"))
    lists = [("no_internal", F.col("internal") == 0, ("url",)), ("many_internal", F.col("internal") > many, (F.desc("internal"), "url")), ("any_external", F.col("external") > 0, (F.desc("external"), "url"))]
    return with_lists(counts, *(listed(rows.where(c), f"{k}_urls", n, *order) for k, c, order in lists))


def performance_report(fetches: DataFrame, slow: float = 3.0, n: int = 200) -> DataFrame:
    rows = fetches.select("host", F.col("original_url").alias("url"), "load_seconds")
    return with_lists(graph.performance(fetches, slow), listed(rows, "slow_pages", n, F.desc("load_seconds"), "url"))


def length_report(fetches: DataFrame, n: int = 20) -> DataFrame:
    """Content lengths of each host with their histogram's top; unknown lengths and 0 don't count."""
    known = fetches.where("content_length > 0").select("host", "content_length")
    by = known.groupBy("host", "content_length").agg(F.count("*").alias("n"))
    shown = F.concat_ws(":", F.col("content_length").cast("string"), F.col("n").cast("string"))
    out = graph.content_lengths(known).withColumn("top_share", F.col("top_count") / F.col("pages")).withColumn("code", F.when(F.col("suspicious"), "CONTENT_LENGTH_UNIFORMITY"))
    return with_lists(out, listed(by, "histogram", n, F.desc("n"), "content_length", value=shown))


def image_use_report(images: DataFrame, pages: DataFrame, rare: int = 10, n: int = 100, top: int = 50) -> DataFrame:
    """image_use with lists of the pages without images, unique and rare ones, and with the images that most pages share."""
    rows = materialize(images.where("image_url is not null").select("host", "page_id", "image_url").distinct())
    counts = materialize(rows.groupBy("host", "image_url").agg(F.count("*").alias("n")))
    per = rows.join(counts.hint("shuffle_merge"), ["host", "image_url"]).groupBy("host", "page_id").agg(F.max((F.col("n") == 1).cast("int")).alias("unique"), F.max((F.col("n") < rare).cast("int")).alias("rare"))
    facts = materialize(pages.select("host", "page_id", "url").join(per.hint("shuffle_merge"), ["host", "page_id"], "left"))
    flags = {"without_images": F.col("unique").isNull(), "without_unique": F.col("unique") == 0, "without_rare": F.col("rare") == 0}
    by_host = facts.groupBy("host").agg(F.count("*").alias("pages"), *(F.count_if(c).alias(k) for k, c in flags.items()))
    by_host = by_host.join(counts.groupBy("host").agg(F.count("*").alias("images")).hint("shuffle_merge"), "host", "left").na.fill(0, ["images"])
    most = listed(counts, "most_shared", top, F.desc("n"), "image_url", value=F.concat_ws("=", "image_url", F.col("n").cast("string")))
    return with_lists(by_host, *(listed(facts.where(c), f"{k}_urls", n, "url") for k, c in flags.items()), most)


def worst_pages(rows: DataFrame, n: int, lists: dict[str, tuple[Column, list[Column | str]]], *figures: str) -> DataFrame:
    """(host, kind, nth, url, figures): for each list the first n pages of each host that meet its condition, in its order, with their figures.

    One pass: a page is a row for each list that it is in; a window limit cuts them within each task before the shuffle."""
    rows = materialize(rows.select("host", "url", *figures))
    out = None
    for kind, (condition, order) in lists.items():
        one = top_samples(rows.where(condition), n, *order).select("host", F.lit(kind).alias("kind"), "nth", "url", *figures)
        out = one if out is None else out.unionByName(one)
    return out


def image_pages(pages: DataFrame, n: int = 200) -> DataFrame:
    """The pages with most images without alt, and without title, each with its number of images and both figures."""
    return worst_pages(checks.image_meta(pages), n, {k: (F.col(k) > 0, [F.desc(k), "url"]) for k in ("empty_alt", "empty_title")}, "images", "empty_alt", "empty_title")


def outgoing_pages(pages: DataFrame, many: int = 200, n: int = 200) -> DataFrame:
    """Pages without internal, with very many internal and with external links, each with both numbers."""
    lists = {"no_internal": (F.col("internal") == 0, ["url"]), "many_internal": (F.col("internal") > many, [F.desc("internal"), "url"]), "any_external": (F.col("external") > 0, [F.desc("external"), "url"])}
    return worst_pages(checks.outgoing(pages), n, lists, "internal", "external")


def slow_pages(fetches: DataFrame, n: int = 200) -> DataFrame:
    """The slowest pages with their seconds."""
    return worst_pages(fetches.select("host", F.col("original_url").alias("url"), "load_seconds"), n, {"slow": (F.col("load_seconds").isNotNull(), [F.desc("load_seconds"), "url"])}, "load_seconds")


def content_report(docs: DataFrame, o: checks.Options = checks.Options(), n: int = 50, groups: int = 200, pairs: int = 500) -> DataFrame:
    """By host of docs(host, seq, url, text, html_chars), visible texts: thin pages and stuffed ones with n samples each, groups of equal texts (the `groups` largest as
    hash=count), near pairs (the `pairs` nearest as url~url=distance).

    Counters are true counts.  Each text is tokenised once; its facts are written out and every part reads those.
    """
    tokens = text.tokenize(F.col("text"))
    facts = materialize(docs.select("host", "seq", "url", F.coalesce(F.length("text"), F.lit(0)).alias("chars"), F.coalesce("html_chars", F.lit(0)).alias("html_chars"), tokens.alias("tokens"), content.content_hash(F.col("text")).alias("hash"), F.coalesce(text.fold(F.col("text")) == "", F.lit(True)).alias("blank")))
    thin = facts.select("host", "seq", "url", "chars", "html_chars", F.greatest(F.coalesce(F.size("tokens"), F.lit(0)), F.lit(0)).alias("words")).where(checks.thin_page(o))
    stuffed = facts.select("host", "url", "seq").join(content.stuffing_of(facts, o).select("seq").hint("shuffle_merge"), "seq")
    equal = materialize(facts.where("not blank").groupBy("host", "hash").agg(F.count("*").alias("n")).where("n >= 2"))
    urls_ = facts.select("host", "seq", "url")
    near = materialize(near_pairs(content.simhash_of(facts)))
    named = near.join(urls_.hint("shuffle_merge"), ["host", "seq"]).join(urls_.select("host", F.col("seq").alias("other"), F.col("url").alias("other_url")).hint("shuffle_merge"), ["host", "other"])
    count = lambda rows, name: rows.groupBy("host").agg(F.count("*").alias(name)).hint("shuffle_merge")
    out = facts.groupBy("host").agg(F.count("*").alias("pages"))
    for rows, name in ((thin, "thin"), (stuffed, "stuffed"), (equal, "exact_groups"), (near, "near_pairs")):
        out = out.join(count(rows, name), "host", "left").na.fill(0, [name])
    lists = [
        listed(thin, "thin_urls", n, "url"), listed(stuffed, "stuffed_urls", n, "url"), listed(equal, "largest_groups", groups, F.desc("n"), "hash", value=F.concat_ws("=", "hash", F.col("n").cast("string"))),
        listed(named, "nearest_pairs", pairs, "distance", "url", "other_url", value=F.concat(F.col("url"), F.lit("~"), F.col("other_url"), F.lit("="), F.col("distance").cast("string"))),
    ]
    return with_lists(out, *lists)
