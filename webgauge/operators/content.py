"""Duplicate and near-duplicate content, thin and stuffed pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import extract
from .checks import Options, thin_page
from .near_blocks import near_pairs

#: Frequent words that never count as stuffing, Russian and English ones.
STOP_WORDS = (
    "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по ее мне было вот от меня еще нет о из ему теперь когда даже ну вдруг ли если уже или ни быть был него до "
    "вас нибудь опять уж вам ведь там потом себя ничего ей может они тут где есть надо ней для мы тебя их чем была сам чтоб без будто чего раз тоже себе под будет ж тогда кто этот того потому этого какой совсем ним здесь этом один почти мой тем чтобы нее кажется "
    "the and for with that this you your from are was were have has had not but they their them his her she him our ours what when where who why how a an to in on of as at by or if it is be"
).split()


def duplicate_groups(rows: DataFrame, key: Column, top: int = 200, samples: int = 10) -> DataFrame:
    """(host, key, n, preview, urls): keys that occur twice or more on a host, the largest groups first.

    Counts combine before the shuffle.  Samples are the first by seq: only rows that a window limit leaves are gathered, so a group of any size
    fits in memory.
    """
    keyed = rows.select("host", F.substring(key, 1, 1000).alias("key"), "seq", "url").where("key <> ''")
    counts = keyed.groupBy("host", "key").agg(F.count("*").alias("n")).where("n >= 2")
    nth = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "key"))
    largest = counts.withColumn("nth", nth).where(F.col("nth") <= top).drop("nth")
    first = F.row_number().over(Window.partitionBy("host", "key").orderBy("seq", "url"))
    sampled = keyed.withColumn("nth", first).where(F.col("nth") <= samples).groupBy("host", "key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "url"))), lambda s: s["url"]), " ").alias("urls"))
    return largest.join(sampled, ["host", "key"]).select("host", "key", "n", text.preview(F.col("key"), 200).alias("preview"), "urls")


def repeated(rows: DataFrame, key: Column) -> DataFrame:
    """Rows that are not the first of their host with this key, by seq.

    The first of each key comes from an aggregate that combines before the shuffle, not from a window over the whole group.
    """
    keyed = rows.withColumn("key", key).where("key <> ''")
    first = keyed.groupBy("host", "key").agg(F.min("seq").alias("first"))
    return keyed.join(first.hint("shuffle_merge"), ["host", "key"]).where("seq > first").drop("first")


def content_hash(c: Column) -> Column:
    return F.upper(F.sha2(text.fold(c).cast("binary"), 256))


#: Two counters in a bigint: bits k and k + 32 of a hash are summed together.
LANES = 0x0000000100000001


def simhash(docs: DataFrame) -> DataFrame:
    """(host, seq, simhash) of docs(host, seq, text): 64 bits by term weights.  Each distinct token of a text is hashed once.  A bit is set where the tokens that have it
    weigh more than half of the text; weights of two bits share a sum, so 32 sums do."""
    return _simhash(counted(docs.select("host", "seq", "text"), text.tokenize(F.col("text"))))


def simhash_of(docs: DataFrame) -> DataFrame:
    """simhash() of docs(host, seq, tokens)."""
    return _simhash(counted(docs.select("host", "seq", "tokens"), F.col("tokens")))


def counted(docs: DataFrame, tokens: Column) -> DataFrame:
    """(host, seq or seq alone, token, w) of docs, which have one more column, out of which come `tokens`.  Whole texts are dealt out by seq, each once; their tokens are
    counted, and what is counted by seq after that is summed up, where they are, so no token travels."""
    own = [c for c in ("host", "seq") if c in docs.columns]
    return docs.repartition("seq").select(*own, F.explode(tokens).alias("token")).groupBy(*own, "token").agg(F.count("*").alias("w"))


def _simhash(tokens: DataFrame) -> DataFrame:
    pair = lambda k: F.shiftrightunsigned("h", k).bitwiseAND(F.lit(LANES).cast("bigint")) * F.col("w")
    sums = tokens.withColumn("h", text.fnv1a(F.col("token"))).groupBy("host", "seq").agg(F.sum("w").alias("total"), *(F.sum(pair(k)).alias(f"b{k}") for k in range(32)))
    value = F.lit(0).cast("bigint")
    for k in range(64):
        ones = F.shiftrightunsigned(f"b{k - 32}", 32) if k >= 32 else F.col(f"b{k}").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
        value = value.bitwiseOR(F.when(ones * 2 > F.col("total"), F.shiftleft(F.lit(1).cast("bigint"), k)).otherwise(F.lit(0).cast("bigint")))
    return sums.select("host", "seq", value.alias("simhash"))


def stuffing(docs: DataFrame, o: Options = Options()) -> DataFrame:
    """(seq, token, n, total, distinct) of texts that repeat one word too often.  The top token is the most frequent that is no stop word and three long;
    where there is none, the most frequent of all."""
    return _stuffing(counted(docs.select("seq", "text"), text.tokenize(F.col("text"))), o)


def stuffing_of(docs: DataFrame, o: Options = Options()) -> DataFrame:
    """stuffing() of docs(seq, tokens)."""
    return _stuffing(counted(docs.select("seq", "tokens"), F.col("tokens")), o)


def _stuffing(counts: DataFrame, o: Options) -> DataFrame:
    tokens = counts.withColumnRenamed("w", "n")
    plain = (F.length("token") >= 3) & ~F.col("token").isin(STOP_WORDS)
    best = lambda c: F.min(F.when(c, F.struct((-F.col("n")).alias("m"), "token")))
    per = tokens.groupBy("seq").agg(F.sum("n").alias("total"), F.count("*").alias("distinct"), best(plain).alias("own"), best(F.lit(True)).alias("any"))
    top = per.select("seq", "total", "distinct", F.coalesce("own", "any").alias("t")).select("seq", "t.token", (-F.col("t.m")).alias("n"), "total", "distinct")
    return top.where((F.col("total") >= o.spam_tokens) & (((F.col("n") / F.col("total") >= o.spam_ratio) & (F.col("distinct") / F.col("total") <= o.spam_unique)) | (F.col("n") >= o.spam_count)))


def thin(pages: DataFrame, visible: Column, o: Options = Options()) -> DataFrame:
    facts = pages.withColumn("visible", visible).select("page_id", "host", "url", F.length("visible").alias("chars"), F.size(text.tokenize(F.col("visible"))).alias("words"), F.length("html").alias("html_chars"))
    return facts.withColumn("thin", thin_page(o))


def thin_pages(pages: DataFrame, o: Options = Options()) -> DataFrame:
    """thin() of pages(page_id, host, url, html) by the text of their nearest root, in which hidden parts may nest; a page that can't be read has an empty text."""
    read = extract.visible_text(pages.withColumn("html_chars", F.length("html")), keep=["host", "url", "html_chars"]).withColumn("visible", F.coalesce("visible_text", F.lit("")))
    facts = read.select("page_id", "host", "url", F.length("visible").alias("chars"), F.size(text.tokenize(F.col("visible"))).alias("words"), F.coalesce("html_chars", F.lit(0)).alias("html_chars"))
    return facts.withColumn("thin", thin_page(o))


def page_copies(pages: DataFrame) -> DataFrame:
    """(host, hash, n): visible texts that two pages or more of a host share, by the same reading; pages without text have no copies."""
    read = extract.visible_text(pages, keep=["host"]).where(F.trim("visible_text") != "")
    return read.groupBy("host", content_hash(F.col("visible_text")).alias("hash")).agg(F.count("*").alias("n")).where("n >= 2")


def content_issues(docs: DataFrame, o: Options = Options()) -> DataFrame:
    """(seq, code) of docs(host, seq, text), visible texts: later copies of an equal text, later near copies of another, stuffed texts."""
    keyed = docs.select("host", "seq", content_hash(F.col("text")).alias("hash")).where(F.col("hash") != F.upper(F.sha2(F.lit("").cast("binary"), 256)))
    coded = lambda df, code: df.select("seq", F.lit(code).alias("code"))
    copies = repeated(keyed, F.col("hash"))
    near = near_pairs(simhash(docs)).join(copies.select("seq").hint("shuffle_merge"), "seq", "left_anti")
    return coded(copies, "CONTENT_EXACT_DUPLICATE").unionByName(coded(near, "CONTENT_NEAR_DUPLICATE")).unionByName(coded(stuffing(docs, o), "CONTENT_KEYWORD_STUFFING"))


def top_samples(rows: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows of each host by `order`; a window limit cuts each task's rows before the shuffle."""
    nth = F.row_number().over(Window.partitionBy("host").orderBy(*order))
    return rows.withColumn("nth", nth).where(F.col("nth") <= n)
