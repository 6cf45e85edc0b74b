"""Queries over texts: duplicates, near-duplicates, thin and stuffed pages, and their reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import checks, content, extract
from . import duck as d
from .fixtures import view
from .pages import FLAT, HEAD, ROOTED
from .registry import query


def _titles(spark: SparkSession, sf_dir: str, field: str) -> DataFrame:
    return checks.seo_facts(view(spark, sf_dir, "pages_ext")).select("host", F.col("page_id").alias("seq"), "url", F.col(field).alias("value"))


def _groups(field: str) -> str:
    return f"SELECT host, key, count(*) AS n, CASE WHEN length(key) > 200 THEN substr(key, 1, 200) || '…' ELSE key END AS preview, array_to_string(list(url ORDER BY page_id)[1:10], ' ') AS urls FROM (SELECT host, page_id, url, substr({d.fold(field)}, 1, 1000) AS key FROM head) k WHERE key <> '' GROUP BY host, key HAVING count(*) >= 2 QUALIFY row_number() OVER (PARTITION BY host ORDER BY count(*) DESC, key) <= 200"


@query(_groups("title"), head=HEAD)
def d1_duplicate_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.duplicate_groups(_titles(spark, sf_dir, "title"), text.fold(F.col("value")))


@query(_groups("description"), head=HEAD)
def d1_a2_duplicate_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.duplicate_groups(_titles(spark, sf_dir, "description"), text.fold(F.col("value")))


@query(f"SELECT host, page_id AS seq, url FROM (SELECT *, {d.fold('title')} AS key FROM head) k WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY host, key ORDER BY page_id) >= 2", head=HEAD)
def d2_w5_repeated_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.repeated(_titles(spark, sf_dir, "title"), text.fold(F.col("value"))).select("host", "seq", "url")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "documents").select(F.col("source").alias("host"), F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("url"), "text")


@query(f"SELECT host, upper(sha256(key)) AS hash, count(*) AS n FROM (SELECT source AS host, {d.fold('text')} AS key FROM documents) k GROUP BY host, key HAVING count(*) >= 2")
def d3_exact_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy("host", content.content_hash(F.col("text")).alias("hash")).agg(F.count("*").alias("n")).where("n >= 2")


def _fnv(t: str) -> str:
    return f"list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split({t}, ''), lambda c: (ord(c) & 255)::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"


TOKENS = "SELECT source AS host, doc_id AS seq, token, count(*) AS w FROM (SELECT source, doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]{2,}')) AS token FROM documents) t GROUP BY ALL"
HASHED = f"SELECT token, {_fnv('token')} AS h FROM (SELECT DISTINCT token FROM tokens) u"
SIMHASH = "SELECT host, seq, CAST(CASE WHEN u >= 9223372036854775808::UHUGEINT THEN u::HUGEINT - 18446744073709551616 ELSE u::HUGEINT END AS BIGINT) AS simhash, u FROM (SELECT host, seq, (" + " + ".join(f"CASE WHEN sum(CASE WHEN (h >> {k}::UHUGEINT) % 2 = 1 THEN w ELSE -w END) > 0 THEN {1 << k}::UHUGEINT ELSE 0::UHUGEINT END" for k in range(64)) + ") AS u FROM tokens JOIN hashed USING (token) GROUP BY host, seq) s"
BANDS = "SELECT host, seq, u, k, (u >> (16 * k)::UHUGEINT) % 65536 AS part FROM simhashes, (SELECT unnest(range(4)) AS k) b"
NEAR = "SELECT a.host, a.seq, arg_min(b.seq, bit_count(CAST(xor(a.u, b.u) AS BIT)) * 1000000 + b.seq) AS other, min(bit_count(CAST(xor(a.u, b.u) AS BIT))) AS distance FROM bands a JOIN bands b ON a.host = b.host AND a.k = b.k AND a.part = b.part AND b.seq < a.seq WHERE bit_count(CAST(xor(a.u, b.u) AS BIT)) <= 5 GROUP BY a.host, a.seq"


@query("SELECT host, seq, simhash FROM simhashes", tokens=TOKENS, hashed=HASHED, simhashes=SIMHASH)
def d4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.simhash(_docs(spark, sf_dir))


@query("SELECT host, seq, other, CAST(distance AS INTEGER) AS distance FROM near", tokens=TOKENS, hashed=HASHED, simhashes=SIMHASH, bands=BANDS, near=NEAR)
def d5_j12_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.near_pairs(content.simhash(_docs(spark, sf_dir)))


@query("SELECT page_id, length(visible) AS chars, len(regexp_extract_all(lower(visible), '[\\p{L}\\p{Nd}]{2,}')) AS words, length(visible) < 600 OR len(regexp_extract_all(lower(visible), '[\\p{L}\\p{Nd}]{2,}')) < 120 OR length(visible) / length(html) < 0.05 AS thin FROM flat", flat=FLAT)
def p21_thin_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = content.thin(view(spark, sf_dir, "pages_ext"), extract.visible_text_flat(F.col("html")))
    return made.select("page_id", F.col("chars").cast("bigint").alias("chars"), F.col("words").cast("bigint").alias("words"), "thin")


@query("SELECT page_id, length(visible) AS chars, len(regexp_extract_all(lower(visible), '[\\p{L}\\p{Nd}]{2,}')) AS words, length(visible) < 600 OR len(regexp_extract_all(lower(visible), '[\\p{L}\\p{Nd}]{2,}')) < 120 OR length(visible) / length(html) < 0.05 AS thin FROM rooted", rooted=ROOTED)
def p21_u19_thin_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the text of the article, read as a tree."""
    made = content.thin_pages(view(spark, sf_dir, "pages_ext"))
    return made.select("page_id", F.col("chars").cast("bigint").alias("chars"), F.col("words").cast("bigint").alias("words"), "thin")


@query(f"SELECT host, upper(sha256({d.fold('visible')})) AS hash, count(*) AS n FROM (SELECT host, visible FROM rooted UNION ALL SELECT host, visible FROM rooted WHERE page_id % 5 = 0) x GROUP BY ALL HAVING count(*) >= 2", rooted=ROOTED)
def d3_u19_page_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fifth page occurs twice, the second time with other boxes around its article."""
    pages = view(spark, sf_dir, "pages_ext").select("page_id", "host", "html")
    again = pages.where("page_id % 5 = 0").withColumn("html", F.regexp_replace("html", "<article", "<aside><div hidden>x</div><aside>y</aside></aside><article"))
    return content.page_copies(pages.unionByName(again))


#: Fixed values, written out apart from the library's own so that a mistake there would show: Russian and English stop words.
STOPPED = ", ".join(map(d.q, (
    "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по ее мне было вот от меня еще нет о из ему теперь когда даже ну вдруг ли если уже или ни быть был него до "
    "вас нибудь опять уж вам ведь там потом себя ничего ей может они тут где есть надо ней для мы тебя их чем была сам чтоб без будто чего раз тоже себе под будет ж тогда кто этот того потому этого какой совсем ним здесь этом один почти мой тем чтобы нее кажется "
    "the and for with that this you your from are was were have has had not but they their them his her she him our ours what when where who why how a an to in on of as at by or if it is be"
).split()))

STUFFED = (
    "SELECT seq, token, w AS n, total, kinds AS \"distinct\" FROM (SELECT *, sum(w) OVER (PARTITION BY seq) AS total, count(*) OVER (PARTITION BY seq) AS kinds, row_number() OVER (PARTITION BY seq ORDER BY "
    f"length(token) >= 3 AND token NOT IN ({STOPPED}) DESC, w DESC, token) AS r FROM tokens) t WHERE r = 1 AND total >= 120 AND (w / total >= 0.09 AND kinds / total <= 0.35 OR w >= 80)"
)


@query("SELECT * REPLACE (CAST(total AS BIGINT) AS total) FROM stuffed", tokens=TOKENS, stuffed=STUFFED)
def p22_keyword_stuffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.stuffing(_docs(spark, sf_dir))


@query(
    f"SELECT h.host, coalesce(s.n, 0) AS stuffed, coalesce(e.n, 0) AS exact_groups, coalesce(p.n, 0) AS near_pairs FROM (SELECT DISTINCT source AS host FROM documents) h LEFT JOIN (SELECT host, count(*) AS n FROM (SELECT DISTINCT host, seq FROM tokens) t JOIN stuffed USING (seq) GROUP BY host) s USING (host) LEFT JOIN (SELECT host, count(*) AS n FROM (SELECT source AS host, {d.fold('text')} AS key FROM documents GROUP BY ALL HAVING count(*) >= 2) g GROUP BY host) e USING (host) LEFT JOIN (SELECT host, count(*) AS n FROM near GROUP BY host) p USING (host)",
    tokens=TOKENS, hashed=HASHED, simhashes=SIMHASH, bands=BANDS, near=NEAR, stuffed=STUFFED,
)
def a1_content_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    count = lambda df, name: df.groupBy("host").agg(F.count("*").alias(name))
    stuffed = count(content.stuffing(docs).hint("shuffle_merge").join(docs.select("host", "seq"), "seq"), "stuffed")
    exact = count(docs.groupBy("host", content.content_hash(F.col("text")).alias("hash")).count().where("count >= 2"), "exact_groups")
    near = count(content.near_pairs(content.simhash(docs)), "near_pairs")
    out = docs.select("host").distinct().join(stuffed, "host", "left").join(exact, "host", "left").join(near, "host", "left")
    return out.na.fill(0)
