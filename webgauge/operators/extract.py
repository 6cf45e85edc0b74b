"""Page facts out of HTML: one scan of the markup by regular expressions, for flat facts; the tree only for visible text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls


def attribute(tag: Column, name: str) -> Column:
    """A quoted attribute's value in a tag's text, null if it has none."""
    pattern = rf"(?i)[\s\"'/]{name}\s*=\s*[\"']([^\"']*)[\"']"
    return F.when(tag.rlike(pattern), F.regexp_extract(tag, pattern, 1))


def tags(html: Column, names: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?i)<(?:{names})(?:[\s/][^>]*)?>"), F.lit(0))


def links(pages: DataFrame, cap: int = 2000) -> DataFrame:
    """(page_id, host, pos, ref, src, dst) of the anchors that lead to pages; dst as graph address.  The cap cuts the
    array before it is exploded, so no shuffle is needed."""
    found = pages.select("page_id", "host", "url", F.slice(tags(F.col("html"), "a"), 1, cap).alias("tags"))
    refs = found.select("page_id", "host", "url", F.posexplode("tags").alias("pos", "tag")).withColumn("ref", F.trim(attribute(F.col("tag"), "href")))
    kept = refs.where(urls.is_checkable(F.col("ref")))
    return kept.select("page_id", "host", "pos", "ref", urls.graph_url(F.col("url")).alias("src"), urls.graph_url(urls.resolve(F.col("url"), F.col("ref"))).alias("dst"))


def images(pages: DataFrame, cap: int = 500) -> DataFrame:
    found = pages.select("page_id", "host", "url", F.posexplode(F.slice(tags(F.col("html"), "img"), 1, cap)).alias("pos", "tag"))
    a = lambda n: attribute(F.col("tag"), n)
    return found.select("page_id", "host", "pos", a("src").alias("src"), a("alt").alias("alt"), a("title").alias("title"), a("class").alias("class"), a("role").alias("role"), a("aria-hidden").alias("aria_hidden"), urls.image_url(urls.resolve(F.col("url"), a("src"))).alias("image_url"))


def _trimmed(found: Column, name: str) -> Column:
    return F.transform(found, lambda t: F.trim(attribute(t, name)))


KINDS = {"js": ("script", "src"), "css": ("link", "href"), "image": ("img", "src"), "link": ("a", "href")}


def resources(pages: DataFrame, cap: int = 15) -> DataFrame:
    """(page_id, host, kind, pos, target) of scripts, style sheets, images and anchors, `cap` of a kind on a page."""
    out = None
    for kind, (tag, name) in KINDS.items():
        found = tags(F.col("html"), tag)
        if kind == "css":
            found = F.filter(found, lambda t: F.coalesce(F.lower(attribute(t, "rel")).contains("stylesheet"), F.lit(False)))
        kept = F.slice(F.filter(_trimmed(found, name), lambda r: urls.is_checkable(r, True)), 1, cap)
        part = pages.select("page_id", "host", "url", F.posexplode(kept).alias("pos", "ref")).select("page_id", "host", F.lit(kind).alias("kind"), "pos", urls.resolve(F.col("url"), F.col("ref")).alias("target"))
        out = part if out is None else out.unionByName(part)
    return out


def external_hosts(pages: DataFrame, cap: int = 40) -> DataFrame:
    """(page_id, host, external) of other hosts in links, images, scripts and frames; the first `cap` by name on a page."""
    refs = F.transform(tags(F.col("html"), "a|img|script|link|iframe"), lambda t: F.coalesce(attribute(t, "href"), attribute(t, "src")))
    hosts = F.transform(F.filter(refs, lambda r: r.rlike(r"(?i)^\s*https?://")), lambda r: urls.host(r))
    kept = F.slice(F.array_sort(F.array_distinct(F.filter(hosts, lambda h: h.isNotNull() & (h != F.col("host"))))), 1, cap)
    return pages.select("page_id", "host", F.explode(kept).alias("external"))


def metas(html: Column) -> Column:
    """Array of (name, content) of the meta tags that have a name."""
    return F.filter(F.transform(tags(html, "meta"), lambda t: F.struct(F.lower(attribute(t, "name")).alias("name"), attribute(t, "content").alias("content"))), lambda m: m["name"].isNotNull())


def canonicals(html: Column) -> Column:
    """Targets of the canonical links as they are written, in order."""
    return F.transform(F.filter(tags(html, "link"), lambda t: F.lower(attribute(t, "rel")).contains("canonical")), lambda t: F.coalesce(attribute(t, "href"), F.lit("")))


def head_facts(pages: DataFrame) -> DataFrame:
    """(page_id, host, url, titles, h1s, metas, canonicals, doctype): the facts that head checks share."""
    html = F.col("html")
    inner = lambda tag: F.transform(F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1)), lambda s: F.trim(F.regexp_replace(text.decode_entities(F.regexp_replace(s, "<[^>]*>", "")), text.SPACE, " ")))
    return pages.select("page_id", "host", "url", inner("title").alias("titles"), inner("h1").alias("h1s"), metas(html).alias("metas"), canonicals(html).alias("canonicals"), F.lower(F.regexp_extract(html, r"(?i)<!doctype\s+([^>]*)>", 1)).alias("doctype"))


#: Fixed value: elements whose text is not seen or not content.
HIDDEN = "script|style|noscript|template|svg|canvas|iframe|header|footer|nav|aside|form|button|input|select|textarea"


def visible_text_flat(html: Column) -> Column:
    """Visible text where hidden elements don't nest: the body without them, tags and comments."""
    body = F.regexp_replace(html, r"(?is)^.*<body[^>]*>", "")
    for tag in HIDDEN.split("|"):
        body = F.regexp_replace(body, rf"(?is)<{tag}(\s[^>]*)?>.*?</{tag}>", " ")
    return F.trim(F.regexp_replace(text.decode_entities(F.regexp_replace(F.regexp_replace(body, r"(?s)<!--.*?-->", " "), "<[^>]*>", " ")), text.SPACE, " "))


class _Visible(HTMLParser):
    """Texts by the nearest root: main, article, role=main, body, document; without hidden subtrees."""

    SKIP = frozenset(HIDDEN.split("|"))
    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # Of each open element: whether it's hidden, and the roots around it as bits.
        self.open: list[tuple[str, bool, int]] = [("", False, 1 << 4)]
        self.depths: dict[str, list[int]] = {}
        """Where in `open` the elements of a tag are."""
        self.texts: dict[int, list[str]] = {}
        self.firsts: set[int] = set()

    def parse_html_declaration(self, i: int) -> int:
        """A declaration that is none is a comment, as in browsers."""
        try:
            return super().parse_html_declaration(i)
        except AssertionError:
            return self.parse_bogus_comment(i)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: (v or "").lower().replace(" ", "") for k, v in attrs}
        hidden = tag in self.SKIP or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "") or "visibility:hidden" in a.get("style", "")
        root = 0 if tag == "main" else 1 if tag == "article" else 2 if a.get("role") == "main" else 3 if tag == "body" else 9
        if root < 9 and root in self.firsts:
            root = 9  # only the first of a kind is a root
        self.firsts.add(root)
        self.data(" ")
        if tag not in self.VOID:
            self.depths.setdefault(tag, []).append(len(self.open))
            self.open.append((tag, self.open[-1][1] or hidden, self.open[-1][2] | 1 << root))

    def handle_endtag(self, tag: str) -> None:
        if self.depths.get(tag):
            at = self.depths[tag][-1]
            for name, _, _ in self.open[at:]:
                self.depths[name].pop()
            del self.open[at:]
        self.data(" ")

    def data(self, data: str) -> None:
        _, hidden, roots = self.open[-1]
        if not hidden:
            for root in range(5):
                if roots >> root & 1:
                    self.texts.setdefault(root, []).append(data)

    handle_data = data


def _visible(html: str | None) -> str:
    tree = _Visible()
    tree.feed(html or "")
    tree.close()
    root = min((r for r in tree.firsts | {4} if r < 9), default=4)
    return " ".join("".join(tree.texts.get(root, [])).split())


def visible_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: list[str] = []) -> DataFrame:
    """(id, keep, visible_text, error): hidden subtrees may nest.  A page that can't be read keeps its row with the error, so that other checks go on.  Null and
    empty pages have the empty text; `keep` names columns to carry along."""
    own = [id_col, *keep]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for html in batch.column(len(own)).to_pylist():
                try:
                    texts.append(_visible(html))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  the row tells of it
                    texts.append(None)
                    errors.append(type(e).__name__)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(own))), pa.array(texts, pa.string()), pa.array(errors, pa.string())], [*own, "visible_text", "error"])

    return pages.select(*own, html_col).mapInArrow(run, ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in own) + ", visible_text string, error string")
