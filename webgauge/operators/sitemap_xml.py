"""Sitemaps by an XML reader: namespaces, entities, character data of any form, and an error for files that aren't well-formed."""

from __future__ import annotations

import xml.parsers.expat as expat
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls

PIECE = 1 << 16
"""Characters of a file that the parser gets at a time."""
LOCS = 10_000
"""Entries in a row; a file with more gives several."""
EXPANDED = 1 << 20
"""Characters that a file's own entities may make of an address."""
FOUND = "root string, nth int, locs array<string>, elements bigint, error string"


class _Reader:
    """Of one file: the root's local name and the addresses, as they come.  In an index every loc counts; in a set the first loc right below each
    url does, so those of pictures and videos don't.  Names are compared without prefix and case."""

    def __init__(self) -> None:
        self.root: str | None = None
        self.locs: list[str] = []
        self.elements = self.depth = self.url = 0
        self.taken, self.text, self.at, self.size = False, None, 0, 0
        self.parser = p = expat.ParserCreate(namespace_separator="\n")
        p.buffer_text = True
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = self._start, self._end, self._data

    def _start(self, name: str, _: dict) -> None:
        local = name.rpartition("\n")[2].rpartition(":")[2].lower()
        self.depth += 1
        if self.root is None:
            self.root = local
        if local == "url":
            self.url, self.taken = self.depth, False
        if local == "loc" and self.text is None and (self.root != "urlset" or self.depth == self.url + 1 > 1 and not self.taken):
            self.text, self.at, self.size, self.taken = [], self.depth, 0, True

    def _data(self, data: str) -> None:
        if self.text is not None:
            self.size += len(data)
            if self.size > EXPANDED:
                raise ValueError("an address is too long")
            self.text.append(data)

    def _end(self, _: str) -> None:
        if self.text is not None and self.depth == self.at:
            loc = "".join(self.text).strip()
            self.text = None
            if loc:
                self.elements += 1
                self.locs.append(loc)
        if self.depth == self.url:
            self.url = 0
        self.depth -= 1


def _read(body: str | None) -> Iterator[tuple[str | None, int, list[str], int, str | None]]:
    """(root, nth, locs, elements, error) of a file.  A file that breaks keeps no address, as none of it can be trusted."""
    if body is None or not body.strip():
        yield None, 0, [], 0, "no root element"
        return
    reader = _Reader()
    try:
        body = body.lstrip("﻿ \t\r\n")
        for at in range(0, len(body), PIECE):
            reader.parser.Parse(body[at : at + PIECE])
        reader.parser.Parse("", True)
    except (expat.ExpatError, ValueError) as e:
        yield reader.root, 0, [], 0, str(e)
        return
    locs = reader.locs if reader.root in ("urlset", "sitemapindex") else []
    for nth, at in enumerate(range(0, max(1, len(locs)), LOCS)):
        yield reader.root, nth, locs[at : at + LOCS], len(locs), None


def parse(files: DataFrame) -> DataFrame:
    """(host, file, root, nth, locs, elements, error) of files(host, url, body): at least one row each, of at most 10,000 addresses.

    Encoding declarations are passed over, as a body is text already; entities that a file declares itself are put in, external ones
    aren't read; a body that isn't well-formed XML gives its error and no address.  Null and blank bodies have no root.  Repeated files give
    their rows each.  Files are read piece by piece within an Arrow batch.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, body in enumerate(batch.column("body")):
                found = list(_read(_undeclared(body.as_py())))
                n = len(found)
                kept = pa.array([i] * n)
                columns = [pa.array(c, k) for c, k in zip(zip(*found), (pa.string(), pa.int32(), pa.list_(pa.string()), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column("host").take(kept), batch.column("url").take(kept), *columns], ["host", "file", "root", "nth", "locs", "elements", "error"])

    return files.select("host", "url", "body").mapInArrow(run, f"host string, file string, {FOUND}")


def _undeclared(body: str | None) -> str | None:
    """Without the XML declaration, whose encoding speaks of bytes that are gone."""
    if body is None:
        return None
    body = body.lstrip("﻿ \t\r\n")
    return body.partition("?>")[2] if body.startswith("<?xml") and "?>" in body else body


def kind(root: Column, error: Column) -> Column:
    """index, urlset, unknown (another root) or broken."""
    return F.when(error.isNotNull(), "broken").when(root == "urlset", "urlset").when(root == "sitemapindex", "index").otherwise("unknown")


def sitemap_urls(files: DataFrame) -> DataFrame:
    """(host, file, kind, loc, error) of files(host, url, body): a row for each address, or one with a null loc for a file without any."""
    found = parse(files)
    return found.select("host", "file", kind(F.col("root"), F.col("error")).alias("kind"), F.explode_outer("locs").alias("loc"), "error")


def sitemap_problems(files: DataFrame, max_urls: int = 200_000) -> DataFrame:
    """(host, file, code, n): SITEMAP_XML_ERROR (nothing to read), SITEMAP_XML_PARSE_ERROR, SITEMAP_UNKNOWN_ROOT, SITEMAP_BAD_URL with how many addresses of a set
    are none, SITEMAP_URL_LIMIT_REACHED with how many it has."""
    found = parse(files)
    bad = F.size(F.filter("locs", lambda x: urls.sitemap_url(x).isNull()))
    counts = F.when(F.col("root") == "urlset", bad).otherwise(0).cast("bigint")
    first = F.col("nth") == 0
    by = found.groupBy("host", "file", "root", "error").agg(F.count_if(first).alias("files"), F.sum(counts).alias("bad"), F.sum(F.when(first, F.col("elements"))).alias("urls"))
    rules = [
        (F.col("error") == "no root element", "SITEMAP_XML_ERROR", F.col("files")), (F.col("error") != "no root element", "SITEMAP_XML_PARSE_ERROR", F.col("files")),
        (F.col("error").isNull() & ~F.col("root").isin("urlset", "sitemapindex"), "SITEMAP_UNKNOWN_ROOT", F.col("files")), (F.col("bad") > 0, "SITEMAP_BAD_URL", F.col("bad")),
        ((F.col("root") == "urlset") & (F.col("urls") > max_urls), "SITEMAP_URL_LIMIT_REACHED", F.col("urls")),
    ]
    made = F.filter(F.array(*(F.when(c, F.struct(F.lit(code).alias("code"), n.alias("n"))) for c, code, n in rules)), lambda x: x.isNotNull())
    return by.select("host", "file", F.explode(made).alias("p")).select("host", "file", "p.code", "p.n")
