"""URL algebra as column expressions.  Addresses stay as written: no percent-encoding, no punycode."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scheme, host, port, path, query; no user part, no blanks, no brackets in the host.
PATTERN = r"^\s*([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#:@\s\[\]]+)(:[0-9]{1,5})?([^?#\s]*)(\?[^#\s]*)?(#\S*)?\s*$"
HAS_SCHEME = r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://"
#: References that lead to no page, and to no resource.
NOT_A_LINK = r"(?i)^\s*($|#|javascript:|mailto:|tel:)"
NOT_A_RESOURCE = r"(?i)^\s*($|#|javascript:|mailto:|tel:|data:|whatsapp:|tg:|viber:|skype:|intent:)"
#: Public suffixes of two labels.
TWO_LABEL_SUFFIXES = ["co.uk", "org.uk", "gov.uk", "ac.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "com.br", "com.tr", "com.cn", "net.cn", "org.cn"]


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once for each row however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def parts(url: Column) -> Column:
    """Scheme, host, port, path and query of an address, one match for all; empty strings where it is none, null for null."""
    found = F.split(F.regexp_replace(url, PATTERN, "$1\n$2\n$3\n$4\n$5"), "\n")
    return F.when(url.rlike(PATTERN), found).when(url.isNotNull(), F.array(*(F.lit("") for _ in range(5))))


def part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, PATTERN, k)


def host(url: Column) -> Column:
    """Lower-case host, null if there is none."""
    return F.nullif(F.lower(part(url, 2)), F.lit(""))


def normalize(url: Column, add_scheme: bool = False, force_https: bool = False, keep_query: bool = False, keep_slash: bool = False) -> Column:
    """Lower scheme and host, drop the default port and the fragment; an empty path is "/".  Null if it isn't an address of http or https."""
    u = F.when(url.rlike(HAS_SCHEME), url).otherwise(F.when(F.trim(url) != "", F.concat(F.lit("https://"), F.trim(url)))) if add_scheme else url

    def kept(p: Column) -> Column:
        scheme, port = F.lower(p[0]), p[2]
        default = ((scheme == "http") & (port == ":80")) | ((scheme == "https") & (port == ":443"))
        path = p[3] if keep_slash else F.regexp_replace(p[3], "/+$", "")
        out = F.concat(F.lit("https") if force_https else scheme, F.lit("://"), F.lower(p[1]), F.when(default, "").otherwise(port), F.when(path == "", "/").otherwise(path), p[4] if keep_query else F.lit(""))
        return F.when(scheme.isin("http", "https"), out)

    return let(parts(u), kept)


def crawl_url(url: Column) -> Column:
    return normalize(url, add_scheme=True, keep_query=True)


def image_url(url: Column) -> Column:
    return normalize(url, keep_slash=True)


def graph_url(url: Column) -> Column:
    return normalize(url, force_https=True)


def sitemap_url(url: Column) -> Column:
    return normalize(url)


def canonical_key(url: Column) -> Column:
    """Host variants of one address share it: scheme and leading www. don't count."""
    return F.regexp_replace(graph_url(url), r"^https://(www\.)?", "")


def remove_dots(path: Column) -> Column:
    """RFC 3986 dot segments, by a fold over the segments."""
    seg = F.split(path, "/")
    start = F.array().cast("array<string>")
    back = lambda acc: F.when(F.size(acc) > 1, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)
    kept = F.aggregate(seg, start, lambda acc, s: F.when(s == ".", acc).when(s == "..", back(acc)).otherwise(F.concat(acc, F.array(s))))
    joined = F.array_join(kept, "/")
    return F.when(path.rlike(r"(^|/)\.\.?$") & ~joined.endswith("/"), F.concat(joined, F.lit("/"))).otherwise(joined)


def resolve(base: Column, ref: Column) -> Column:
    """The address that a reference on page base means; null where base is none."""
    r = F.trim(ref)
    tail = F.regexp_extract(r, r"([?#].*)?$", 0)
    own = F.regexp_replace(r, r"[?#].*$", "")

    def meant(p: Column) -> Column:
        scheme, path = F.lower(p[0]), p[3]
        origin = F.concat(scheme, F.lit("://"), F.lower(p[1]), p[2])
        folder = F.regexp_replace(path, r"[^/]*$", "")
        to = F.when(r.startswith("/"), own).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), own))
        out = (
            F.when(r.rlike(HAS_SCHEME), r)
            .when(r.startswith("//"), F.concat(scheme, F.lit(":"), r))
            .when(r.startswith("?"), F.concat(origin, F.when(path == "", "/").otherwise(path), r))
            .when(to.contains("/."), F.concat(origin, remove_dots(to), tail))
            .otherwise(F.concat(origin, to, tail))
        )
        return F.when(scheme != "", out)

    return let(parts(base), meant)


def is_checkable(ref: Column, resource: bool = False) -> Column:
    return F.coalesce(~ref.rlike(NOT_A_RESOURCE if resource else NOT_A_LINK), F.lit(False))


def missing_scheme(ref: Column) -> Column:
    r = F.trim(ref)
    return F.coalesce(~r.rlike(r"(?i)^(/|\./|\.\./|#|https?:)") & r.contains(".") & ~r.contains(" ") & ~r.rlike(NOT_A_RESOURCE), F.lit(False))


def segments(url: Column) -> Column:
    return F.filter(F.split(part(url, 4), "/"), lambda s: s != "")


def is_landing(url: Column) -> Column:
    s = segments(url)
    return (F.size(s) <= 1) | F.lower(F.element_at(s, -1)).startswith("index.")


def looks_like_html(url: Column) -> Column:
    last = F.lower(F.regexp_extract(part(url, 4), r"([^/]*)$", 1))
    return ~last.contains(".") | last.rlike(r"\.html?$")


def ascii_hosts(hosts: DataFrame) -> DataFrame:
    """(host, ascii): international names in their ASCII form.  Only distinct names that need it reach Python."""

    @F.pandas_udf("string")
    def idna(names: pd.Series) -> pd.Series:
        def one(name: str) -> str | None:
            try:
                return name.encode("idna").decode()
            except UnicodeError:
                return None

        return names.map(one)

    plain = F.col("host").rlike(r"^[\x00-\x7F]*$")
    names = hosts.select("host").distinct()
    return names.where(plain).select("host", F.lower("host").alias("ascii")).unionByName(names.where(~plain).select("host", idna("host").alias("ascii")))


def root2(host_: Column) -> Column:
    return F.substring_index(host_, ".", -2)


def registrable_domain(host_: Column, suffixes: list[str] = TWO_LABEL_SUFFIXES) -> Column:
    """The last two labels, or three where the last two are a suffix."""
    return F.when(F.lower(root2(host_)).isin(suffixes), F.substring_index(host_, ".", -3)).otherwise(root2(host_))
