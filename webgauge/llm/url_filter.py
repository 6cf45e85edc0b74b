"""Filtering of web addresses by host rules and a weighted vocabulary.

One Aho-Corasick automaton finds all terms of the vocabulary in an address; a hit counts where no letter or digit stands right
before or behind it.  A strict term weighs as much as the limit, so one rejects; a soft term weighs less and counts once however often it
occurs, so several different ones reject.  Rules for hosts and paths go before the vocabulary: they are found by the host's
suffixes, of which an address has few, whatever the number of rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import small_batches

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PARTS = re.compile(r"([^/?#]*)([^?#]*)").match
WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


@dataclass(frozen=True)
class Vocabulary:
    """Lower-case terms.  One of `strict` rejects, and so do soft ones whose weights, each counted once, come to `limit`."""

    strict: tuple[str, ...] = ("porn", "porno", "xxx", "xvideos", "hentai", "milf", "escort", "escorts", "camgirl", "camgirls", "casino", "casinos", "viagra", "cialis", "warez", "keygen", "adult", "nude", "nudes", "slots")
    soft: tuple[tuple[str, int], ...] = tuple((t, 1) for t in ("sex", "sexy", "hot", "girls", "dating", "bet", "bets", "betting", "poker", "win", "jackpot", "free", "cheap", "discount", "pills", "pharmacy", "replica", "loan", "loans", "crack", "torrent", "torrents", "ads", "track", "tracker", "clicks", "spam", "farm", "seo", "backlinks"))
    limit: int = 2

    def __post_init__(self):
        if any(not 0 < w < self.limit for _, w in self.soft):
            raise ValueError("a soft term weighs less than the limit")


@dataclass(frozen=True)
class Rules:
    """(host, path) prefixes that block or allow.  A rule fits its host and all hosts below it, where the path starts with its path."""

    block: tuple[tuple[str, str], ...] = ()
    allow: tuple[tuple[str, str], ...] = ()
    by_host: dict = field(init=False, repr=False, compare=False, hash=False)

    def __post_init__(self):
        found: dict[str, dict[str, str]] = {}
        for verdict, rules in (("allow", self.allow), ("block", self.block)):
            for host, path in rules:
                found.setdefault(host, {})[path] = verdict  # of two that say both, block holds
        object.__setattr__(self, "by_host", {h: (sorted({*map(len, p)}, reverse=True), p) for h, p in found.items()})

    def longest(self, host: str, path: str) -> tuple[str, str] | tuple[None, None]:
        """The longest rule (host and path together, of equal ones the one with the longer host) that fits, and its verdict."""
        best, size, suffix = (None, None), -1, host
        while True:
            if suffix in self.by_host:
                lengths, paths = self.by_host[suffix]
                for n in lengths:
                    if n <= len(path) and path[:n] in paths:
                        if len(suffix) + n > size:
                            best, size = (suffix + path[:n], paths[path[:n]]), len(suffix) + n
                        break
            dot = suffix.find(".")
            if dot < 0:
                return best
            suffix = suffix[dot + 1 :]


@lru_cache(4)
def automaton(vocabulary: Vocabulary):
    """One for each worker process."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for term, weight in (*((t, vocabulary.limit) for t in vocabulary.strict), *vocabulary.soft):
        if term not in a or a.get(term)[1] < weight:
            a.add_word(term, (term, weight))
    a.make_automaton()
    return a


def hits(url: str, vocabulary: Vocabulary) -> dict[str, tuple[int, int]]:
    """Each term of a lower-case address that stands between boundaries: its weight and how often it occurs."""
    found: dict[str, tuple[int, int]] = {}
    a, n = automaton(vocabulary), len(url)
    for end, (term, weight) in a.iter(url) if len(a) else ():
        before = end - len(term)
        if (before < 0 or url[before] not in WORD) and (end + 1 == n or url[end + 1] not in WORD):
            found[term] = weight, found.get(term, (0, 0))[1] + 1
    return found


def split(url: str | None) -> tuple[str, str]:
    """Host in lower-case A-Z, and path; both empty without ://."""
    _, mark, rest = (url or "").partition("://")
    host, path = PARTS(rest).groups() if mark else ("", "")
    return host.translate(LOWER), path


def judge(pages: DataFrame, rules: Rules, vocabulary: Vocabulary = Vocabulary(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Each row's id with host, path, rule (the longest that fits, else null), verdict (allow or block: the rule's, else the vocabulary's),
    n_strict and n_soft (hits of both kinds) and weight (of different terms).

    A null or empty address, and one without ://, has neither host nor path and no rule; the vocabulary judges what text there is.
    Addresses of any length are read whole, as written but for A-Z: without decoding of percent signs.  Repeated rows, ties and null
    ids give a row each; an empty table gives none; other columns of pages aren't read.  Rules and vocabulary are the caller's short
    lists, which go to each task.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"))
    schema = T.StructType([T.StructField("id", pages.schema[id_col].dataType), *T.StructType.fromDDL("host string, path string, rule string, verdict string, n_strict bigint, n_soft bigint, weight bigint")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in schema.fields[1:]}
            for url in batch.column("url").to_pylist():
                host, path = split(url)
                rule, verdict = rules.longest(host, path)
                found = hits((url or "").translate(LOWER), vocabulary).values()
                weight = sum(w for w, _ in found)
                strict = sum(n for w, n in found if w >= vocabulary.limit)
                said = verdict or ("block" if weight >= vocabulary.limit else "allow")
                for name, value in zip(out, (host, path, rule, said, strict, sum(n for _, n in found) - strict, weight)):
                    out[name].append(value)
            kinds = [pa.int64() if n.startswith(("n_", "weight")) else pa.string() for n in out]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(v, k) for v, k in zip(out.values(), kinds))], ["id", *out])

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
