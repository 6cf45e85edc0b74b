"""Robots rules of hosts with many of them: one automaton for all patterns of a host, one walk over each path.

Patterns make a tree: a child for each letter, and one for *, which every letter leads back to.  A walk is in several of its nodes at once; sets of
nodes that occurred are numbered with what they accept and where a letter leads, so a letter costs one look-up, whatever the number of rules.
Pages meet the rules of their host in groups of bounded size: hosts share a group by hash, and a host with many pages is dealt over several.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls
from ..sources.shared import materialize

REMEMBERED = 20_000
"""Sets of nodes that an automaton keeps; beyond that it forgets them and goes on."""
ANY = "*"


class Automaton:
    """Patterns(pattern, allow): * stands for anything, a last $ for the end; others match at the start.  match() gives the longest one's
    length and whether it allows, of equally long ones the allowing one; None where none matches."""

    def __init__(self, patterns: Iterable[tuple[str, bool]]):
        self.children: list[dict[str, int]] = [{}]
        self.loops = [False]
        self.inside: list[tuple[int, bool] | None] = [None]
        self.at_end: list[tuple[int, bool] | None] = [None]
        for pattern, allow in patterns:
            closed = pattern.endswith("$")
            node = 0
            for c in pattern[:-1] if closed else pattern:
                node = node if c == ANY and self.loops[node] else self._child(node, c)
            said, rank = self.at_end if closed else self.inside, (len(pattern), allow)
            said[node] = max(said[node] or rank, rank)
        self._forget()

    def _child(self, node: int, c: str) -> int:
        if c not in self.children[node]:
            self.children[node][c] = len(self.children)
            self.children.append({})
            self.loops.append(c == ANY)
            self.inside.append(None)
            self.at_end.append(None)
        return self.children[node][c]

    def _forget(self) -> None:
        self.sets: dict[tuple[int, ...], int] = {}
        self.nodes: list[tuple[int, ...]] = []
        self.to: list[dict[str, int]] = []
        self.found: list[tuple] = []
        self.start = self._number({0})

    def _number(self, nodes: set[int]) -> int:
        for n in list(nodes):
            if not self.loops[n] and ANY in self.children[n]:
                nodes.add(self.children[n][ANY])
        key = tuple(sorted(nodes))
        if key not in self.sets:
            self.sets[key] = len(self.nodes)
            self.nodes.append(key)
            self.to.append({})
            best = lambda said: max((s for n in key if (s := said[n])), default=None)
            self.found.append((best(self.inside), best(self.at_end)))
        return self.sets[key]

    def _step(self, state: int, c: str) -> int:
        nodes = self.nodes[state]
        if len(self.nodes) > REMEMBERED:
            self._forget()
            state = self._number(set(nodes))
        # A star in the text is a letter; in the tree it stands for the loop.
        reached = {self.children[n][c] for n in nodes if c != ANY and c in self.children[n]} | {n for n in nodes if self.loops[n]}
        to = self._number(reached)
        self.to[state][c] = to
        return to

    def match(self, path: str) -> tuple[int, bool] | None:
        state = self.start
        best = self.found[state][0]
        for c in path:
            to = self.to[state].get(c)
            state = self._step(state, c) if to is None else to
            inside = self.found[state][0]
            if inside is not None and (best is None or inside > best):
                best = inside
            if not self.nodes[state]:
                return best
        end = self.found[state][1]
        return end if end is not None and (best is None or end > best) else best


def path_of(url: Column) -> Column:
    """What rules are held against: path and query, a slash for an empty path."""
    path = urls.part(url, 4)
    return F.concat(F.when(path == "", "/").otherwise(path), urls.part(url, 5))


def allowed(pages: DataFrame, rules: DataFrame, key: str = "seq", agent: str = "mycrawler", group: int = 20_000) -> DataFrame:
    """(key, host, allowed, specificity) of pages(key, host, url) under rules(host, agent, allow, pattern), of which a host may have any number.

    The agent's own rules count, or else those for *.  specificity is the length of the rule that decides, null where none does, and then a
    page may be fetched.  Null addresses and hosts without rules are allowed; repeated rows give a row each.  About `group` pages make a group; nothing
    but key, host and path goes to Python.
    """
    own = rules.where(F.col("agent").isin(agent.lower(), "*") & (F.col("pattern") != "")).withColumn("own", F.col("agent") != "*")
    best = own.groupBy("host").agg(F.max("own").alias("has_own"))
    used = own.join(best.hint("shuffle_merge"), "host").where(F.col("own") == F.col("has_own")).select("host", "pattern", "allow").distinct()
    asked = pages.select(F.col(key).alias("key"), "host", path_of(F.col("url")).alias("path"))
    counts = materialize(asked.groupBy("host").agg(F.count("*").alias("n")))
    buckets = max(1, (counts.agg(F.sum("n")).first()[0] or 0) // group)
    # Both sides of the cogroup need keys of one type: an int and a long that are equal hash to different partitions.
    shares = counts.select("host", F.pmod(F.xxhash64("host"), F.lit(buckets)).alias("bucket"), F.ceil(F.col("n") / group).cast("int").alias("shares"))
    dealt = asked.join(shares.hint("shuffle_merge"), asked["host"].eqNullSafe(shares["host"])).select("key", asked["host"], "path", "bucket", F.pmod(F.xxhash64("key", "path"), F.col("shares")).cast("int").alias("share"))
    copied = used.join(shares.hint("shuffle_merge"), "host").select("host", "pattern", "allow", F.col("bucket").alias("to_bucket"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("to_share"))
    schema = T.StructType([T.StructField("key", asked.schema["key"].dataType), *T.StructType.fromDDL("host string, allowed boolean, specificity int")])

    def judge(rows: pa.Table, said: pa.Table) -> pa.Table:
        of: dict[str, list] = {}
        for host, pattern, allow in zip(*(said.column(c).to_pylist() for c in ("host", "pattern", "allow"))):
            of.setdefault(host, []).append((pattern, allow))
        made = {host: Automaton(patterns) for host, patterns in of.items()}
        hits = [made[h].match(p) if p is not None and h in made else None for h, p in zip(rows.column("host").to_pylist(), rows.column("path").to_pylist())]
        return pa.table({"key": rows.column("key"), "host": rows.column("host"), "allowed": pa.array([h is None or h[1] for h in hits], pa.bool_()), "specificity": pa.array([h and h[0] for h in hits], pa.int32())})

    return dealt.groupBy("bucket", "share").cogroup(copied.groupBy("to_bucket", "to_share")).applyInArrow(judge, schema).withColumnRenamed("key", key)
