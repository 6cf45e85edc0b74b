"""Alignment of the tokens of two tokenizers.

Both tokenizers cut the same bytes.  Byte offsets where a token of each ends cut a text into groups, the components
of the graph of overlapping tokens.  Every token points to the overlapping token that ends farthest right, of two
that end together to the second tokenizer's; doubling the pointers of all tokens of a slice at once leads each to the
token that ends its component.

How many documents link a pair of ids needs the whole corpus.  A slice of documents sends each of its distinct pairs
once, with the number of its documents that hold it; sums by pair and the highest sum of each first id go back to the
slices by pair, and each slice adds them up for its documents.  A frequent pair is thus a row for each slice, not for
each document, and is summed within tasks before it's shuffled.  The pairs of one first id are no more than the second
vocabulary has tokens.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import bounds, csr_take, inputs, materialize, outputs, scratch, slices

EXPANDED = 2_000_000
"""Pairs of large groups that a task writes out at a time."""
REMEMBERED = 200_000
"""Units that a worker keeps with their tokens, about 60 MB."""
SLICE = 2 << 20
"""Bytes of text that are aligned at a time."""
SPACE = "▁"
BYTE = re.compile("<0x([0-9A-F]{2})>")
ODD = re.compile(r"[^\S \n]").search
PLAIN, CUT = re.compile(r"[ \n]*[^ \n]+|[ \n]+").findall, re.compile(r"(?<=\S)(?=[ \n])").split


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Units(dict):
    """A unit of text (white space and the run of other characters behind it) to its number, with its tokens of both vocabularies.

    Texts are cut between a character that isn't white space and a space or line feed.  No token of a byte-level vocabulary reaches
    over such a place, and no piece either, as none goes on with a space after another character or holds a line feed; a piece
    model with such pieces gets whole texts.  `limit` units are remembered; others only until trim().
    """

    def __init__(self, first: str, second: str, limit: int = REMEMBERED):
        import sentencepiece

        self.first, self.model, self.limit = bpe.load(first), sentencepiece.SentencePieceProcessor(model_file=second), limit
        self.size_a, self.size_b = self.first.size, self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(self.size_b)]
        self.pieces = [bytes([int(BYTE.fullmatch(p)[1], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.whole = any("\n" in p or re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces) or len(self.model.encode("\n")) != 2
        self.plain = self._ranked()
        self.lens_a, self.lens_b, self.good = array("q"), array("q"), array("b")
        self.a, self.b = array("i"), array("i")
        self.bytes_a, self.bytes_b = np.fromiter(map(len, self.first.tokens), np.int64), np.fromiter(map(len, self.pieces), np.int64)

    def _ranked(self):
        """The rank encoder, where merges make one token each and ids follow their order, so that ranks say the same as merges."""
        import tiktoken

        special = set(self.first.special.values())
        ranks = {t: i for i, t in enumerate(self.first.tokens) if t and i not in special}
        made = [self.first.rank[i] for i in ranks.values()]
        if len(self.first.merged) + 256 != len(ranks) or made != sorted(made):
            return None
        return tiktoken.Encoding("units", pat_str=bpe.PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})

    def cut(self, text: str) -> list[str]:
        if self.whole:
            return [text]
        return PLAIN(text) if not ODD(text) else CUT(text)

    def _encode_a(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units end to end, and the number of each.  Units that don't end in white space, each of which begins with it,
        are one text to the rank encoder; its tokens' lengths say where one ends."""
        if self.plain and not self.whole:
            closed = [not u[-1].isspace() for u in units]
            ids = np.array(self.plain.encode_ordinary("".join(compress(units, closed))), np.int32)
            lens = np.array([0 if c else -1 for c in closed])
            ends = np.cumsum([len(u.encode()) for u in compress(units, closed)])
            lens[lens == 0] = np.diff(np.searchsorted(np.cumsum(self.bytes_a[ids]), ends, "right"), prepend=0)
            if all(closed):
                return ids, lens
            alone = iter([self.plain.encode_ordinary(u) for u, c in zip(units, closed) if not c])
            parts = np.split(ids, np.cumsum(lens[lens >= 0])[:-1]) if len(ends) else []
            joined = iter(parts)
            each = [next(joined if c else alone) for c in closed]
        else:
            each = [self.plain.encode_ordinary(u) if self.plain else [i for w in self.first.split(u) for i in self.first.encode_word(w.encode().decode("latin-1"))] for u in units]
        return np.fromiter(chain.from_iterable(each), np.int32), np.fromiter(map(len, each), np.int64, len(each))

    def learn(self, units: list[str]) -> None:
        """The line feed in front of a unit takes the space that the model adds, and no piece reaches over it; a whole text begins with
        the added space itself."""
        if not units:
            return
        a, lens_a = self._encode_a(units)
        each = self.model.encode([u[1:] for u in units] if self.whole else ["\n" + u for u in units], num_threads=1)
        each = each if self.whole else [b[2:] for b in each]
        b, lens_b = np.fromiter(chain.from_iterable(each), np.int32), np.fromiter(map(len, each), np.int64, len(each))
        told = [u.encode() for u in units]
        ends = np.cumsum(list(map(len, told)))
        good = np.ones(len(units), np.int8)
        for ids, lens, size, tokens in ((a, lens_a, self.bytes_a, self.first.tokens), (b, lens_b, self.bytes_b, self.pieces)):
            at = np.concatenate(([0], np.cumsum(size[ids])))[np.cumsum(lens)]
            if not np.array_equal(at, ends) or b"".join([tokens[i] for i in ids.tolist()]) != b"".join(told):
                good &= np.array([b"".join([tokens[i] for i in x.tolist()]) == t for x, t in zip(np.split(ids, np.cumsum(lens)[:-1]), told)], np.int8)
        self.update(zip(units, range(len(self.good), len(self.good) + len(units))))
        for kept, new in ((self.a, a), (self.b, b), (self.lens_a, lens_a), (self.lens_b, lens_b), (self.good, good)):
            kept.frombytes(new.astype(kept.typecode).tobytes())

    def encode(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """The ids of all texts by both vocabularies, each end to end, the offsets of each text in them, and whether its bytes are kept.
        Each text begins with the added space."""
        cut = [self.cut(t) for t in texts]
        units, of = list(chain.from_iterable(cut)), bounds(map(len, cut))
        at = np.fromiter(map(self.get, units, repeat(-1)), np.int64, len(units))
        new = np.flatnonzero(at < 0).tolist()
        self.learn(list(dict.fromkeys([units[k] for k in new])))
        at[new] = [self[units[k]] for k in new]
        del cut, units
        out = []
        for ids, lens in ((self.a, self.lens_a), (self.b, self.lens_b)):
            found, n = csr_take(np.concatenate(([0], np.cumsum(lens, dtype=np.int64))), np.frombuffer(ids, np.int32), at)
            out += [found, np.concatenate(([0], np.cumsum(n)))[of]]
        bad = np.concatenate(([0], np.cumsum(np.frombuffer(self.good, np.int8)[at] == 0)))[of]
        self.trim()
        return *out, np.diff(bad) == 0

    def trim(self) -> None:
        while len(self) > self.limit:
            self.popitem()  # the last one learned
        n = len(self)
        if n < len(self.good):
            del self.a[sum(self.lens_a[:n]) :], self.b[sum(self.lens_b[:n]) :]
            del self.lens_a[n:], self.lens_b[n:], self.good[n:]


@lru_cache(2)
def load(first: str, second: str) -> Units:
    """One for each worker process, which Spark uses again for later tasks."""
    return Units(first, second)


@lru_cache(2)
def _decimals(size: int) -> list[bytes]:
    """Each id in decimals before a comma, a bar and a semicolon; id + k * size has the k-th mark."""
    return [b"%d%c" % (i, c) for c in b",|;" for i in range(size)]


def components(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The group of each token of both sides, numbered from left to right, and how many there are.

    ends: the sorted byte offsets where tokens end; both sides end at the same last byte.
    """
    if not len(ends_a):
        return np.zeros(0, np.int32), np.zeros(0, np.int32), 0
    n, size = len(ends_a), int(ends_a[-1]) + 1
    here_a, here_b = np.zeros(size, np.int32), np.zeros(size, np.int32)
    here_a[ends_a], here_b[ends_b] = 1, 1
    # The token of the other side that holds a token's last byte: as many of that side end before.
    over_a = (np.cumsum(here_b, dtype=np.int32) - here_b)[ends_a]
    over_b = (np.cumsum(here_a, dtype=np.int32) - here_a)[ends_b]
    last = ends_a[over_b] <= ends_b
    to = np.concatenate((n + over_a, np.where(last, n + np.arange(len(ends_b), dtype=np.int32), over_b)))
    while True:
        further = to[to]
        if np.array_equal(further, to):
            break
        to = further
    # What a component comes to is a token of the second side that points to itself.
    nth = np.cumsum(last, dtype=np.int32) - 1
    group = nth[to - n]
    return group[:n], group[n:], int(nth[-1]) + 1


def _distinct(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs, or the sum of its weights."""
    if weights is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights


def linked(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, doc: np.ndarray, size_a: int, size_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (document * size_a + a) * size_b + b of all tokens that share a group, and their numbers of token pairs.

    doc: the document of each group.  A group's distinct ids are crossed with their numbers, not the tokens.
    """
    n = len(doc)
    sole = (np.bincount(group_a, minlength=n) == 1) & (np.bincount(group_b, minlength=n) == 1)
    key = lambda d, a, b: (d * size_a + a) * size_b + b
    alone_a, alone_b = sole[group_a], sole[group_b]
    found = [_distinct(key(doc[group_a[alone_a]], ids_a[alone_a].astype(np.int64), ids_b[alone_b]))]
    a, times_a = _distinct(group_a[~alone_a].astype(np.int64) * size_a + ids_a[~alone_a])
    b, times_b = _distinct(group_b[~alone_b].astype(np.int64) * size_b + ids_b[~alone_b])
    in_a, in_b = a // size_a, b // size_b
    at_b = np.searchsorted(in_b, np.arange(n + 1))
    total = np.concatenate(([0], np.cumsum(at_b[in_a + 1] - at_b[in_a])))
    start = 0
    while start < len(a):
        stop = max(start + 1, int(np.searchsorted(total, total[start] + EXPANDED, "right")) - 1)
        which, lens = csr_take(at_b, np.arange(len(b)), in_a[start:stop])
        left = np.repeat(np.arange(start, stop), lens)
        found.append(_distinct(key(doc[in_a[left]], a[left] % size_a, b[which] % size_b), times_a[left] * times_b[which]))
        start = stop
    if len(found) == 1:
        return found[0]
    return _distinct(np.concatenate([k for k, _ in found]), np.concatenate([w for _, w in found]))


class Aligned:
    """Texts cut by both tokenizers and grouped; texts whose tokens don't give the added space and their own bytes have none."""

    def __init__(self, texts: list[str | None], units: Units):
        self.ids_a, at_a, self.ids_b, at_b, good = units.encode([" " + t if t else "" for t in texts])
        if not good.all():
            self.ids_a, self.ids_b = self.ids_a[np.repeat(good, np.diff(at_a))], self.ids_b[np.repeat(good, np.diff(at_b))]
            at_a, at_b = bounds(np.where(good, np.diff(at_a), 0)), bounds(np.where(good, np.diff(at_b), 0))
        self.at_a, self.at_b, self.size_a, self.size_b = at_a, at_b, units.size_a, units.size_b
        ends_a, ends_b = np.cumsum(units.bytes_a[self.ids_a]) - 1, np.cumsum(units.bytes_b[self.ids_b]) - 1
        self.group_a, self.group_b, groups = components(ends_a, ends_b)
        self.per_a, self.per_b = np.bincount(self.group_a, minlength=groups), np.bincount(self.group_b, minlength=groups)
        # Groups of a text: those of its first token to the one before the next text's.
        self.at = np.concatenate((self.group_a, [groups]))[at_a]
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.at))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        return linked(self.ids_a, self.ids_b, self.group_a, self.group_b, self.doc, self.size_a, self.size_b)

    def written(self) -> Iterator[bytes]:
        """a1,a2|b1;a3|b2,b3 of each text: the tokens of a group's sides one after the other, each with the mark that follows it."""
        before_a, before_b = np.concatenate(([0], np.cumsum(self.per_a))), np.concatenate(([0], np.cumsum(self.per_b)))
        size, mark = max(self.size_a, self.size_b), np.empty(len(self.ids_a) + len(self.ids_b), np.int32)
        place_a, place_b = np.arange(len(self.ids_a)) + before_b[self.group_a], np.arange(len(self.ids_b)) + before_a[self.group_b + 1]
        mark[place_a], mark[place_b] = self.ids_a, self.ids_b
        mark[place_a[before_a[1:] - 1]] += size
        mark[place_b[before_b[1:] - 1]] += 2 * size
        told, cut = _decimals(size), (before_a + before_b)[self.at]
        for i, j in zip(cut, cut[1:]):
            yield b"".join(map(told.__getitem__, mark[i:j].tolist()))[:-1]


def align(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: str | None = None, second: str | None = None, groups: bool = True) -> DataFrame:
    """Each row's id with n_a, n_b (tokens of both), n_groups, n_links (pairs of tokens that share a group), n_best (links whose pair of
    ids is linked in as many documents as any pair of its first id), count_sum (over links, the documents that link their ids),
    groups_sha256, and with `groups` the groups themselves as a1,a2|b1;a3|b2,b3.

    Null and empty texts, and texts whose tokens give other bytes (those with the mark that a model writes for spaces), have no
    tokens: zeros and empty strings.  Repeated rows are documents of their own and give a row each, so does a null id; ties for the
    highest count all count; other columns of df play no part.  An empty table gives no rows.  A text of any length is one
    slice's work.
    """
    path_a, path_b = first or bpe.default_vocabulary(), second or default_pieces()
    docs = inputs(df, id_col, text_col, False)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, part = load(path_a, path_b), TaskContext.get().partitionId()
        ids = units.size_a * units.size_b
        for k, batch in enumerate(slices(batches, limit=SLICE)):
            texts = Aligned(batch.column("text").to_pylist(), units)
            keys, times = texts.links()
            pair = keys % ids
            pairs, at, held = np.unique(pair, return_inverse=True, return_counts=True)
            n, starts = batch.num_rows, np.searchsorted(keys // ids, np.arange(batch.num_rows + 1))
            many = np.flatnonzero(times > 1)
            starts_many = np.searchsorted(many, starts)
            written = list(texts.written()) if groups else None
            digests = [hashlib.sha256(x).hexdigest() if x else "" for x in written or texts.written()]
            links = np.concatenate(([0], np.cumsum(texts.per_a * texts.per_b)))[texts.at]
            packed = lambda x, at: pa.array([x[i:j].tobytes() for i, j in zip(at, at[1:])], pa.binary())
            within = many - np.repeat(starts[:-1], np.diff(starts_many))
            out = {
                "id": batch.column("id"),
                "n_a": pa.array(np.diff(texts.at_a), pa.int64()), "n_b": pa.array(np.diff(texts.at_b), pa.int64()),
                "n_groups": pa.array(np.diff(texts.at), pa.int64()), "n_links": pa.array(np.diff(links), pa.int64()),
                "groups_sha256": pa.array(digests),
                "chunk": pa.array(np.full(n, part << 32 | k), pa.int64()),
                "held": packed(at.astype(np.uint32), starts), "many": packed(within.astype(np.uint32), starts_many), "times": packed(times[many], starts_many),
                "pairs": pa.nulls(n, pa.list_(pa.int64())), "docs": pa.nulls(n, pa.list_(pa.int32())),
            }
            if groups:
                out["groups"] = pa.array([x.decode() for x in written])
            rows = pa.RecordBatch.from_pydict(out)
            yield rows
            if len(pairs):
                row = {"chunk": [part << 32 | k], "pairs": pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pa.array(pairs, pa.int64())), "docs": pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pa.array(held, pa.int32()))}
                yield pa.RecordBatch.from_pydict({f.name: row.get(f.name, pa.nulls(1, f.type)) for f in rows.schema}, schema=rows.schema)

    own = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
    ddl = own + ", chunk bigint, held binary, many binary, times binary, pairs array<bigint>, docs array<int>" + ", groups string" * groups
    rest = own + ", n_best bigint, count_sum bigint" + ", groups string" * groups
    schema, result = outputs(docs, df.schema[id_col].dataType, ddl), outputs(docs, df.schema[id_col].dataType, rest)
    with scratch(df.sparkSession):
        slices_ = materialize(docs.mapInArrow(cut, schema))
        sent = slices_.where("pairs is not null").select("chunk", F.posexplode(F.arrays_zip("pairs", "docs")).alias("nth", "p")).select("chunk", "nth", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("n"))
        size_b = load(path_a, path_b).size_b
        sums = materialize(sent.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.expr(f"pair div {size_b}")))
        most = sums.groupBy("a").agg(F.max("n").alias("most"))
        counts = sums.join(most.hint("shuffle_merge"), "a").select("pair", F.col("n").alias("sum"), (F.col("n") == F.col("most")).alias("best"))
        back = sent.select("chunk", "nth", "pair").join(counts.hint("shuffle_merge"), "pair").select(F.col("chunk").alias("of"), "nth", "sum", "best")
        texts = slices_.where("pairs is null").drop("pairs", "docs")

        def add(rows: pa.Table, found: pa.Table) -> pa.Table:
            found = found.sort_by("nth")
            n, best = found.column("sum").to_numpy(), found.column("best").to_numpy()
            sums, bests = [], []
            for held, many, times in zip(*(rows.column(c).to_pylist() for c in ("held", "many", "times"))):
                at = np.frombuffer(held, np.uint32)
                often = np.ones(len(at), np.int64)
                often[np.frombuffer(many, np.uint32)] = np.frombuffer(times, np.int64)
                sums.append(int(often @ n[at]))
                bests.append(int(often[best[at]].sum()))
            extra = {"n_best": pa.array(bests, pa.int64()), "count_sum": pa.array(sums, pa.int64())}
            return pa.table({f.name: extra[f.name] if f.name in extra else rows.column(f.name) for f in result})

        return materialize(texts.groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(add, result), keep=True).withColumnRenamed("id", id_col)
