"""Language-model scoring: a trigram model of all words and n-grams of the corpus, in shards of an Elias-Fano trie.

Smoothing: each order is drawn towards the next lower one, p(c | a, b) = (n(abc) + m p(c | b)) / (n(ab) + m), down to the additive
unigram estimate, so the probabilities of each context sum to one.  A shard's trie holds the quantised logarithm of that for
each n-gram seen, and of each context's share for the rest, m / (n + m).

The corpus goes through four passes over chunks of some MB of text, whose tokens are numbers:

1. words: each chunk sends its distinct words with their counts to shards and gets numbers and counts of the whole corpus;
2. pairs: each chunk sends its distinct pairs to the shard of the first word, which adds up, builds its trie and answers;
3. triples: likewise, to the shard of the first two words; its trie leads from the second word over the first to the third;
4. sums of a document's tokens.

What a chunk sends is added up within it and packed in arrays, a row for each shard.  Shards are as many as the corpus needs, so
none grows with it.  A hot context is dealt to several shards by what follows it: counts of contexts come from the pass
before, so a shard needs no other one.  Nothing but two totals goes through the driver.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ngram_trie
from .common import bounds, materialize, scratch, slices, small_batches, utf8


@dataclass(frozen=True)
class Settings:
    add: float = 0.1
    pair_mass: float = 32.0
    """The weight, in tokens, of the unigram estimate in a pair's."""
    triple_mass: float = 8.0
    shard: int = 1_000_000
    """Tokens for each shard; a context of over a quarter of that is dealt to several."""
    piece: int = 5 << 20
    """Bytes of text in a chunk; a longer text is cut between words, and sums of its pieces are added up."""


END = b"\n"
"""The end token; no word holds white space."""
SPACE = re.compile(rb"[\x20\x09-\x0D]")
STEP = 2048
"""Steps of a quantised log10 probability in one."""
TENTHS = 10 ** (-np.arange(1 << 16) / STEP)
"""The probability of each quantised logarithm."""


IS_SPACE = np.array([SPACE.fullmatch(bytes([b])) is not None for b in range(256)])


def coded(texts: list[bytes], end: bool) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The tokens of all texts as numbers of the distinct ones, where each text's begin, and the distinct ones.  end: each text
    has its end token."""
    data = np.frombuffer(b"".join(t.lower() + b"\n" for t in texts), np.uint8)  # bytes: A-Z only
    space = IS_SPACE[data]
    edges = np.flatnonzero(np.diff(space, prepend=True))
    offsets = np.concatenate(([0], np.cumsum(edges[1::2] - edges[::2]))).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data[~space])]).dictionary_encode()
    codes, (_, ends, held) = words.indices.to_numpy().astype(np.int64), words.dictionary.buffers()
    ends, held = np.frombuffer(ends, np.int32)[: len(words.dictionary) + 1].tolist(), bytes(held or b"")
    known = [held[a:b] for a, b in zip(ends, ends[1:])]
    at = np.concatenate(([0], np.searchsorted(edges[::2], np.cumsum([len(t) + 1 for t in texts]))))
    if end:
        codes = np.insert(codes, at[1:], len(known))
        at, known = at + np.arange(len(at)), [*known, END]
    return codes, at, known


def quantised(log: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log * STEP), 0, 65535).astype(np.uint16)


@cache
def compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=1)


@cache
def decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def pack(a: np.ndarray) -> bytes:
    """Numbers from 0 on in as many bytes each as the largest needs, first bytes first, compressed.  Rising ones go by their steps."""
    rising = len(a) > 1 and bool(a[0] <= a[-1] and (a[1:] >= a[:-1]).all())
    if rising:
        a = np.diff(a, prepend=0)
    kind = np.min_scalar_type(int(a.max()) if len(a) else 0)
    planes = np.ascontiguousarray(a.astype(kind).view(np.uint8).reshape(len(a), kind.itemsize).T)
    return (kind.char.upper() if not rising else kind.char.lower()).encode() + compressor().compress(planes)


def unpack(data: bytes) -> np.ndarray:
    kind, rising = np.dtype(chr(data[0]).upper()), data[:1].islower()
    planes = np.frombuffer(decompressor().decompress(memoryview(data)[1:]), np.uint8).reshape(kind.itemsize, -1)
    out = np.empty(planes.shape[::-1], np.uint8)
    for k, plane in enumerate(planes):
        out[:, k] = plane
    out = out.view(kind).ravel().astype(np.int64)
    return np.cumsum(out) if rising else out


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers end to end, and where each row's begin."""
    arrays = [unpack(v) for v in column.to_pylist()]
    return np.concatenate(arrays), bounds(map(len, arrays))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys (from 0 on) in order, where each is first, and each key's place among them.  Key and place are sorted as one
    number where both fit, which takes a fraction of the time that sorting places by keys takes."""
    bits = len(keys).bit_length()
    if not len(keys) or int(keys.max()).bit_length() + bits > 63:
        return np.unique(keys, return_index=True, return_inverse=True)
    both = keys.astype(np.int64) << bits
    both |= np.arange(len(keys))
    both.sort()
    order = both & ((1 << bits) - 1)
    both >>= bits
    head = begins(both)
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(head) - 1
    head = np.flatnonzero(head)
    return both[head], order[head], which


def begins(rising: np.ndarray) -> np.ndarray:
    """Whether each number is another than the one before."""
    out = np.ones(len(rising), bool)
    np.not_equal(rising[1:], rising[:-1], out=out[1:])
    return out


def dense(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids in order, and each one's place among them; by a table where ids aren't far apart, else by sorting."""
    size = int(ids.max(initial=0)) + 1
    if size > 4 * len(ids):
        known, _, which = distinct(ids)
        return known, which
    seen = np.zeros(size, bool)
    seen[ids] = True
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[ids]


def mixed(*columns: np.ndarray) -> np.ndarray:
    """A digest of 63 bits for each row."""
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = (out ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return (out >> np.uint64(1)).astype(np.int64)


def pieces(text: bytes, size: int) -> Iterator[bytes]:
    start = 0
    while len(text) - start > size and (cut := SPACE.search(text, start + size)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def chunks(docs: DataFrame, s: Settings) -> DataFrame:
    """Tokens of docs(row, id, train, text): `codes` number a chunk's own `words`, which go by 64-bit digests; row k has the codes from at[k]
    to at[k + 1], of which lead[k] are those before a later piece of a cut text."""
    kind = docs.schema["id"].dataType.simpleString()

    def lists(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes], bool]]:
        if len(texts) > 1 or len(texts[0]) <= s.piece:
            yield list(range(len(texts))), [0] * len(texts), texts, True
            return
        lead: list[bytes] = []
        held = None
        for part in pieces(texts[0], s.piece):
            if held is not None:
                yield [0], [len(lead)], [b" ".join((*lead, held))], False
                lead = (lead + held.rsplit(None, 2)[-2:])[-2:]
            held = part
        yield [0], [len(lead)], [b" ".join((*lead, held))], True

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 32
        for batch in slices(batches, limit=s.piece):
            cut = batch.num_rows == 1 and len(utf8(batch.column("text"))[0]) > s.piece
            for which, lead, texts, end in lists(utf8(batch.column("text"))):
                codes, at, words = coded(texts, end)
                digests = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
                own = pa.array(which)
                yield pa.RecordBatch.from_pydict({
                    "chunk": pa.array([n], pa.int64()), "tokens": pa.array([len(codes)], pa.int64()), "cut": [cut],
                    **{c: pa.array([batch.column(c).take(own).to_pylist()], pa.list_(batch.schema.field(c).type)) for c in ("row", "id", "train")},
                    "lead": pa.array([pack(np.array(lead))]), "at": pa.array([pack(at)]), "codes": pa.array([pack(codes)]), "words": pa.array([digests.tobytes()], pa.binary()),
                })
                n += 1

    return docs.mapInArrow(run, f"chunk bigint, tokens bigint, cut boolean, row array<bigint>, id array<{kind}>, train array<boolean>, lead binary, at binary, codes binary, words binary")


class Chunk:
    """One row of the table of chunks."""

    def __init__(self, batch: pa.RecordBatch, k: int):
        of = lambda c: unpack(batch.column(c)[k].as_py())
        self.codes, self.at = of("codes"), of("at")
        rows = len(self.at) - 1
        self.doc = np.repeat(np.arange(rows), np.diff(self.at))
        self.place = np.arange(len(self.codes)) - self.at[self.doc]
        self.own = self.place >= of("lead")[self.doc]
        train = np.array(batch.column("train")[k].as_py(), bool)
        self.counted = self.own & train[self.doc]

    def pair_keys(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Where pairs end, and a number for each pair there."""
        ends = np.flatnonzero(self.place >= 1)
        return ends, self.codes[ends - 1] * words + self.codes[ends]

    def pairs(self, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs' codes; where pairs end, and which pair ends at each place."""
        ends, keys = self.pair_keys(words)
        keys, _, which = distinct(keys)
        at = np.full(len(self.codes), -1, np.int64)
        at[ends] = which
        return *np.divmod(keys, words), ends, at

    def triples(self, pair_at: np.ndarray, pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct triples as pairs of pairs; where triples end, and which one each is."""
        ends = np.flatnonzero(self.own & (self.place >= 2))
        keys, _, which = distinct(pair_at[ends - 1] * max(1, pairs) + pair_at[ends])
        return *np.divmod(keys, max(1, pairs)), ends, which


def counts(which: np.ndarray, size: int, flags: np.ndarray) -> np.ndarray:
    return np.bincount(which, flags, size).astype(np.int64) if len(which) else np.zeros(size, np.int64)


def dealt(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by shard, and where each shard's run begins."""
    kind = np.min_scalar_type(int(part.max(initial=0)))
    order = np.argsort(part.astype(kind), kind="stable")  # of two bytes at most, a radix sort
    return order, np.flatnonzero(np.diff(part[order], prepend=-1, append=-1)) if len(part) else np.zeros(1, np.int64)


def asked(chunk: int, part: np.ndarray, columns: Callable[[np.ndarray], dict[str, bytes]]) -> Iterator[pa.RecordBatch]:
    """A row for each shard; columns(places) packs what it gets."""
    order, at = dealt(part)
    rows = [columns(order[a:b]) for a, b in zip(at, at[1:])]
    if rows:
        packed = {k: pa.array([r[k] for r in rows], pa.binary()) for k in rows[0]}
        yield pa.RecordBatch.from_pydict({"part": pa.array(part[order[at[:-1]]], pa.int64()), "chunk": pa.array([chunk] * len(rows), pa.int64()), **packed})


def answers(replies: pa.Scalar, part: np.ndarray, *fields: str) -> list[np.ndarray]:
    """The numbers of each field of all shards' replies, in the order of what was asked."""
    order, _ = dealt(part)
    out = [np.zeros(len(part), np.int64) for _ in fields]
    if len(part):
        rows = sorted(replies.as_py(), key=lambda r: r["part"])
        for values, field in zip(out, fields):
            values[order] = np.concatenate([unpack(r[field]) for r in rows])
    return out


def answered(table: DataFrame, replies: DataFrame, *fields: str) -> DataFrame:
    got = replies.groupBy("chunk").agg(F.collect_list(F.struct("part", *fields)).alias("replies"))
    return table.join(got.hint("shuffle_merge"), "chunk", "left")


def split_of(n: np.ndarray, s: Settings) -> np.ndarray:
    """Over how many shards a context seen n times is dealt."""
    return 1 + 4 * n // s.shard


class Passes:
    """Functions that run in tasks; total and kinds are known from the second pass on."""

    def __init__(self, s: Settings, parts: int, total: int = 0, kinds: int = 0):
        self.s, self.parts, self.norm = s, parts, total + s.add * (kinds + 1)

    # 1. words

    def word_part(self, words: np.ndarray) -> np.ndarray:
        return (words % np.uint64(self.parts)).astype(np.int64)

    def ask_words(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                c, words = Chunk(batch, k), np.frombuffer(batch.column("words")[k].as_py(), np.uint64)
                n, every = (counts(c.codes, len(words), f) for f in (c.counted, c.own))
                yield from asked(batch.column("chunk")[k].as_py(), self.word_part(words), lambda own: {"keys": words[own].tobytes(), "n": pack(n[own]), "every": pack(every[own])})

    def answer_words(self, table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(v, np.uint64) for v in table.column("keys").to_pylist()]
        at = bounds(map(len, keys))
        known, which = np.unique(np.concatenate(keys), return_inverse=True)
        n, every = (np.bincount(which, unpacked(table.column(c))[0], len(known)).astype(np.int64) for c in ("n", "every"))
        # The more frequent, the smaller the number.
        ids = np.empty(len(known), np.int64)
        ids[np.argsort(-every, kind="stable")] = np.arange(len(known)) * self.parts + table.column("part")[0].as_py()
        out = {name: pa.array([pack(v[which[a:b]]) for a, b in zip(at, at[1:])], pa.binary()) for name, v in (("ids", ids), ("n", n), ("split", split_of(every, self.s)))}
        first = [0] * (len(keys) - 1)
        return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), **out, "total": pa.array([int(n.sum()), *first], pa.int64()), "kinds": pa.array([int((n > 0).sum()), *first], pa.int64())})

    def numbered(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shards' answers in place of the words."""
        for batch in batches:
            for k in range(batch.num_rows):
                part = self.word_part(np.frombuffer(batch.column("words")[k].as_py(), np.uint64))
                made = {f: pa.array([pack(v)], pa.binary()) for f, v in zip(NUMBERED, answers(batch.column("replies")[k], part, "ids", "n", "split"))}
                row = batch.slice(k, 1)
                yield pa.RecordBatch.from_pydict({c: row.column(c) for c in KEPT} | made)

    def words(self, batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
        return [unpack(batch.column(f"word_{f}")[k].as_py()) for f in ("ids", "n", "split")]

    # 2. pairs

    def pair_part(self, first: np.ndarray, second: np.ndarray, split: np.ndarray) -> np.ndarray:
        return mixed(first, mixed(second) % split) % self.parts

    def ask_pairs(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                c, (ids, n, split) = Chunk(batch, k), self.words(batch, k)
                a, b, ends, at = c.pairs(len(ids))
                seen, every = (counts(at[ends], len(a), f[ends]) for f in (c.counted, c.own))

                def columns(own: np.ndarray) -> dict[str, bytes]:
                    words, where = dense(np.concatenate((a[own], b[own])))
                    return {"ids": pack(ids[words]), "word_n": pack(n[words]), "a": pack(where[: len(own)]), "b": pack(where[len(own) :]), "n": pack(seen[own]), "every": pack(every[own])}

                yield from asked(batch.column("chunk")[k].as_py(), self.pair_part(ids[a], ids[b], split[a]), columns)

    def answer_pairs(self, table: pa.Table) -> pa.Table:
        ids, word_at = unpacked(table.column("ids"))
        word_n, _ = unpacked(table.column("word_n"))
        (a, at), (b, _), (n, _), (every, _) = (unpacked(table.column(c)) for c in ("a", "b", "n", "every"))
        words, place = dense(ids)
        n_of, base = np.zeros(len(words), np.int64), np.repeat(word_at[:-1], np.diff(at))
        n_of[place] = word_n
        word_n = n_of
        keys, _, which = distinct(place[a + base] * len(words) + place[b + base])
        a, b = np.divmod(keys, len(words))
        n, every = (np.bincount(which, v, len(keys)).astype(np.int64) for v in (n, every))
        m = self.s.pair_mass
        lower = (word_n + self.s.add) / self.norm
        own = np.log10((n + m * lower[b]) / (word_n[a] + m))
        some = n > 0
        trie = ngram_trie.opened(ngram_trie.image(ngram_trie.build(len(words), (a[some], b[some], quantised(own[some])))))
        rest = np.log10(m / (word_n + m))
        (node,) = trie.find(a, b)
        score = np.where(node >= 0, trie.levels[0].weights[node] if some.any() else 0, quantised(rest[a] + np.log10(lower)[b]))
        return replied(table, at, which, score=score, n=n, split=split_of(every, self.s))

    def paired(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                c, (ids, _, split) = Chunk(batch, k), self.words(batch, k)
                keys = np.sort(c.pair_keys(len(ids))[1])
                a, b = np.divmod(keys[begins(keys)], len(ids))
                part = self.pair_part(ids[a], ids[b], split[a])
                made = {f: pa.array([pack(v)], pa.binary()) for f, v in zip(PAIRED, answers(batch.column("replies")[k], part, "score", "n", "split"))}
                row = batch.slice(k, 1)
                yield pa.RecordBatch.from_pydict({c: row.column(c) for c in (*KEPT, *NUMBERED)} | made)

    # 3. triples

    def opened(self, batch: pa.RecordBatch, k: int) -> tuple:
        """A chunk with its triples and their shards, and the pairs' answers."""
        c, (ids, n, _) = Chunk(batch, k), self.words(batch, k)
        a, b, _, at = c.pairs(len(ids))
        score, pair_n, split = (unpack(batch.column(f"pair_{f}")[k].as_py()) for f in ("score", "n", "split"))
        before, after, ends, which = c.triples(at, len(a))
        third = b[after]
        part = mixed(ids[a[before]], ids[b[before]], mixed(ids)[third] % split[before]) % self.parts
        return c, ids, n, (a, b, at, score, pair_n), (before, after, third, ends, which, part)

    def ask_triples(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                c, ids, _, (a, b, _, score, pair_n), (before, after, third, ends, which, part) = self.opened(batch, k)
                seen, third, lower = counts(which, len(before), c.counted[ends]), ids[third], score[after]

                def columns(own: np.ndarray) -> dict[str, bytes]:
                    head = begins(before[own])  # they rise
                    context, where = before[own[head]], np.cumsum(head) - 1
                    return {"a": pack(ids[a[context]]), "b": pack(ids[b[context]]), "pair_n": pack(pair_n[context]), "context": pack(where), "c": pack(third[own]), "lower": pack(lower[own]), "n": pack(seen[own])}

                yield from asked(batch.column("chunk")[k].as_py(), part, columns)

    def answer_triples(self, table: pa.Table) -> pa.Table:
        (a, context_at), (b, _), (pair_n, _) = (unpacked(table.column(c)) for c in ("a", "b", "pair_n"))
        (context, at), (c, _), (lower, _), (n, _) = (unpacked(table.column(x)) for x in ("context", "c", "lower", "n"))
        words, place = dense(np.concatenate((a, b, c)))
        a, b, c = np.split(place, [len(a), 2 * len(a)])
        contexts, first, same = distinct(b * len(words) + a)
        b, a = np.divmod(contexts, len(words))
        pair_n = pair_n[first]
        keys, first, which = distinct(same[context + np.repeat(context_at[:-1], np.diff(at))] * len(words) + c)
        context, c = np.divmod(keys, len(words))
        n, lower, m = np.bincount(which, n, len(keys)), lower[first], self.s.triple_mass
        own = np.log10((n + m * TENTHS[lower]) / (pair_n[context] + m))
        # Contexts that were never seen have no node.
        kept, some = pair_n > 0, n > 0
        node = np.cumsum(kept) - 1
        rest = quantised(np.log10(m / (pair_n + m)))
        trie = ngram_trie.opened(ngram_trie.image(ngram_trie.build(len(words), (b[kept], a[kept], rest[kept]), (node[context[some]], c[some], quantised(own[some])))))
        pair = trie.levels[0].find(b, a)[context]
        triple = trie.levels[1].find(pair, c)
        back = np.where(pair >= 0, trie.levels[0].weights[pair] if kept.any() else 0, 0)
        score = np.where(triple >= 0, trie.levels[1].weights[triple] if some.any() else 0, np.minimum(65535, back + lower))
        return replied(table, at, which, score=score)

    # 4. sums

    def sums(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                c, _, n, (_, _, at, score, _), (_, _, _, ends, which, part) = self.opened(batch, k)
                own = np.log10((n + self.s.add) / self.norm)[c.codes]
                token = own.copy()
                second = np.flatnonzero(c.own & (c.place == 1))
                token[second] = -score[at[second]] / STEP
                token[ends] = -answers(batch.column("replies")[k], part, "score")[0][which] / STEP
                add = lambda v: np.bincount(c.doc[c.own], v[c.own], len(c.at) - 1)
                whole = {"n_tokens": add(np.ones(len(own))).astype(np.int64), "n_known": add((n > 0)[c.codes]).astype(np.int64), "base_score": add(own), "score": add(token)}
                row = batch.slice(k, 1)
                yield pa.RecordBatch.from_pydict({"row": row.column("row").flatten(), "id": row.column("id").flatten(), **{x: pa.array(v) for x, v in whole.items()}, "cut": pa.array(row.column("cut").to_pylist() * len(c.at[1:]), pa.bool_())})


def replied(table: pa.Table, at: np.ndarray, which: np.ndarray, **values: np.ndarray) -> pa.Table:
    out = {name: pa.array([pack(v[which[a:b]]) for a, b in zip(at, at[1:])], pa.binary()) for name, v in values.items()}
    return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), **out})


def of_group(answer: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A method as a function of a group, without the group's key."""
    return lambda table: answer(table)


KEPT = ["chunk", "cut", "row", "id", "train", "lead", "at", "codes"]
NUMBERED = ["word_ids", "word_n", "word_split"]
PAIRED = ["pair_score", "pair_n", "pair_split"]
BINARY = lambda *names: ", ".join(f"{x} binary" for x in names)


def scores(df: DataFrame, usable: Column | str, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id with n_tokens, n_known, train_tokens, base_score (additive unigram) and score (the trigram model's), both log10.  The model
    learns from the `usable` rows of df, all of them; other texts are scored by it as further rows of df that aren't usable.

    A null, empty or blank text is its end token alone.  Texts of any length are scored whole; repeated rows give a row
    each.  Without usable rows every token has probability one.
    """
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(F.monotonically_increasing_id().alias("row"), df[id_col].alias("id"), F.coalesce(F.expr(usable) if isinstance(usable, str) else usable, F.lit(False)).alias("train"), df[text_col].alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    with scratch(spark):
        with scratch(spark):
            with scratch(spark):
                made = materialize(chunks(docs, s))
                parts = 1 + int((made.agg(F.sum("tokens")).first()[0] or 0) // s.shard)
                p = Passes(s, parts)
                schema = ", ".join(f"{x} {made.schema[x].dataType.simpleString()}" for x in KEPT)
                words = materialize(made.mapInArrow(p.ask_words, f"part bigint, chunk bigint, {BINARY('keys', 'n', 'every')}").groupBy("part").applyInArrow(of_group(p.answer_words), f"chunk bigint, part bigint, {BINARY('ids', 'n', 'split')}, total bigint, kinds bigint"))
                total, kinds = words.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
                numbered = materialize(answered(made, words, "ids", "n", "split").mapInArrow(p.numbered, f"{schema}, {BINARY(*NUMBERED)}"), keep=True)
            p = Passes(s, parts, total, kinds)
            pairs = materialize(numbered.mapInArrow(p.ask_pairs, f"part bigint, chunk bigint, {BINARY('ids', 'word_n', 'a', 'b', 'n', 'every')}").groupBy("part").applyInArrow(of_group(p.answer_pairs), f"chunk bigint, part bigint, {BINARY('score', 'n', 'split')}"))
            paired = materialize(answered(numbered, pairs, "score", "n", "split").mapInArrow(p.paired, f"{schema}, {BINARY(*NUMBERED, *PAIRED)}"), keep=True)
        triples = materialize(paired.mapInArrow(p.ask_triples, f"part bigint, chunk bigint, {BINARY('a', 'b', 'pair_n', 'context', 'c', 'lower', 'n')}").groupBy("part").applyInArrow(of_group(p.answer_triples), f"chunk bigint, part bigint, {BINARY('score')}"))
        summed = materialize(answered(paired, triples, "score").mapInArrow(p.sums, f"row bigint, id {kind}, n_tokens bigint, n_known bigint, base_score double, score double, cut boolean"), keep=True)
    names = ["n_tokens", "n_known", "base_score", "score"]
    whole = summed.where("not cut").select("id", *names)
    pieces = summed.where("cut").groupBy("row").agg(F.first("id").alias("id"), *(F.sum(x).alias(x) for x in names)).drop("row")
    out = whole.unionByName(pieces).withColumn("train_tokens", F.lit(total).cast("bigint"))
    return out.select(F.col("id").alias(id_col), "n_tokens", "n_known", "train_tokens", "base_score", "score")
