"""Benchmark decontamination with an FM-index per shard of the training texts.

A task cuts its documents into shards.  Words that no benchmark item holds can't be part of an occurrence, nor can a
stretch between such words that is shorter than the shortest window; what is left of a shard is indexed: suffix array
by prefix doubling, Burrows-Wheeler transform in a wavelet matrix, suffix positions sampled.  All windows of the
benchmark are searched backward at once; rows of the found intervals walk to sampled positions.  Overlapping
occurrences are merged into spans of words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounds, carried, csr_take, inputs, opened, outputs, places, slices, utf8

WINDOW = 13
SHARD_BYTES = 4 << 20
"""Text that is indexed at a time; the index and the figures of its words take some 20 times a word's number."""
SAMPLE = 8
MAX_BENCHMARK_BYTES = 8 << 20
"""Distinct benchmark text that is sent to all executors at once, as windows of 13 numbers a word; a larger benchmark is searched in
blocks of about this size."""

#: A-Z in lower case; all other ASCII but digits and letters separates words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Wavelet:
    """Wavelet matrix over symbols: rank of many symbols at many positions in one pass over the bits."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = []
        self.bits = max(1, int(size - 1).bit_length())
        start = np.zeros(size, np.int64)
        every = np.arange(size)
        for b in reversed(range(self.bits)):
            one = (symbols >> b & 1).astype(bool)
            words = np.zeros(len(one) // 64 + 1, np.uint64)
            packed = np.packbits(one, bitorder="little")
            words.view(np.uint8)[: len(packed)] = packed
            level = words, np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64))), int(len(one) - one.sum())
            self.levels.append((b, level))
            start = self._step(level, every >> b & 1, start)
            symbols = np.concatenate((symbols[~one], symbols[one]))
        self.start = start

    @staticmethod
    def _ones(level: tuple, at: np.ndarray) -> np.ndarray:
        words, before, _ = level
        return before[at >> 6] + np.bitwise_count(words[at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    def _step(self, level: tuple, bit: np.ndarray, at: np.ndarray) -> np.ndarray:
        ones = self._ones(level, at)
        return np.where(bit == 1, level[2] + ones, at - ones)

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position."""
        for b, level in self.levels:
            at = self._step(level, symbols >> b & 1, at)
        return at - self.start[symbols]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and its rank there."""
        symbols = np.zeros(len(at), np.int64)
        for b, level in self.levels:
            bit = (level[0][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            symbols |= bit << b
            at = self._step(level, bit, at)
        return symbols, at - self.start[symbols]


def suffix_array(symbols: np.ndarray, size: int) -> np.ndarray:
    """By prefix doubling.  Each 0 is a symbol of its own, ordered by place, so that no comparison runs over it.
    After a pass only suffixes that still share their rank are sorted again."""
    n = len(symbols)
    ends = symbols == 0
    key = np.where(ends, np.cumsum(ends) - 1, symbols + ends.sum())
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    group = np.diff(np.append(first, n))
    open_ = order[np.repeat(group > 1, group)]
    h = 1
    while len(open_):
        nxt = np.where(open_ + h < n, rank[np.minimum(open_ + h, n - 1)] + 1, 0)
        key = rank[open_] * (n + 1) + nxt
        by = np.argsort(key, kind="stable")
        open_, key = open_[by], key[by]
        base = rank[open_]
        top = np.concatenate(([True], base[1:] != base[:-1]))
        new = np.concatenate(([True], key[1:] != key[:-1]))
        at = np.arange(len(open_))
        group_at = np.maximum.accumulate(np.where(top, at, 0))
        sub_at = np.maximum.accumulate(np.where(new, at, 0))
        rank[open_] = base + sub_at - group_at
        sizes = np.diff(np.append(np.flatnonzero(new), len(open_)))
        open_ = open_[np.repeat(sizes > 1, sizes)]
        h *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class FmIndex:
    """symbols: 1.. for words, 0 between stretches and at the end."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.n = len(symbols)
        order = suffix_array(symbols, size)
        before = symbols[order - 1]  # of the first suffix: the last symbol, a 0
        self.wavelet = Wavelet(before, size)
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=size))))
        # Suffixes that follow a 0 are sampled too: no walk goes over a 0.
        kept = (order % SAMPLE == 0) | (before == 0)
        self.sampled, self.place = kept, np.cumsum(kept) - 1
        self.samples = order[kept]

    def search(self, patterns: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix interval of each pattern; patterns are right-aligned rows."""
        low, high = np.zeros(len(lens), np.int64), np.full(len(lens), self.n)
        live = np.arange(len(lens))
        for k in range(patterns.shape[1]):
            live = live[(low[live] < high[live])]
            go = live[lens[live] > k]
            if not len(go):
                break
            c = patterns[go, patterns.shape[1] - 1 - k]
            low[go] = self.smaller[c] + self.wavelet.rank(c, low[go])
            high[go] = self.smaller[c] + self.wavelet.rank(c, high[go])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live, at = np.arange(len(rows)), rows.copy()
        while len(live):
            done = self.sampled[at]
            out[live[done]] = self.samples[self.place[at[done]]] + steps[live[done]]
            live, at = live[~done], at[~done]
            c, before = self.wavelet.access(at)
            at = self.smaller[c] + before
            steps[live] += 1
        return out


class Benchmark:
    """The windows of all items: their words as symbols, and which items have each."""

    def __init__(self, texts: list[tuple[str, list[str]]], window: int):
        """texts: each distinct text with the ids of its items."""
        self.vocab: dict[bytes, int] = {}
        split = [words_of(t.encode()) for t, _ in texts]
        flat = np.fromiter((self.vocab.setdefault(w, len(self.vocab) + 1) for s in split for w in s), np.int32)
        at = bounds(map(len, split))
        rows, text = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int64)]
        for k, (a, b) in enumerate(zip(at, at[1:])):
            if b - a >= window:
                rows.append(np.lib.stride_tricks.sliding_window_view(flat[a:b], window))
            elif b > a:
                rows.append(np.pad(flat[a:b], (window - (b - a), 0))[None])
            text.append(np.full(len(rows[-1]), k) if b > a else text[0])
        rows, text = np.concatenate(rows), np.concatenate(text)
        self.patterns, which = np.unique(rows, axis=0, return_inverse=True)
        self.lens = (self.patterns > 0).sum(1)
        self.least = int(self.lens.min()) if len(self.lens) else 0
        self.names = sorted({x for _, names in texts for x in names})
        place = {x: i for i, x in enumerate(self.names)}
        own = [np.array([place[x] for x in names], np.int64) for _, names in texts]
        own_at = bounds(map(len, own))
        owners, n = csr_take(own_at, np.concatenate([np.zeros(0, np.int64), *own]), text)
        size = max(1, len(self.names))
        pairs = np.unique(np.repeat(which.ravel(), n) * size + owners)
        self.owners = pairs % size
        self.owner_at = np.searchsorted(pairs // size, np.arange(len(self.patterns) + 1))

    def occurrences(self, ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and window of each occurrence in a shard.  ids: symbols of its words, 0 for others."""
        none = np.zeros(0, np.int64)
        if not len(ids) or not len(self.lens):
            return none, none
        known = ids > 0
        cut = np.concatenate(([True], ~known[:-1] | (doc[1:] != doc[:-1])))
        starts = np.flatnonzero(known & cut)
        stops = np.flatnonzero(known & np.concatenate((cut[1:] | ~known[1:], [True]))) + 1
        long = stops - starts >= self.least
        starts, lens = starts[long], (stops - starts)[long]
        if not len(starts):
            return none, none
        at = np.repeat(starts - np.concatenate(([0], np.cumsum(lens + 1)[:-1])), lens + 1) + np.arange((lens + 1).sum())
        text = ids[np.minimum(at, len(ids) - 1)]
        text[np.cumsum(lens + 1) - 1] = 0
        index = FmIndex(text, len(self.vocab) + 1)
        low, high = index.search(self.patterns, self.lens)
        n = high - low
        rows = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return at[index.locate(rows)], np.repeat(np.arange(len(n)), n)


def _shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in slices(batches, "text", SHARD_BYTES // 4):
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= SHARD_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


SPANS = "n_words bigint, spans array<struct<start:int,stop:int>>, items array<string>"


def _find(df: DataFrame, id_col: str, text_col: str, carry: bool, benchmark: Benchmark) -> DataFrame:
    docs, where = inputs(df, id_col, text_col, carry), places(df, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(benchmark)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = sent.value
        look = b.vocab.get
        for batch in _shards(opened(batches, where)):
            # A text's words are gone before the next text's are there.
            split = [np.fromiter(map(look, words_of(t), repeat(0)), np.int32) for t in utf8(batch.column("text"))]
            at = bounds(map(len, split))
            ids = np.concatenate([np.zeros(0, np.int64), *split])
            doc = np.repeat(np.arange(len(split)), np.diff(at))
            first, window = b.occurrences(ids, doc)
            mark = np.zeros(len(ids) + 1, np.int64)
            np.add.at(mark, first, 1)
            np.add.at(mark, first + b.lens[window], -1)
            hit = np.concatenate(([0], (np.cumsum(mark[:-1]) > 0).astype(np.int64), [0]))
            # A span ends at a document's end even if the next one begins with a hit.
            edge = np.zeros(len(ids) + 1, bool)
            edge[at] = True
            start = np.flatnonzero((hit[1:-1] == 1) & ((hit[:-2] == 0) | edge[:-1]))
            stop = np.flatnonzero((hit[1:-1] == 1) & ((hit[2:] == 0) | edge[1:])) + 1
            span_doc = doc[start] if len(start) else start
            owners, n = csr_take(b.owner_at, b.owners, window)
            pairs = np.unique(np.repeat(doc[first] if len(first) else first, n) * len(b.names) + owners) if len(first) else np.zeros(0, np.int64)
            item_doc, item = np.divmod(pairs, max(1, len(b.names)))
            counts = np.arange(len(split) + 1)
            spans = pa.StructArray.from_arrays([pa.array(start - at[span_doc], pa.int32()), pa.array(stop - at[span_doc], pa.int32())], ["start", "stop"])
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id"), "n_words": pa.array(np.diff(at), pa.int64()),
                "spans": pa.ListArray.from_arrays(pa.array(np.searchsorted(span_doc, counts), pa.int32()), spans),
                "items": pa.ListArray.from_arrays(pa.array(np.searchsorted(item_doc, counts), pa.int32()), pa.array([b.names[i] for i in item], pa.string())),
                **carried(batch),
            })

    return docs.mapInArrow(run, outputs(docs, df.schema[id_col].dataType, SPANS))


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_benchmark_bytes: int = MAX_BENCHMARK_BYTES, carry: bool = False) -> DataFrame:
    """Each row's id with n_words, `spans` (first word and the word after the last of each merged occurrence) and
    `items` (ids of the items found, sorted as strings).

    A null or blank text has no words and no hits, a null or blank item no windows; an item id that is null counts as
    the empty string.  An empty benchmark hits nothing.  Repeated rows give a row each; items with the same windows
    are all found.  A benchmark beyond max_benchmark_bytes is searched in blocks, whose spans are merged.  carry adds `row`, all
    columns of df.
    """
    item = F.coalesce(benchmark[item_col].cast("string"), F.lit("")).alias("item")
    items = benchmark.select(item, benchmark[item_text_col].alias("text")).where("text is not null").groupBy("text").agg(F.collect_set("item").alias("items"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // max_benchmark_bytes) or 1
    if blocks == 1:
        return _find(df, id_col, text_col, carry, Benchmark([(r.text, r["items"]) for r in items.collect()], window)).withColumnRenamed("id", id_col)
    parts = None
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64(F.col("text")), F.lit(blocks)) == k).collect()
        found = _find(df, id_col, text_col, True, Benchmark([(r.text, r["items"]) for r in block], window))
        parts = found if parts is None else parts.unionByName(found)
    key = F.sha2(F.to_json("row", {"ignoreNullFields": "false"}), 256)
    merged = parts.withColumn("key", key).groupBy("id", "key").agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.first("row").alias("row"), (F.count("*") / blocks).cast("int").alias("copies"))
    # Spans by their start; one that begins after all before it have ended opens a new span.
    span, spans = "struct<start:int,stop:int>", F.array_sort("spans")
    grown = F.aggregate(spans, F.array().cast(f"array<{span}>"), lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["stop"] > x["start"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], x["stop"]).alias("stop"))))).otherwise(F.concat(acc, F.array(x))))
    return merged.withColumn("spans", grown).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(F.col("id").alias(id_col), "n_words", "spans", "items", *["row"] * carry)


def verdict(found: DataFrame, percent: int = 5) -> DataFrame:
    """n_hit, n_items and whether hit words make up `percent` of the words or more."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, x: acc + (x["stop"] - x["start"]))
    return found.withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("bigint")).withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words")))

