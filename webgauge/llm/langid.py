"""Language identification by prediction by partial matching.

Each language has a context tree over bytes, up to `order` bytes deep, whose nodes count the bytes that followed.  A
byte's code length is that in the longest context where it was seen, plus those of the escapes from the longer ones
(escape method C: an escape counts as often as there are distinct followers); the root escapes to a flat choice of 256
bytes.  Counts are frozen after training, so a byte's code length depends on the bytes just before it alone.  The language with the shortest code wins.

Trees are kept as tables: for each depth, a hash table from the bytes of context and follower to their row of code lengths by language,
and one from the context to its row of escape lengths.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounds, slices, utf8


@dataclass(frozen=True)
class Settings:
    order: int = 3
    sample: int = 400
    """Documents of a language to learn from, about."""
    max_bytes: int = 200_000
    """Longer documents aren't learned from; they are scored like all others."""
    max_languages: int = 200
    seed: int = 3


class Table:
    """Keys (not 0) to rows, by multiplicative hashing and linear probing, for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.rows = np.zeros(1 << self.bits, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[left[free]]  # of several for a slot the last stays
            won = self.keys[slot] == keys[left]
            self.rows[slot[won]] = left[won]
            left, slot = left[~won], (slot[~won] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Rows, or -1."""
        out = np.full(len(keys), -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self.rows[slot[hit]]
            on = ~hit & (there != 0)
            left, slot = left[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out


def grams(buf: np.ndarray, n: int) -> np.ndarray:
    """The n bytes that end at each place, as a number with a leading 1; buf has n - 1 bytes before the first place."""
    key = np.ones(len(buf) - n + 1, np.uint64)
    for k in range(n):
        key = key << np.uint64(8) | buf[k : len(buf) - n + 1 + k].astype(np.uint64)
    return key


class Model:
    """counts: for each language, the number of occurrences of each gram of order + 1 bytes."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int):
        self.langs, self.order = sorted(counts), order
        self.lengths: list[tuple[Table, np.ndarray]] = []  # by depth: context and follower -> bits
        self.escapes: list[tuple[Table, np.ndarray]] = []  # by depth: context -> bits of the escape
        for depth in range(order + 1):
            per = []
            for lang in self.langs:
                keys, n = counts[lang]
                low = (keys & np.uint64((1 << 8 * (depth + 1)) - 1)) | np.uint64(1 << 8 * (depth + 1))
                own, at = np.unique(low, return_inverse=True)
                per.append((own, np.bincount(at, n).astype(np.int64)))
            every = np.unique(np.concatenate([k for k, _ in per])) if per else np.zeros(0, np.uint64)
            contexts = np.unique(every >> np.uint64(8))
            esc = np.zeros((len(contexts), len(self.langs)), np.float32)
            value = np.zeros((len(every), len(self.langs)), np.float32)
            for j, (keys, n) in enumerate(per):
                ctx = np.searchsorted(contexts, keys >> np.uint64(8))
                total = np.bincount(ctx, n, len(contexts))
                kinds = np.bincount(ctx, minlength=len(contexts))
                seen = kinds > 0
                esc[seen, j] = np.log2((total + kinds)[seen] / kinds[seen])
                value[:, j] = self._lower(every, depth, j) + esc[np.searchsorted(contexts, every >> np.uint64(8)), j]
                value[np.searchsorted(every, keys), j] = np.log2((total + kinds)[ctx] / n)
            self.escapes.append((Table(contexts), esc))
            self.lengths.append((Table(every), value))

    def _lower(self, keys: np.ndarray, depth: int, j: int) -> np.ndarray:
        """Code length of the follower by the next shorter context."""
        if depth == 0:
            return np.full(len(keys), 8.0, np.float32)
        low = (keys & np.uint64((1 << 8 * depth) - 1)) | np.uint64(1 << 8 * depth)
        return self.bits(low, depth - 1)[:, j]

    def bits(self, keys: np.ndarray, depth: int) -> np.ndarray:
        """Code lengths by language of the last byte of each key, given the `depth` bytes before it."""
        if depth < 0:
            return np.full((len(keys), len(self.langs)), 8.0, np.float32)
        table, value = self.lengths[depth]
        row = table.find(keys)
        out = value[row]
        gone = np.flatnonzero(row < 0)
        if len(gone):
            contexts, esc = self.escapes[depth]
            ctx = contexts.find(keys[gone] >> np.uint64(8))
            low = (keys[gone] & np.uint64((1 << 8 * depth) - 1)) | np.uint64(1 << 8 * depth)
            out[gone] = self.bits(low, depth - 1) + np.where((ctx >= 0)[:, None], esc[ctx], 0)
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text by language.  A text is coded after spaces."""
        pad = b" " * self.order
        buf = np.frombuffer(b"".join(pad + t for t in texts), np.uint8)
        at = bounds(len(t) + self.order for t in texts)
        out = np.zeros((len(texts), len(self.langs)))
        if not self.langs or len(buf) <= self.order:
            return out
        keys = grams(buf, self.order + 1)
        text = np.repeat(np.arange(len(texts)), np.diff(at))[self.order :]
        # A place that belongs to a text and has its whole context there; the first places have the spaces.
        inside = np.arange(self.order, len(buf)) - at[text] >= self.order
        for a in range(0, len(keys), 1 << 18):
            part = slice(a, a + (1 << 18))
            use = inside[part]
            bits, of = self.bits(keys[part][use], self.order), text[part][use]
            for j in range(len(self.langs)):
                out[:, j] += np.bincount(of, bits[:, j], len(texts))
        return out


#: Fixed value: A-Z in lower case.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def train(df: DataFrame, usable: Column | str, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from about s.sample documents of each language, picked by a hash of their ids.  Of more than s.max_languages values of lang those with
    most documents are learned, of equal ones the first by name, so a dirty column doesn't stop the job.  Gram counts are made and
    summed on the executors; what comes here is bounded by the sample."""
    known = df.where(usable).select(df[id_col].alias("id"), df[text_col].alias("text"), df[lang_col].alias("lang")).where("lang is not null")
    most = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(s.max_languages)
    n = {r.lang: r["count"] for r in most.collect()}
    share = F.lit(0.0)
    for lang, rows in n.items():
        share = F.when(F.col("lang") == lang, s.sample / rows).otherwise(share)
    picked = known.where((F.pmod(F.xxhash64(F.col("id"), F.lit(s.seed)), F.lit(1 << 30)) / (1 << 30) < share) & (F.octet_length("text") <= s.max_bytes))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), utf8(batch.column("text"))):
                by.setdefault(lang, []).append(b" " * s.order + text.translate(LOWER))
            for lang, texts in by.items():
                parts = [grams(np.frombuffer(t, np.uint8), s.order + 1) for t in texts if len(t) > s.order]
                if parts:
                    keys, count = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": [lang] * len(keys), "gram": pa.array(keys.view(np.int64)), "n": pa.array(count, pa.int64())})

    rows = picked.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs, keys, count = np.array(rows.column("lang").to_pylist(), object), rows.column("gram").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    return Model({x: (keys[langs == x], count[langs == x]) for x in set(langs)}, s.order)


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id with lang_pred and score, the posterior of that language under a flat prior, 0 to 1.

    A text that is null or has no letter is `und` with score 0, and so is any text where nothing was learned.  Of
    languages with equal code lengths the first by name wins.  Texts of any length are coded whole; repeated rows give
    a row each.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)  # s.sample documents of each language

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in slices(batches):
            bits = m.code_lengths([t.translate(LOWER) for t in utf8(batch.column("text"))])
            if m.langs and len(bits):
                best = bits.argmin(1)
                score = 1 / np.exp2(-np.minimum(1000, bits - bits.min(1, keepdims=True))).sum(1)
                pred = [m.langs[k] if some else "und" for k, some in zip(best, batch.column("letter").to_pylist())]
            else:
                pred, score = ["und"] * len(bits), np.zeros(len(bits))
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "lang_pred": pa.array(pred, pa.string()), "score": pa.array([x if p != "und" else 0.0 for p, x in zip(pred, score)], pa.float64())})

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter")
    docs = df.select(df[id_col].alias("id"), df[text_col].alias("text")).select("id", "text", letter)
    return docs.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_col)
