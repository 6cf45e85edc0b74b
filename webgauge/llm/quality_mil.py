"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages.  Every passage is encoded (character classes, word shapes, repetition and a hashed
bag of words, then a learned tanh layer); gated attention weighs the passages; a logistic layer scores the weighted
sum.  Only documents carry labels, so the weights of passages are learned through them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounds, carried, inputs, opened, outputs, places, slices, utf8
from .quality_rules import CLASS_OF, CLASSES, SPACE
from .training import labelled_sample


@dataclass(frozen=True)
class Settings:
    sample: int = 4000
    """Labelled documents to learn from, about half of them of each label where there are enough."""
    max_passages: int = 150
    """Longer documents aren't learned from; they are scored like all others."""
    passage_words: int = 50
    buckets: int = 64
    hidden: int = 24
    attention: int = 12
    keep: float = 0.7
    """Share of the loss that documents of label 1 have: to lose a good one is worse than to keep a bad one."""
    epochs: int = 40
    bags: int = 64
    rate: float = 0.01
    decay: float = 1e-4
    seed: int = 7


POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


PIECE_BYTES = 512 << 10
"""Text whose characters are classed at a time, which takes some 70 times its size."""


def encode_passages(texts: list[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages end to end, and each text's offsets.  A text without words is one empty passage."""
    size = np.cumsum([0, *map(len, texts)])
    cuts = [0]
    while cuts[-1] < len(texts):  # a longer text is a piece of its own
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(size, size[cuts[-1]] + PIECE_BYTES, "right")) - 1))
    if len(cuts) < 3:
        return _encode_piece(texts, s)
    parts = [_encode_piece(texts[a:b], s) for a, b in zip(cuts, cuts[1:])]
    return np.concatenate([x for x, _ in parts]), bounds(n for _, at in parts for n in np.diff(at))


def _encode_piece(texts: list[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    at = bounds(map(len, texts))
    buf = np.frombuffer(b"".join(texts), np.uint8)
    width = len(CLASSES) + 8 + s.buckets
    space = SPACE[buf]
    start = ~space
    start[1:] &= space[:-1] | np.isin(np.arange(1, len(buf)), at[1:-1])
    first = np.flatnonzero(start)
    n_words = np.searchsorted(first, at[1:]) - np.searchsorted(first, at[:-1])
    n_passages = np.maximum(1, -(-n_words // s.passage_words))
    offsets = bounds(n_passages)
    out = np.zeros((offsets[-1], width), np.float32)
    if len(first):
        text_of = np.repeat(np.arange(len(texts)), n_words)
        nth = np.arange(len(first)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
        passage = offsets[text_of] + nth // s.passage_words
        used = np.flatnonzero(~space)
        word = np.cumsum(start)[used] - 1
        value = buf[used]
        kind = CLASS_OF[value]
        place = used - first[word]
        length = np.bincount(word, minlength=len(first))
        # Words of over 64 bytes reuse the powers.
        h = np.zeros(len(first), np.uint64)
        np.add.at(h, word, (value.astype(np.uint64) + np.uint64(1)) * POWERS[place & 63])
        h ^= h >> np.uint64(29)
        n = np.bincount(passage, minlength=len(out)).astype(np.float32)
        some = np.maximum(n, 1)
        chars = np.bincount(passage[word] * len(CLASSES) + kind, minlength=len(out) * len(CLASSES)).reshape(len(out), -1)
        out[:, : len(CLASSES)] = np.sqrt(chars / np.maximum(1, chars.sum(1, keepdims=True)))
        upper = np.bincount(word, kind == CLASSES.index("upper"), len(first))
        letters = np.bincount(word, kind <= CLASSES.index("upper"), len(first))
        same = np.concatenate(([False], (h[1:] == h[:-1]) & (passage[1:] == passage[:-1])))
        symbol = np.bincount(word, np.isin(kind, [CLASSES.index("symbol"), CLASSES.index("mark")]), len(first)) > 0
        order = np.lexsort((h, passage))
        fresh = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (passage[order][1:] != passage[order][:-1])))
        k = len(CLASSES)
        for j, x in enumerate((length / 16, (upper == letters) & (letters > 1), same, symbol, length == 1, length > 20)):
            out[:, k + j] = np.bincount(passage, x, len(out)) / some
        out[:, k + 6] = np.bincount(passage[order], fresh, len(out)) / some
        out[:, k + 7] = n / s.passage_words
        bag = np.bincount(passage * s.buckets + (h % np.uint64(s.buckets)).astype(np.int64), minlength=len(out) * s.buckets).reshape(len(out), -1)
        out[:, k + 8 :] = np.sqrt(bag / some[:, None])
    return out, offsets


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


class Model:
    """Weights; learned by Adam on the bags' log loss."""

    def __init__(self, width: int, s: Settings):
        r = np.random.default_rng(s.seed)
        g = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.s, self.mean, self.std = s, np.zeros(width, np.float32), np.ones(width, np.float32)
        self.w = {"W": g(width, s.hidden), "b": np.zeros(s.hidden, np.float32), "V": g(s.hidden, s.attention), "U": g(s.hidden, s.attention), "a": g(s.attention), "c": g(s.hidden), "d": np.zeros(1, np.float32)}

    def _forward(self, x: np.ndarray, at: np.ndarray) -> tuple:
        w = self.w
        h = np.tanh((x - self.mean) / self.std @ w["W"] + w["b"])
        v, u = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        e = (v * u) @ w["a"]
        lens = np.diff(at)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at[:-1]), lens))
        alpha = e / np.repeat(np.add.reduceat(e, at[:-1]), lens)
        z = np.add.reduceat(alpha[:, None] * h, at[:-1])
        return h, v, u, alpha, z, _sigmoid(z @ w["c"] + w["d"])

    def score(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._forward(x, at)[-1]

    def _gradients(self, x: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        w, lens = self.w, np.diff(at)
        h, v, u, alpha, z, p = self._forward(x, at)
        g = (p - y) * weight / weight.sum()
        dz = np.repeat(g[:, None] * w["c"], lens, 0)
        dalpha = (dz * h).sum(1)
        de = alpha * (dalpha - np.repeat(np.add.reduceat(alpha * dalpha, at[:-1]), lens))
        dv, du = de[:, None] * w["a"] * u * (1 - v * v), de[:, None] * w["a"] * v * u * (1 - u)
        dh = (alpha[:, None] * dz + dv @ w["V"].T + du @ w["U"].T) * (1 - h * h)
        return {"W": ((x - self.mean) / self.std).T @ dh, "b": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "a": (v * u).T @ de, "c": z.T @ g, "d": g.sum(keepdims=True)}

    def fit(self, x: np.ndarray, at: np.ndarray, y: np.ndarray) -> Model:
        s, r = self.s, np.random.default_rng(self.s.seed + 1)
        if not len(y):
            return self
        self.mean, self.std = x.mean(0), x.std(0) + 0.05
        weight = np.where(y == 1, s.keep / max(1, (y == 1).sum()), (1 - s.keep) / max(1, (y == 0).sum())).astype(np.float32)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        q = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for _ in range(s.epochs):
            order = r.permutation(len(y))
            for part in np.array_split(order, max(1, len(y) // s.bags)):
                lens = np.diff(at)[part]
                rows = np.repeat(at[part] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
                g = self._gradients(x[rows], bounds(lens), y[part], weight[part])
                step += 1
                for k in self.w:
                    d = g[k] + s.decay * self.w[k]
                    m[k] += 0.1 * (d - m[k])
                    q[k] += 0.01 * (d * d - q[k])
                    self.w[k] = (self.w[k] - s.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(q[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self


def train(df: DataFrame, labels: DataFrame, usable: Column | str, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from a bounded sample: its passages are encoded on the executors, the weights are fitted here.  Without labelled rows, or
    with rows of one label only, the model still scores: all alike or nearly so."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, at = encode_passages(utf8(batch.column("text")), s)
            n = np.diff(at)
            kept = n <= s.max_passages
            bags = [x[a:b].astype(np.float16).tobytes() if k else None for a, b, k in zip(at, at[1:], kept)]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "label": batch.column("label"), "bag": pa.array(bags, pa.binary())})

    docs = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    sample = labelled_sample(docs, labels, label_col, usable, s.sample, s.seed, label_id=id_col)
    rows = sample.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, label int, bag binary").where("bag is not null").collect()
    rows.sort(key=lambda r: (r.id, bytes(r.bag)))
    width = len(CLASSES) + 8 + s.buckets
    bags = [np.frombuffer(r.bag, np.float16).reshape(-1, width) for r in rows]
    x = np.concatenate(bags).astype(np.float32) if bags else np.zeros((0, width), np.float32)
    return Model(width, s).fit(x, bounds(map(len, bags)), np.array([r.label for r in rows], np.float32))


def scores(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Each row's id with its score, 0 to 1.  Null, empty and blank texts are one empty passage, whose score the model gives too; texts of any
    length are scored whole; repeated rows give a row each.  carry adds `row`, all columns of df."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(opened(batches, where)):
            x, at = encode_passages(utf8(batch.column("text")), model.s)
            p = np.concatenate([model.score(x[at[k] : at[j]], at[k : j + 1] - at[k]) for k, j in _runs(at)]) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "score": pa.array(p.astype(np.float64))} | carried(batch))

    docs, where = inputs(df, id_col, text_col, carry), places(df, id_col, text_col)
    return docs.mapInArrow(run, outputs(docs, df.schema[id_col].dataType, "score double")).withColumnRenamed("id", id_col)


def _runs(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of bags with about 8192 passages."""
    k = 0
    while k < len(at) - 1:
        j = max(k + 1, int(np.searchsorted(at, at[k] + 8192, "right")) - 1)
        yield k, j
        k = j


def predicted(scored: DataFrame) -> DataFrame:
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
