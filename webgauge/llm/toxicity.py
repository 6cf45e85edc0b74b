"""Toxicity classifier: subword-bag embeddings averaged into a linear softmax.

A word is the mean of the embeddings of its character n-grams (hashed into buckets) and of the word itself; a window of words is the mean of its words;
a linear softmax over it gives the classes.  Embeddings and softmax are trained jointly.  A document has label and score by
its windows: the most toxic one decides, so a long text doesn't drown one insult.  All windows of a text have as many words, and
every one of that length counts, so neither what stands around an insult nor the text's length changes its weight.  While training, a toxic document's
windows are first all taken as toxic, later only those that the model itself finds so, the best one at least.

Scoring uses that the softmax is linear: each bucket's share in the logit is one number, and so is each word's.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .common import Numbered, bounds, csr_take, number, slices, small_batches, utf8
from .training import labelled_sample


@dataclass(frozen=True)
class Settings:
    sample: int = 6000
    """Labelled documents to learn from, about a third of them toxic where there are enough."""
    max_words: int = 3000
    max_bytes: int = 24_000
    """Longer documents aren't learned from, which bounds the sample by sample * max_bytes; they are scored like all others."""
    window: int = 12
    least: int = 3
    most: int = 5
    longest: int = 10
    buckets: int = 1 << 16
    width: int = 8
    epochs: int = 10
    batch: int = 256
    rate: float = 0.1
    least_documents: int = 3
    """An n-gram of fewer learning documents isn't learned."""
    most_weight: float = 3.0
    heard: float = 0.6
    """Share of a word's n-grams that a learning step uses."""
    clean_windows: int = 24_000
    """Clean windows of a pass."""
    seed: int = 11


CACHED = 500_000
"""Words whose logit a task remembers; further ones are worked out again for each slice."""

#: A-Z in lower case; ASCII but letters and digits separates words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


LONG, OVERLAP = 64, 32
"""Longer words are cut into pieces of so many bytes; two neighbours share so many."""


def pieces(word: bytes) -> list[bytes]:
    """Overlapping pieces, none of which begins or ends within a letter.  A sequence of OVERLAP - 6 bytes is whole in one."""
    out, start = [], 0
    while len(word) - start > LONG:
        stop = start + LONG
        while word[stop] & 0xC0 == 0x80:
            stop -= 1
        out.append(word[start:stop])
        start = stop - OVERLAP
        while word[start] & 0xC0 == 0x80:
            start -= 1
    return [*out, word[start:]]


def words_of(text: bytes) -> list[bytes]:
    """Runs of word bytes.  Text without spaces is one run: long ones become several words, so that all of it counts."""
    words = text.translate(FOLD).split()
    return [p for w in words for p in pieces(w)] if max(map(len, words), default=0) > LONG else words


def subwords(word: bytes, s: Settings) -> list[int]:
    """Buckets of the word, of its n-grams of letters with marks at both ends, and of its longer beginnings."""
    w = b"<" + word + b">"
    mask = s.buckets - 1
    out = [crc32(word) & mask]
    starts = [k for k in range(len(w)) if w[k] & 0xC0 != 0x80] + [len(w)]
    for n in range(s.least, s.most + 1):
        out += [crc32(w[a:b], n) & mask for a, b in zip(starts, starts[n:])]
    out += [crc32(w[:b], 99) & mask for b in starts[s.most + 1 : s.longest + 1]]
    return out


def starts(n: int, size: int) -> list[int]:
    """Where the windows that are learned from begin: one after the other, the last one at the text's end."""
    return [*range(0, n - size + 1, size), *([n - size] if n % size else [])] if n > size else [0]


def best_windows(value: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The highest mean of `size` neighbours in each run value[at[i]:at[i + 1]], of all its values where it has fewer, 0 where it has none."""
    lens = np.diff(at)
    n = np.maximum(1, lens - size + 1)
    sums = np.concatenate(([0], np.cumsum(value)))
    doc_at = np.cumsum(n) - n
    first = np.repeat(at[:-1] - doc_at, n) + np.arange(n.sum())
    long = np.repeat(np.minimum(size, lens), n)
    mean = (sums[first + long] - sums[first]) / np.maximum(1, long)
    return np.maximum.reduceat(mean, doc_at) if len(n) else mean


def _runs(first: np.ndarray, lens: np.ndarray, data: np.ndarray) -> np.ndarray:
    """data[first[i]:first[i] + lens[i]] for all i, end to end."""
    ends = np.cumsum(lens)
    return data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - lens), lens)]


class Model:
    def __init__(self, s: Settings):
        r = np.random.default_rng(s.seed)
        self.s = s
        self.E = (r.standard_normal((s.buckets, s.width)) * 0.01).astype(np.float32)
        self.W = r.standard_normal((s.width, 2)).astype(np.float32)
        self.b = np.zeros(2, np.float32)

    def fit(self, docs: Iterable[list[bytes]], y: np.ndarray) -> Model:
        """docs: each document's words, which are asked for one after the other and not kept."""
        s, r = self.s, np.random.default_rng(self.s.seed + 1)
        ids = Numbered()
        own = [number(d, ids).astype(np.int32) for d in docs]
        at = bounds(map(len, own))
        flat = np.concatenate([*own, np.zeros(0, np.int32)])
        del own
        if not len(flat):
            return self
        subs = [subwords(w, s) for w in ids]
        sub_at, sub = bounds(map(len, subs)), np.fromiter((x for v in subs for x in v), np.int32)
        del subs
        # Buckets of too few documents keep their start, next to nothing.
        rare = np.zeros(s.buckets, np.int64)
        for a, b in zip(at, at[1:]):
            rare[np.unique(csr_take(sub_at, sub, np.unique(flat[a:b]))[0])] += 1
        rare = rare < s.least_documents
        begin = [starts(n, s.window) for n in np.diff(at).tolist()]
        per = np.fromiter(map(len, begin), np.int64, len(begin))
        doc = np.repeat(np.arange(len(begin)), per)
        first = np.fromiter((k for b in begin for k in b), np.int64, len(doc)) + at[doc]
        lens = np.minimum(s.window, np.diff(at))[doc]
        label = y[doc]
        fine = lens > 0
        gE, gW, gb = (np.full_like(v, 1e-10) for v in (self.E, self.W, self.b))
        for epoch in range(s.epochs):
            if epoch >= 2:
                p = self.probability(flat, first, lens, sub_at, sub)
                best = np.zeros(len(begin), np.float32)
                np.maximum.at(best, doc, p)
                label = (y[doc] == 1) & ((p >= 0.5) | (p >= best[doc]))
            pos, neg = np.flatnonzero(fine & (label == 1)), np.flatnonzero(fine & (label == 0))
            if epoch >= 2:  # the clean windows that look most toxic, and others at random
                hard = np.argsort(-p[neg], kind="stable")[: s.clean_windows // 2]
                neg = np.union1d(neg[hard], neg[r.permutation(len(neg))[: s.clean_windows // 2]])
            order = np.concatenate((pos, neg))
            up = min(s.most_weight, max(1.0, len(neg) / max(1, len(pos))))
            order = order[r.permutation(len(order))]
            for part in np.array_split(order, max(1, len(order) // s.batch)):
                size = lens[part]
                words = _runs(first[part], size, flat)
                own, back = np.unique(words, return_inverse=True)
                grams, n = csr_take(sub_at, sub, own)
                # A random part of a word's n-grams is left out, so that no single one carries the word.
                heard = r.random(len(grams)) < s.heard
                heard[np.cumsum(n) - n] = True
                n = np.add.reduceat(heard, np.cumsum(n) - n, dtype=np.int64)
                grams = grams[heard]
                vec = np.add.reduceat(self.E[grams], np.cumsum(n) - n) / n[:, None]
                win = np.add.reduceat(vec[back], np.cumsum(size) - size) / size[:, None]
                logit = win @ self.W + self.b
                e = np.exp(logit - logit.max(1, keepdims=True))
                g = e / e.sum(1, keepdims=True)
                t = label[part].astype(int)
                g[np.arange(len(t)), t] -= 1
                g *= np.where(t == 1, up, 1.0)[:, None] / s.batch
                dW, db, dwin = win.T @ g, g.sum(0), g @ self.W.T
                dvec = np.zeros_like(vec)
                np.add.at(dvec, back, np.repeat(dwin / size[:, None], size, 0))
                dgram = np.repeat(dvec / n[:, None], n, 0)
                touched, where = np.unique(grams, return_inverse=True)
                dE = np.stack([np.bincount(where, dgram[:, j], len(touched)) for j in range(s.width)], 1).astype(np.float32)
                dE[rare[touched]] = 0
                gE[touched] += dE * dE
                self.E[touched] -= s.rate * dE / np.sqrt(gE[touched])
                gW += dW * dW
                self.W -= s.rate * dW / np.sqrt(gW)
                gb += db * db
                self.b -= s.rate * db / np.sqrt(gb)
        # The logit at which documents are told apart best, by the windows that they are scored by.
        word, constant = self.logits(sub_at, sub)
        best = np.concatenate([best_windows(word[flat[at[k] : at[min(k + 200, len(at) - 1)]]], at[k : k + 201] - at[k], s.window) for k in range(0, len(at) - 1, 200)]) + constant
        best[np.diff(at) == 0] = -np.inf
        toxic, clean = (np.sort(best[(y == k) & np.isfinite(best)]) for k in (1, 0))
        if len(toxic) and len(clean):
            cuts = np.linspace(clean[0], toxic[-1], 2000)
            wrong = np.searchsorted(toxic, cuts) / len(toxic) + 1 - np.searchsorted(clean, cuts) / len(clean)
            self.b[1] -= np.median(cuts[wrong <= wrong.min() + 1e-9])
        return self

    def linear(self) -> tuple[np.ndarray, float]:
        """Each bucket's share in the logit of toxic against clean, and the constant."""
        d = self.W[:, 1] - self.W[:, 0]
        return self.E @ d, float(self.b[1] - self.b[0])

    def logits(self, sub_at: np.ndarray, sub: np.ndarray) -> tuple[np.ndarray, float]:
        """Each word's share in a window's logit, and the constant."""
        share, constant = self.linear()
        return np.add.reduceat(share[sub], sub_at[:-1]) / np.diff(sub_at), constant

    def probability(self, flat: np.ndarray, first: np.ndarray, lens: np.ndarray, sub_at: np.ndarray, sub: np.ndarray) -> np.ndarray:
        word, constant = self.logits(sub_at, sub)
        sums = np.concatenate(([0], np.cumsum(word[flat])))
        return 1 / (1 + np.exp(-((sums[first + lens] - sums[first]) / np.maximum(1, lens) + constant)))


def train(df: DataFrame, labels: DataFrame, usable: Column | str, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from a bounded sample of labelled rows.  Without any, all scores are near one half."""
    docs = df.select(df[id_col].alias("id"), df[text_col].alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = [b" ".join(w) if 0 < len(w := words_of(t)) <= s.max_words else b"" for t in utf8(batch.column("text"))]
            kept = pa.array([0 < len(w) <= s.max_bytes for w in words], pa.bool_())
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "label": batch.column("label"), "words": pa.array(words, pa.binary())}).filter(kept)

    small_batches(df.sparkSession)
    sample = labelled_sample(docs, labels, label_col, usable, s.sample, s.seed, 1 / 3, label_id=id_col)
    rows = sample.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, label int, words binary").collect()
    rows.sort(key=lambda r: (r.id, bytes(r.words)))
    return Model(s).fit((bytes(r.words).split(b" ") for r in rows), np.array([r.label for r in rows], np.int64))


class _Logits(dict):
    def __init__(self, share: np.ndarray, s: Settings):
        self.share, self.s, self.extra = share, s, {}

    def __missing__(self, word: bytes) -> float:
        known = self.extra.get(word)
        if known is None:
            known = float(self.share[subwords(word, self.s)].mean())
            (self if len(self) < CACHED else self.extra)[word] = known
        return known


def scores(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id with its score, 0 to 1: that of its most toxic window.

    Null, empty and blank texts, and such without letters or digits, have one window without words, whose score is the
    model's constant.  Texts of any length are scored whole; repeated rows give a row each.
    """
    share, constant = model.linear()
    s = model.s
    sent = df.sparkSession.sparkContext.broadcast(share)  # s.buckets numbers

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logit = _Logits(sent.value, s)
        for batch in slices(batches):
            split = [words_of(t) for t in utf8(batch.column("text"))]
            at = bounds(map(len, split))
            value = np.fromiter((logit[w] for d in split for w in d), np.float64, at[-1])
            logit.extra.clear()
            best = best_windows(value, at, s.window)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "score": pa.array(1 / (1 + np.exp(-(best + constant))))})

    small_batches(df.sparkSession)
    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)
