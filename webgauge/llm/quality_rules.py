"""Quality rules by distribution divergence.

Two histograms describe a text: the bytes of its words by character class, and its words among the most common
words of each language.  A text is compared with the references of all languages, counted over the whole corpus, by
Jensen-Shannon distance (base 2, 0 to 1) and goes if even the nearest reference is too far.  A histogram of a few
words says little, so each comparison has a least length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Numbered, bounds, carried, inputs, materialize, number, opened, outputs, places, scratch, slices, small_batches, utf8

#: The classes of a word's bytes.  Bytes of two or more for a letter count as one class.
CLASSES = ["lower", "upper", "digit", "stop", "mark", "symbol", "wide"]
CLASS_OF = np.full(256, CLASSES.index("mark"), np.int64)
for _name, _bytes in {"lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "stop": b".,;:'\"-()?", "symbol": b"#*$%&|<>", "wide": range(128, 256)}.items():
    CLASS_OF[list(_bytes)] = CLASSES.index(_name)
SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    common_words: int = 64
    """Reference words of a language."""
    common_bytes: int | None = None
    """Reference words have so many bytes at most.  None: words of any length."""
    min_reference_words: int = 1
    """A language of fewer words in all has no part in the word distance."""
    max_class_distance: float = 0.30
    min_class_bytes: int = 200
    max_word_distance: float = 0.36
    min_word_words: int = 200


def references(df: DataFrame, rules: Rules = Rules(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, kind, key, n): bytes by class (kind c) and the most common words (kind w, the rest under the empty key)
    of each language, counted over all rows; rows without a language count for none."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, tuple[Counter, np.ndarray]] = {}

        def hand_on() -> Iterator[pa.RecordBatch]:
            for lang, (words, classes) in found.items():
                short = {w: n for w, n in words.items() if rules.common_bytes is None or len(w) <= rules.common_bytes}
                short[b""] = sum(words.values()) - sum(short.values())
                keys = [*CLASSES, *map(key_of, short)]
                n = [*classes.tolist(), *short.values()]
                for k in range(0, len(n), 20_000):
                    part = slice(k, k + 20_000)
                    kinds = ["c" if i < len(CLASSES) else "w" for i in range(len(n))[part]]
                    yield pa.RecordBatch.from_pydict({"lang": [lang] * len(kinds), "kind": kinds, "key": keys[part], "n": pa.array(n[part], pa.int64())})

        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), utf8(batch.column("text"))):
                words, classes = found.setdefault(lang, (Counter(), np.zeros(len(CLASSES), np.int64)))
                words.update(text.lower().split())
                used = np.frombuffer(text, np.uint8)
                classes += np.bincount(CLASS_OF[used[~SPACE[used]]], minlength=len(CLASSES))
            if sum(len(words) for words, _ in found.values()) > HELD:
                yield from hand_on()
                found.clear()
        yield from hand_on()

    small_batches(df.sparkSession)
    docs = df.select(df[lang_col].alias("lang"), df[text_col].alias("text")).where("lang is not null")
    counts = materialize(docs.mapInArrow(count, "lang string, kind string, key string, n bigint").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")))
    nth = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key"))
    top = counts.where("key <> ''").withColumn("nth", nth).where(F.col("nth") <= rules.common_words).drop("nth")
    total = counts.groupBy("lang", "kind").agg(F.sum("n").alias("n"), F.lit("").alias("key"))
    return top.unionByName(total)


HELD = 300_000
"""Words whose counts a task holds before it hands them on."""


def key_of(word: bytes) -> str:
    """Long words go by their beginning and a digest, which sorts as the word does."""
    return word.decode("utf-8", "replace") if len(word) <= 200 else word[:120].decode("utf-8", "replace") + sha256(word).hexdigest()


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of p to each row of q."""
    p, q = p[:, None, :], q[None, :, :]
    m = (p + q) / 2

    def kl(a: np.ndarray) -> np.ndarray:
        return np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(m > 0, m, 1)), 0).sum(2)

    return np.sqrt(np.clip((kl(p) + kl(q)) / 2, 0, 1))


def repeated(words: np.ndarray, size: int) -> int:
    """Words in 3-word windows that occur twice or more; words are numbers below size."""
    if len(words) < 4:
        return 0
    pairs = np.unique(words[:-1] * size + words[1:], return_inverse=True)[1]
    _, at, n = np.unique(pairs[:-1] * size + words[2:], return_inverse=True, return_counts=True)
    twice = n[at] > 1
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k : k + len(twice)] |= twice
    return int(hit.sum())


def apply_rules(df: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", against: DataFrame | None = None, carry: bool = False) -> DataFrame:
    """The figures and the verdict of each row.

    Null, empty and blank texts have no words and fail.  A language of fewer rows makes a reference as well; where
    there are no references (no row has a language), the base rules alone decide; a language whose reference words are too few of its
    words (its texts are empty, or written without spaces), so that a text without any of them would be near it, has no part in
    the word distance.  Repeated rows give a row each.
    `against` takes the references of another corpus.  carry adds `row`, all columns of df.
    """
    with scratch(df.sparkSession):
        rows = (references(df, rules, text_col, lang_col) if against is None else against).collect()  # common_words + 9 for each language
    langs = sorted({r.lang for r in rows})
    total = {(r.lang, r.kind): r.n for r in rows if r.key == ""}
    words = {w: i for i, w in enumerate(sorted({r.key for r in rows if r.kind == "w" and r.key}))}
    by_class, by_word = np.zeros((len(langs), len(CLASSES))), np.zeros((len(langs), len(words) + 1))
    for r in rows:
        k, n = langs.index(r.lang), r.n / max(1, total[r.lang, r.kind])
        if r.key:
            (by_class if r.kind == "c" else by_word)[k, CLASSES.index(r.key) if r.kind == "c" else words[r.key]] = n
    by_word[:, -1] = np.clip(1 - by_word[:, :-1].sum(1), 0, 1)
    enough = np.array([total.get((lang, "w"), 0) >= rules.min_reference_words for lang in langs], bool)
    # A language that a text without any reference word is near to can't tell texts apart.
    enough &= np.array([distances(np.array([[0.0, 1.0]]), np.array([[1 - h[-1], h[-1]]]))[0, 0] > rules.max_word_distance for h in by_word], bool)
    by_word = by_word[enough]
    own = [np.append(np.flatnonzero(h[:-1]), len(words)) for h in by_word]
    common = words

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(opened(batches, where)):
            texts = utf8(batch.column("text"))
            split = [t.split() for t in texts]
            ids = Numbered()
            flat = number([w for s in split for w in s], ids)
            known = np.fromiter((common.get(key_of(w.lower()), len(words)) for w in ids), np.int64, len(ids))
            at = bounds(map(len, split))
            out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance")}
            for k, text in enumerate(texts):
                used = np.frombuffer(text, np.uint8)
                used, n, mine = used[~SPACE[used]], len(split[k]), flat[at[k] : at[k + 1]]
                lines = [line for line in text.split(b"\n") if line.strip()]
                out["n_words"].append(n)
                out["word_chars"].append(int(((used & 0xC0) != 0x80).sum()))
                out["n_symbols"].append(int(SYMBOL[used].sum()))
                out["n_dup_lines"].append(len(lines) - len(set(lines)))
                out["n_repeat_words"].append(repeated(mine, len(ids)))
                judged = len(langs) > 0 and len(used) >= rules.min_class_bytes
                out["class_distance"].append(float(distances(np.bincount(CLASS_OF[used], minlength=len(CLASSES))[None] / len(used), by_class).min()) if judged else None)
                judged = len(by_word) > 0 and n >= rules.min_word_words
                if judged:
                    seen = np.bincount(known[mine], minlength=len(words) + 1) / n
                    near = []
                    for cols, ref in zip(own, by_word):
                        p = seen[cols]
                        p[-1] = 1 - p[:-1].sum()
                        near.append(float(distances(p[None], ref[cols][None])[0, 0]))
                out["word_distance"].append(min(near) if judged else None)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), **{k: pa.array(v, pa.float64() if "distance" in k else pa.int64()) for k, v in out.items()}, **carried(batch)})

    docs, where = inputs(df, id_col, text_col, carry), places(df, id_col, text_col)
    found = docs.mapInArrow(run, outputs(docs, df.schema[id_col].dataType, "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, class_distance double, word_distance double"))
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    near = (F.coalesce("class_distance", F.lit(0.0)) <= rules.max_class_distance) & (F.coalesce("word_distance", F.lit(0.0)) <= rules.max_word_distance)
    return found.withColumnRenamed("id", id_col).withColumn("base_failed", failed).withColumn("kept", ~failed & near)
