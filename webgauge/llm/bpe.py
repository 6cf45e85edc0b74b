"""BPE encoding and decoding.

The encoder walks each pre-token from left to right and always tries the longest vocabulary token first
(all tokens that occur are found by one Aho-Corasick pass).  A token may follow the last one only if the pair
is compatible: merging both tokens' bytes by rank would give back exactly these two.  On a dead end it steps
back.  Dead ends are remembered by position, so the time is linear in the pre-token's length; the result is the
one of the usual merge-by-rank procedure.  Decoding gathers bytes through an offset table.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import bounds, carried, csr_take, inputs, opened, outputs, places, slices

#: The pre-token pattern of byte-level vocabularies.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pairs of separators, all white space that is neither space nor line feed, and the mark of the cuts.
UNEVEN = ["  ", " \n", "\n ", "\n\n", "\0", *"\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B))]
CACHED = 500_000
"""Chunks of text that a worker remembers, about 150 MB; further ones are encoded again for each slice."""
PIECE_BYTES = 1 << 20
"""Text that is encoded at a time: gathering digits and bytes takes some 50 times its size."""


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Bpe:
    """A byte-level BPE vocabulary file with its encoder and decoder."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        tokens: list[bytes] = [b""] * size
        for text, i in vocab.items():
            if text not in self.special:
                tokens[i] = bytes(letters[c] for c in text)
        ids = {t: i for i, t in enumerate(tokens) if t}
        for text, i in self.special.items():
            tokens[i] = text.encode()
        self.tokens, self.size = tokens, size
        # Rank of the merge that makes a token, and the two parts it is made of; single bytes come first.
        self.rank = [-1] * size
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.merged: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, both = vocab[a], vocab[b], vocab[a + b]
            self.merged[left, right] = rank
            if self.parts[both] is None:
                self.parts[both], self.rank[both] = (left, right), rank
        # The longest other token that starts a token.
        self.shorter = [next((ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in ids), -1) for t in tokens]
        self.length = list(map(len, tokens))
        self.longest = max(self.length)
        self.automaton = ahocorasick.Automaton()
        for t, i in ids.items():
            if self.rank[i] >= 0 or len(t) == 1:
                self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.known: dict[int, bool] = {}
        self.split = regex.compile(PRE_TOKEN).findall
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.byte_offsets = bounds(map(len, tokens))
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        decimals = [b"%d," % i for i in range(size)]
        self.decimal_offsets = bounds(map(len, decimals))
        self.decimals = np.frombuffer(b"".join(decimals), np.uint8)
        self.words = _Words(self)

    def compatible(self, left: int, right: int) -> bool:
        key = left * self.size + right
        known = self.known.get(key)
        if known is None:
            if len(self.known) > CACHED:
                self.known.clear()
            known = self.known[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens leaves them as these two: no merge across the border comes
        before the merges that build the tokens' edges.  Walks both edges from the last merge to the first."""
        before = len(self.merged)
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < before:
                return False
            # Undo the later of the two merges that made the tokens at the border.  Of equal ones the left comes first in
            # the text and so first in the merging, so the right one is undone first.
            if self.rank[left] > self.rank[right]:
                before, left = self.rank[left], self.parts[left][1]
            elif self.rank[right] >= 0:
                # A pair of this same rank across the border lies further left: it would have been merged before.
                before, right = self.rank[right] + 1, self.parts[right][0]
            else:
                return True

    def encode_word(self, word: str) -> list[int]:
        """word: the bytes of a pre-token, as Latin-1 letters.  The walk without a step back comes first."""
        out = [i for _, i in self.automaton.iter_long(word)]
        if all(map(self.compatible, out, out[1:])):
            return out
        length, shorter, compatible, longest, most = self.length, self.shorter, self.compatible, self.automaton.iter_long, self.longest
        out, at, token, n, dead = [], 0, out[0], len(word), set()
        while at < n:
            while token >= 0 and (at + length[token] in dead or out and not compatible(out[-1], token)):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                if at < n:
                    token = next(longest(word[at : at + most]))[1]  # no more of the word than a token may hold
            else:
                dead.add(at)
                last = out.pop()
                at -= length[last]
                token = shorter[last]
        return out

    def _chunks(self, text: str) -> list[str]:
        """Cut a text where pre-tokens end for sure, so that a chunk can be remembered as a whole: before a space
        and around a line feed, where nothing but single ones of these stand between words."""
        if any(x in text for x in UNEVEN):
            return self.split(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def _pre_tokens(self, text: str) -> list:
        if not any(x in text for x in self.special):
            return self._chunks(text)
        return [w for k, part in enumerate(self.at_special.split(text)) for w in ((self.special[part],) if k % 2 else self._chunks(part))]

    def encode_batch(self, texts: list[str], special: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and the offsets of each.  special: the strings of special tokens become
        these tokens, as the tokenizers library does; else they are ordinary text."""
        pre = [(self._pre_tokens if special else self._chunks)(t) for t in texts]
        at = np.fromiter(map(self.words.__getitem__, chain.from_iterable(pre)), np.int64, sum(map(len, pre)))
        ids, lens = csr_take(np.concatenate(([0], np.cumsum(self.words.lens))), np.frombuffer(self.words.ids, np.int32), at)
        self.words.trim()
        ends = np.concatenate(([0], np.cumsum(lens)))
        return ids, ends[bounds(map(len, pre))]

    def forget(self) -> None:
        """Drop all that is remembered of texts; the vocabulary stays."""
        self.words, self.known = _Words(self), {}

    def decode(self, ids: np.ndarray) -> bytes:
        return csr_take(self.byte_offsets, self.bytes, ids)[0].tobytes()


class _Words(dict):
    """A chunk of text (or a special id) to its number; the ids of all chunks lie end to end.  Once full, it keeps
    what it has and remembers further chunks only until trim()."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.lens, self.ids, self.extra, self.single = bpe, array("q"), array("i"), {}, {}

    def __missing__(self, word):
        if word in self.extra:
            return self.extra[word]
        if isinstance(word, int):
            ids = [word]
        else:
            ids = []
            for w in self.bpe.split(word):
                own = self.single.get(w)
                if own is None:
                    own = self.bpe.encode_word(w.encode().decode("latin-1"))
                    if w != word and len(self.single) < CACHED:  # a chunk of one pre-token is remembered as a chunk
                        self.single[w] = array("H" if self.bpe.size < 1 << 16 else "i", own)
                ids.extend(own)
        n = len(self.lens)
        self.lens.append(len(ids))
        self.ids.extend(ids)
        (self if len(self) < CACHED else self.extra)[word] = n
        return n

    def trim(self) -> None:
        if self.extra:
            self.extra = {}
            self.ids = self.ids[: sum(self.lens[: len(self)])]
            self.lens = self.lens[: len(self)]


@lru_cache(2)
def load(path: str) -> Bpe:
    """One for each worker process, which Spark uses again for later tasks."""
    return Bpe(path)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, carry: bool = False) -> DataFrame:
    """Each row's id with `ids` array<int>, `decoded` string and the digests of both.

    Null and empty texts give no ids and the empty text; repeated rows give a row each; a text of any length is
    encoded whole; the strings of special tokens in a text become their ids.  carry adds `row`, all columns of df.
    """
    return _run(df, id_col, text_col, vocabulary, carry, True)


def encode_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, carry: bool = False) -> DataFrame:
    """As encode, with the number of ids and the SHA-256 digests only."""
    return _run(df, id_col, text_col, vocabulary, carry, False)


def _run(df: DataFrame, id_col: str, text_col: str, vocabulary: str | None, carry: bool, whole: bool) -> DataFrame:
    path, docs, where = vocabulary or default_vocabulary(), inputs(df, id_col, text_col, carry), places(df, id_col, text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in slices(opened(batches, where), limit=PIECE_BYTES, forget=bpe.forget):
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            ids, at = bpe.encode_batch(texts)
            digits, lens = csr_take(bpe.decimal_offsets, bpe.decimals, ids)
            digit_at = np.concatenate(([0], np.cumsum(lens)))[at]
            plain, lens = csr_take(bpe.byte_offsets, bpe.bytes, ids)
            plain_at = np.concatenate(([0], np.cumsum(lens)))[at]
            digits, plain = digits.tobytes(), plain.tobytes()
            decoded = [plain[a:b] for a, b in zip(plain_at, plain_at[1:])]
            out = {
                "id": batch.column("id"),
                "n_tokens": pa.array(np.diff(at), pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(digits[a : max(a, b - 1)]).hexdigest() for a, b in zip(digit_at, digit_at[1:])]),
                "decoded_sha256": pa.array([hashlib.sha256(d).hexdigest() for d in decoded]),
            }
            if whole:
                out["ids"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                out["decoded"] = pa.array([d.decode("utf-8", "replace") for d in decoded])
            yield pa.RecordBatch.from_pydict(out | carried(batch))

    ddl = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * whole
    return docs.mapInArrow(run, outputs(docs, df.schema[id_col].dataType, ddl)).withColumnRenamed("id", id_col)
