"""An n-gram trie in Elias-Fano form, kept in one run of mapped memory.

Above all levels are the words; a level has the nodes that follow the words, or the nodes of the level above.  The followers
of a context lie in one range of a level; ranges begin where monotone pointers say.  Followers rise within a range; each range
goes on above the last value of the range before, so a level is one monotone sequence, and a follower is found as the successor
of a value that is relative to its context.  Each node has one weight.
"""

from __future__ import annotations

import io
import json
import mmap

import numpy as np


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """width low bits of each value, end to end."""
    words = np.zeros((len(values) * width + 63) // 64 + 1, np.uint64)
    if width:
        bit = np.arange(len(values), dtype=np.int64) * width
        shift, at, v = (bit & 63).astype(np.uint64), bit >> 6, values.astype(np.uint64)
        np.bitwise_or.at(words, at, v << shift)
        over = shift > 64 - width
        np.bitwise_or.at(words, at[over] + 1, v[over] >> (np.uint64(64) - shift[over]))
    return words


#: For each byte and k, the place of its k-th one.
SELECT = np.array([([i for i in range(8) if b >> i & 1] + [8] * 8)[:8] for b in range(256)], np.int64)


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary."""

    @staticmethod
    def build(values: np.ndarray) -> dict[str, np.ndarray]:
        n, top = len(values), int(values[-1]) + 1 if len(values) else 1
        width = max(0, int(np.log2(top / n))) if n else 0
        values = values.astype(np.uint64)
        high = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(high[-1]) if n else 0) + 2, bool)
        bits[high] = True
        upper = np.packbits(bits, bitorder="little")
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(upper), dtype=np.int64)))
        return {"low": _pack(values & np.uint64((1 << width) - 1), width), "upper": upper, "ones": ones, "size": np.array([n, width, len(bits)], np.int64)}

    def __init__(self, parts: dict[str, np.ndarray]):
        self.low, self.upper, self.ones = parts["low"], parts["upper"], parts["ones"]
        self.n, self.width, self.n_bits = map(int, parts["size"])
        self.zeros = np.arange(len(self.ones)) * 8 - self.ones
        self._unpacked: dict[int, np.ndarray] = {}

    def _before(self, bit: int, asked: int) -> np.ndarray | None:
        """How many other bits are before each one (bit 1) or zero (bit 0) of the high bits.  These are unpacked once as many places are
        asked for at a time as one in eight of them; fewer look-ups go through the counts of bytes."""
        if bit not in self._unpacked and 8 * asked > self.n_bits:
            at = np.flatnonzero(np.unpackbits(self.upper, count=self.n_bits, bitorder="little") == bit)
            self._unpacked[bit] = at - np.arange(len(at))
        return self._unpacked.get(bit)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.int64)
        bit = i * self.width
        at, shift = bit >> 6, (bit & 63).astype(np.uint64)
        more = np.where(shift > 0, self.low[at + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return ((self.low[at] >> shift | more) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def at(self, i: np.ndarray) -> np.ndarray:
        if (high := self._before(1, len(i))) is not None:
            return (high[i] << self.width) | self._low(i)
        byte = np.searchsorted(self.ones, i, "right") - 1
        return (byte * 8 + SELECT[self.upper[byte], i - self.ones[byte]] - i << self.width) | self._low(i)

    def _first(self, high: np.ndarray) -> np.ndarray:
        """How many values have high bits below `high`."""
        if (before := self._before(0, len(high))) is not None:
            return np.where(high > 0, before[np.maximum(high - 1, 0)], 0)
        byte = np.searchsorted(self.zeros, high - 1, "right") - 1
        byte = np.minimum(byte, len(self.upper) - 1)
        place = byte * 8 + SELECT[255 - self.upper[byte], np.clip(high - 1 - self.zeros[byte], 0, 7)]
        return np.where(high > 0, np.minimum(place, self.n_bits) - high + 1, 0)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of the first value not below each given one."""
        return self.found(values)[0]

    def found(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Also whether that place holds the value itself."""
        high = values >> self.width
        top = (self.n_bits - self.n) if self.n else 0
        i, stop = (np.minimum(self._first(np.minimum(h, top)), self.n) for h in (high, high + 1))
        low = values & ((1 << self.width) - 1)
        end = stop.copy()
        live = np.flatnonzero(i < stop)
        while len(live):  # halves what is left of each range
            middle = i[live] + stop[live] >> 1
            before = self._low(middle) < low[live]
            i[live[before]] = middle[before] + 1
            stop[live[~before]] = middle[~before]
            live = live[i[live] < stop[live]]
        same = i < end
        same[same] = self._low(i[same]) == low[same]
        return i, same


def _ranges(context: np.ndarray, follower: np.ndarray, n_contexts: int) -> tuple[np.ndarray, np.ndarray]:
    """Pointers, and the sequence made monotone.  Rows are sorted by context and follower."""
    pointer = np.concatenate(([0], np.cumsum(np.bincount(context, minlength=n_contexts)))).astype(np.int64)
    last = pointer[1:] - 1
    width = np.where(pointer[1:] > pointer[:-1], follower[np.maximum(last, 0)] + 1 if len(follower) else 0, 0)
    return pointer, follower + (np.cumsum(width) - width)[context]


class Level:
    def __init__(self, parts: dict[str, np.ndarray], name: str):
        of = lambda kind: EliasFano({k.split("/")[2]: v for k, v in parts.items() if k.startswith(f"{name}/{kind}/")})
        self.pointer, self.sequence = of("pointer"), of("sequence")
        self.weights = parts[f"{name}/weights"]

    @staticmethod
    def build(name: str, context: np.ndarray, follower: np.ndarray, n_contexts: int, weights: np.ndarray) -> dict[str, np.ndarray]:
        pointer, sequence = _ranges(context, follower, n_contexts)
        parts = {f"{name}/weights": weights}
        for kind, values in (("pointer", pointer), ("sequence", sequence)):
            parts |= {f"{name}/{kind}/{k}": v for k, v in EliasFano.build(values).items()}
        return parts

    def range(self, context: np.ndarray) -> np.ndarray:
        return self.pointer.at(context)

    def find(self, context: np.ndarray, follower: np.ndarray) -> np.ndarray:
        """The place of each follower in its context's range, or -1; no context (-1) has followers."""
        out = np.full(len(context), -1, np.int64)
        some = np.flatnonzero((context >= 0) & (follower >= 0))
        if not len(some) or not self.sequence.n:
            return out
        # Each run of one context looks its range up once.
        head = np.flatnonzero(np.diff(context[some], prepend=-1))
        own, times = context[some[head]], np.diff(head, append=len(some))
        start, stop = self.range(own), self.range(own + 1)
        base = np.where(start > 0, self.sequence.at(np.maximum(start - 1, 0)) + 1, 0)
        last = np.where(start < stop, self.sequence.at(np.maximum(stop - 1, 0)), -1)
        wanted = np.repeat(base, times) + follower[some]
        inside = np.flatnonzero(wanted <= np.repeat(last, times))
        at, hit = self.sequence.found(wanted[inside])
        out[some[inside[hit]]] = at[hit]
        return out


class Trie:
    """Levels below the words: a node of a level is a context of the next one."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.levels = [Level(parts, name) for name in sorted({k.split("/")[0] for k in parts})]

    def find(self, word: np.ndarray, *path: np.ndarray) -> list[np.ndarray]:
        """The node of each path's every step, or -1."""
        out, node = [], word
        for level, follower in zip(self.levels, path):
            node = level.find(node, follower)
            out.append(node)
        return out


def build(n_words: int, *levels: tuple[np.ndarray, np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
    """levels: each node's context (a word, then a node of the level before), follower and weight, sorted by context and follower."""
    parts, above = {}, n_words
    for k, (context, follower, weight) in enumerate(levels):
        parts |= Level.build(str(k), context, follower, above, weight)
        above = len(context)
    return parts


def image(parts: dict[str, np.ndarray]) -> bytes:
    """All levels in one run of bytes."""
    head, body, at = {}, io.BytesIO(), 0
    for name, a in parts.items():
        a = np.ascontiguousarray(a)
        head[name] = (a.dtype.str, len(a), at)
        body.write(a.tobytes())
        pad = -a.nbytes % 8
        body.write(b"\0" * pad)
        at += a.nbytes + pad
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    return len(text).to_bytes(8, "little") + text + body.getbuffer()


def opened(data: bytes) -> Trie:
    """The trie of an image, in anonymous mapped memory: pages that are outside of Python's heap and go back whole."""
    pages = mmap.mmap(-1, len(data))
    pages.write(data)
    return view(np.frombuffer(pages, np.uint8))


def load(path: str) -> Trie:
    """The trie of an image in a file; all workers of an executor share the file's pages."""
    return view(np.memmap(path, np.uint8, "r"))


def view(whole: np.ndarray) -> Trie:
    n = int.from_bytes(whole[:8].tobytes(), "little")
    parts = {}
    for name, (kind, length, at) in json.loads(whole[8 : 8 + n].tobytes()).items():
        start = 8 + n + at
        parts[name] = whole[start : start + length * np.dtype(kind).itemsize].view(kind)
    return Trie(parts)
