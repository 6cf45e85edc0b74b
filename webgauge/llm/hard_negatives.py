"""Hard negatives by rotated one-bit codes.

Vectors are whole numbers, turned by a fixed rotation (sign changes and Hadamard transforms, so a few additions a number).  Of a turned vector
the index keeps the signs as bits, its length, and its alignment: the inner product of the unit vector with the unit vector of its signs.
For an anchor, whose turned components are rounded to a few bits, the inner product with the signs is a sum of popcounts.  The part of the vector
that its signs don't tell is orthogonal to them and of known length, so by Cauchy-Schwarz the true product lies in an interval around the
estimate, for sure.  Rows whose interval can't matter go; the others are scored in whole numbers.  So results are exact, not approximate.

Anchors are worked through in blocks of bounded bytes; each task scans its part of the index against a block and hands on its best few rows of
each anchor, so neither a frequent label nor many equal vectors gather anywhere.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch, small_batches

BLOCK_BYTES = 4 << 20
"""Of whole numbers of the anchors that are broadcast at a time."""
BITS = 6
"""Of an anchor's turned components."""
WIDE, TILE = 256, 1 << 19
"""Anchors, and pairs of rows and anchors, that a task looks at at a time."""
LARGEST = 2.0**62
"""Squared length of a vector from which inner products may not fit a long."""
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
INDEX = "id bigint, label bigint, v array<bigint>, code array<bigint>, norm double, align double"


@lru_cache(16)
def _signs(width: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, width]).choice([-1.0, 1.0], (3, width))


def rotate(v: np.ndarray, seed: int = 0) -> np.ndarray:
    """Rows turned by a fixed rotation, filled up with zeros to a power of two (64 at least): three rounds of sign changes and Hadamard transform."""
    n, d = v.shape
    width = max(64, 1 << max(0, d - 1).bit_length())
    out = np.zeros((n, width))
    out[:, :d] = v
    for signs in _signs(width, seed):
        out *= signs
        h = 1
        while h < width:
            pairs = out.reshape(n, width // (2 * h), 2, h)
            out = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), 2).reshape(n, width)
            h *= 2
        out /= np.sqrt(width)
    return out


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def codes(v: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of sign bits, length and alignment of each row; a zero vector lies along its signs, with length 0."""
    turned = rotate(v, seed)
    norm = np.sqrt((v.astype(np.float64) ** 2).sum(1))
    along = np.abs(turned).sum(1) / np.sqrt(turned.shape[1])
    return packed(turned >= 0), norm, np.where(norm > 0, np.minimum(1, along / np.where(norm > 0, norm, 1)), 1.0)


class Queries:
    """Anchors of one length of vector: their components rounded to BITS bits as planes of bits, and how much the rounding leaves out."""

    def __init__(self, v: np.ndarray, seed: int = 0):
        turned = rotate(v, seed)
        self.width = turned.shape[1]
        top = np.abs(turned).max(1, keepdims=True)
        step = np.where(top > 0, 2 * top / ((1 << BITS) - 1), 1.0)
        grid = np.rint((turned + top) / step).astype(np.int64)
        near = grid * step - top
        self.planes = [packed((grid >> k & 1).astype(bool)) for k in range(BITS)]
        self.step, self.low, self.sum = step[:, 0], -top[:, 0], near.sum(1)
        self.square, self.rest = (near**2).sum(1), np.sqrt(((turned - near) ** 2).sum(1))
        self.norm = np.sqrt((v.astype(np.float64) ** 2).sum(1))

    def interval(self, code: np.ndarray, norm: np.ndarray, align: np.ndarray, part: slice) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the inner products of rows with the anchors of a part."""
        ones = np.bitwise_count(code).sum(1, dtype=np.int64)
        n, m = len(code), len(self.step[part])
        weighted = np.zeros((n, m), np.int32)
        for k, plane in enumerate(self.planes):
            for w in range(code.shape[1]):
                weighted += np.bitwise_count(code[:, w, None] & plane[part][None, :, w]).astype(np.int32) << k
        along = (2 * (self.low[part] * ones[:, None] + self.step[part] * weighted) - self.sum[part]) / np.sqrt(self.width)
        across = np.sqrt(np.maximum(0, self.square[part] - along**2) * np.maximum(0, 1 - align**2)[:, None])
        mid, wide = align[:, None] * along, across + self.rest[part]
        # What doubles may lose, and more.
        slack = 1e-9 * norm[:, None] * self.norm[part] + 1e-6
        return norm[:, None] * (mid - wide) - slack, norm[:, None] * (mid + wide) + slack


def _first(anchor: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which rows are an anchor's first k: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, anchor))
    anchor = anchor[order]
    start = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1]))) if len(anchor) else np.zeros(0, np.int64)
    nth = np.arange(len(anchor)) - np.repeat(start, np.diff(np.concatenate((start, [len(anchor)]))))
    return order[nth < k]


class Best:
    """The first k rows of each of n lists so far."""

    def __init__(self, n: int, k: int):
        self.k, self.list, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.full(n, -np.inf)

    def add(self, which: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(which):
            return
        which, score, ids = np.concatenate((self.list, which)), np.concatenate((self.score, score)), np.concatenate((self.id, ids))
        keep = _first(which, score, ids, self.k)
        self.list, self.score, self.id = which[keep], score[keep], ids[keep]
        full = np.flatnonzero(np.bincount(self.list, minlength=len(self.least)) == self.k)
        last = np.searchsorted(self.list, full, "right") - 1
        self.least[full] = self.score[last]


def _matrix(column: pa.Array, dims: np.ndarray, dim: int) -> np.ndarray:
    """Rows of one length of a list column."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(dims)
    at = np.flatnonzero(dims == dim)
    return values[(ends[at] - dim)[:, None] + np.arange(dim)]


def _by_length(columns: dict[str, pa.Array]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """The rows of each length of vector, as arrays."""
    dims = columns["v"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    words = columns["code"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if "code" in columns else None
    for dim in np.unique(dims):
        at = dims == dim
        out = {name: c.to_numpy(zero_copy_only=False)[at] for name, c in columns.items() if name not in ("v", "code")}
        out["v"] = _matrix(columns["v"], dims, dim)
        if words is not None:
            n = int(words[at][0])
            ends = np.cumsum(words)
            out["code"] = columns["code"].flatten().to_numpy(zero_copy_only=False)[(ends[at] - n)[:, None] + np.arange(n)].view(np.uint64)
        yield int(dim), out


def index(vectors: DataFrame, scale: float = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", seed: int = 0) -> DataFrame:
    """(id, label, v, code, norm, align) of each row that takes part: v is floor(scale * x), x as double."""
    small_batches(vectors.sparkSession)
    x = F.col("x")
    fine = F.forall("x", lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)))
    rows = vectors.select(vectors[id_col].cast("bigint").alias("id"), vectors[label_col].cast("bigint").alias("label"), vectors[vector_col].cast("array<double>").alias("x")).where(F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & fine)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, rows in _by_length({"id": batch.column("id"), "label": batch.column("label"), "v": batch.column("x")}):
                with np.errstate(over="ignore"):
                    scaled = np.floor(scale * rows["v"])
                    fits = (scaled**2).sum(1) < LARGEST
                v = scaled[fits].astype(np.int64)
                code, norm, align = codes(v, seed)
                lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.reshape(-1), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(rows["id"][fits], pa.int64()), pa.array(rows["label"][fits], pa.int64()), lists(v), lists(code.view(np.int64)), pa.array(norm), pa.array(align)], ["id", "label", "v", "code", "norm", "align"])

    return rows.mapInArrow(run, INDEX)


def _scan(index_: DataFrame, anchors: dict[int, dict[str, np.ndarray]], same: bool, lists: dict[int, tuple[np.ndarray, ...]], k: int, seed: int) -> DataFrame:
    """(n, list, id, score): of each part of the index the first k rows of each list of the anchors: those of the anchor's own label or of others,
    with scores within the list's bounds.  lists: for each length the lowest and highest score and the name of each anchor's lists."""
    sent = index_.sparkSession.sparkContext.broadcast((anchors, lists))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, lists = sent.value
        queries = {d: Queries(a["v"], seed) for d, a in anchors.items()}
        best = {d: [Best(low[j : j + WIDE].size, k) for j in range(0, len(low), WIDE)] for d, (low, *_) in lists.items()}
        for batch in batches:
            for dim, rows in _by_length({name: batch.column(name) for name in batch.schema.names}):
                for part, found in enumerate(best.get(dim, ())):
                    _look(rows, anchors[dim], queries[dim], lists[dim], slice(part * WIDE, (part + 1) * WIDE), found, same)
        for dim, parts in best.items():
            names = lists[dim][2]
            for part, found in enumerate(parts):
                at = found.list + part * WIDE * names.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (anchors[dim]["n"][at // names.shape[1]], names.reshape(-1)[at], found.id, found.score)], ["n", "list", "id", "score"])

    return index_.mapInArrow(run, "n bigint, list bigint, id bigint, score bigint")


def _look(rows: dict[str, np.ndarray], anchors: dict[str, np.ndarray], queries: Queries, lists: tuple[np.ndarray, ...], part: slice, best: Best, same: bool) -> None:
    """Scores what the intervals leave of rows against a part of the anchors, and keeps the first of each list."""
    low, high, labels, v = lists[0][part], lists[1][part], anchors["label"][part], anchors["v"][part]
    m, per = low.shape
    tall = max(1, TILE // m)
    for i in range(0, len(rows["id"]), tall):
        cut = slice(i, i + tall)
        least, most = queries.interval(rows["code"][cut], rows["norm"][cut], rows["align"][cut], part)
        meet = (rows["label"][cut, None] == labels) == same
        known = best.least.reshape(m, per)
        if same:
            meet &= rows["id"][cut, None] != anchors["id"][part]
            if len(least) > best.k and not np.isfinite(known).all():
                # k rows surely reach the k-th highest lower bound.
                known = np.maximum(known, np.partition(np.where(meet, least, -np.inf), len(least) - best.k, 0)[-best.k][:, None])
        may = np.zeros_like(meet)
        for t in range(per):
            may |= (most >= np.maximum(low[:, t], known[:, t])) & (least <= high[:, t])
        a, b = np.nonzero(meet & may)
        score = np.einsum("ij,ij->i", rows["v"][a + i], v[b])
        fit = [(score >= low[b, t]) & (score <= high[b, t]) for t in range(per)]
        best.add(np.concatenate([b[f] * per + t for t, f in enumerate(fit)]), np.concatenate([score[f] for f in fit]), np.concatenate([rows["id"][a[f] + i] for f in fit]))


def _top(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    return rows.withColumn("rank", nth).where(F.col("rank") <= k)


def _blocks(anchors: DataFrame, size: int) -> list[tuple[int, int]]:
    """Ranges of n with about `size` anchors each.  n counts up within a partition of the table that was written, so a row for each partition
    comes to the driver."""
    parts = anchors.groupBy(F.shiftright("n", 33).alias("part")).agg(F.min("n").alias("first"), F.max("n").alias("last")).orderBy("first").collect()
    cuts, room = [], 0
    for p in parts:
        at = p["first"]
        while at <= p["last"]:
            if not room:
                cuts.append(at)
                room = size
            taken = min(room, p["last"] - at + 1)
            at, room = at + taken, room - taken
    return list(zip(cuts, [*cuts[1:], 1 << 62]))


def mine(vectors: DataFrame, anchors: Column | str, positives: int = 5, negatives: int = 5, band: tuple[int, int] = (80, 100), scale: float = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", seed: int = 0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its first `positives` other rows of its label
    the first `negatives` rows of other labels whose score is band[0] to band[1] hundredths of the positive's.

    A score is the inner product of floor(scale * x) in whole numbers; higher ones come first, then smaller ids.  anchors: a condition on
    `id` and `label`.  Rows with a null id or label, a null vector or any null or non-finite component take no part, nor do vectors beyond a
    length of 2^31 in whole numbers, whose scores may not fit a long.  Vectors meet those of their own length only; empty ones score 0.
    Anchors that repeat with all their values are one; rows that share an id are rows of their own, but an anchor's own id is no other row.
    An empty table, or one without anchors, gives no rows.  Other columns aren't read.
    """
    spark, results = vectors.sparkSession, []
    with scratch(spark):
        rows = materialize(index(vectors, scale, id_col, vector_col, label_col, seed))
        asked = materialize(rows.where(anchors).groupBy("id", "label", "v").agg(F.first("norm").alias("norm")).withColumn("n", F.monotonically_increasing_id()))
        longest = asked.agg(F.max(F.size("v"))).first()[0] or 1
        for first, last in _blocks(asked, max(1, BLOCK_BYTES // (8 * longest))):
            table = asked.where(F.col("n").between(first, last - 1)).select("n", "id", "label", "v").toArrow().combine_chunks()
            block = dict(_by_length({c: table.column(c).combine_chunks() for c in table.column_names}))
            any_ = {d: tuple(np.full((len(a["n"]), 1), x) for x in (LOWEST, HIGHEST, 0)) for d, a in block.items()}
            results.append(materialize(_negatives(rows, block, _positives(rows, block, any_, positives, seed), negatives, band, seed), keep=True))
        out = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
        return reduce(DataFrame.unionByName, results) if results else spark.createDataFrame([], out)


def _positives(rows: DataFrame, block: dict, any_: dict, k: int, seed: int) -> DataFrame:
    found = _scan(rows, block, True, any_, k, seed)
    return materialize(_top(found, ["n"], k).select("n", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))


def _negatives(rows: DataFrame, block: dict, found: DataFrame, k: int, band: tuple[int, int], seed: int) -> DataFrame:
    scores = found.select("n", "positive_score").distinct().toArrow()  # a few of each anchor of a block
    n, score = scores.column("n").to_numpy(), scores.column("positive_score").to_numpy()
    lists = {}
    for dim, a in block.items():
        order = np.argsort(a["n"])
        mine_ = np.isin(n, a["n"])
        at, own = order[np.searchsorted(a["n"][order], n[mine_])], score[mine_]
        by = np.lexsort((own, at))
        at, own = at[by], own[by]
        start = np.searchsorted(at, np.arange(len(a["n"])))
        per = int(max(1, np.bincount(at, minlength=1).max())) if len(at) else 1
        low, high, name = (np.full((len(a["n"]), per), x) for x in (HIGHEST, LOWEST, 0))
        nth = np.arange(len(at)) - start[at]
        low[at, nth], high[at, nth], name[at, nth] = [-(-band[0] * int(s) // 100) for s in own], [band[1] * int(s) // 100 for s in own], own
        lists[dim] = low, high, name
    best = _top(_scan(rows, block, False, lists, k, seed), ["n", "list"], k)
    ids = rows.sparkSession.createDataFrame(pa.table({"n": np.concatenate([a["n"] for a in block.values()]), "anchor_id": np.concatenate([a["id"] for a in block.values()])}))
    # The ids are those of a block, which BLOCK_BYTES bounds.
    asked = found.join(F.broadcast(ids), "n").withColumn("list", F.col("positive_score"))
    return asked.join(best.hint("shuffle_merge"), ["n", "list"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
