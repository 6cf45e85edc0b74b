"""Nearest earlier neighbour by Hamming distance within tasks.

Hashes that differ in at most five bits share one of four 16-bit bands.  What shares a band makes a bucket, and a bucket's hashes are compared within a
task, by counting the bits of their differences many at a time; only a row's best partner leaves the task.  A bucket with many hashes is taken apart twice:
by the equal byte that five differing bits leave beyond the band, and, where that isn't enough, into blocks by a hash, of which each pair is one
unit of work.  So no task gets more than two blocks of a bucket, and a bucket of n hashes gives rows in proportion to n and its blocks, never one for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize

UNIT = 40_000
"""Rows that a task gets at a time, about."""
PAIRS = 1 << 21
"""Differences that are counted at a time."""
FAR = np.iinfo(np.int64).max
FOUND = "host string, seq bigint, distance int, other bigint"


def _bits(at: int, mask: int) -> Column:
    return F.shiftrightunsigned("simhash", at).bitwiseAND(F.lit(mask).cast("bigint"))


def _nearest(hashes: np.ndarray, cross: np.ndarray | None, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of hashes in the order of their rows: which have an earlier one within the distance, how near it is, and which it is: the first of the nearest.
    cross: the block of each; only those of another block are partners then."""
    n = len(hashes)
    tall = max(1, PAIRS // n)
    which, near, at = [], [], []
    for i in range(0, n, tall):
        rows = np.arange(i, min(n, i + tall))
        apart = np.bitwise_count(hashes[rows, None] ^ hashes[None, : rows[-1] + 1]).astype(np.int64)
        fit = (apart <= distance) & (np.arange(rows[-1] + 1) < rows[:, None])
        if cross is not None:
            fit &= cross[rows, None] != cross[None, : rows[-1] + 1]
        best = np.where(fit, apart * n + np.arange(rows[-1] + 1), FAR).min(1)
        hit = best < FAR
        which.append(rows[hit])
        near.append(best[hit] // n)
        at.append(best[hit] % n)
    return tuple(np.concatenate(x) for x in (which, near, at))


def _compare(rows: pa.Table, distance: int) -> Iterator[pa.RecordBatch]:
    """The best partner of each row of a group of units: runs of one host, key and pair of blocks."""
    hosts = pc.dictionary_encode(rows.column("host").combine_chunks(), null_encoding="encode")
    columns = [hosts.indices.to_numpy(zero_copy_only=False), *(rows.column(c).to_numpy() for c in ("at", "part", "low", "high", "seq"))]
    order = np.lexsort(columns[::-1])
    key = [c[order] for c in columns[:-1]]
    seq, hashes, block = columns[-1][order], rows.column("simhash").to_numpy()[order].view(np.uint64), rows.column("block").to_numpy()[order]
    start = np.flatnonzero(np.concatenate(([True], np.any([c[1:] != c[:-1] for c in key], 0)))) if len(order) else np.zeros(0, np.int64)
    ends = np.append(start[1:], len(order))
    which, near, other = [], [], []
    for i, j in zip(start[ends - start > 1], ends[ends - start > 1]):
        w, d, o = _nearest(hashes[i:j], block[i:j] if key[3][i] != key[4][i] else None, distance)
        which.append(w + i)
        near.append(d)
        other.append(seq[o + i])
    if which:
        at = np.concatenate(which)
        yield pa.RecordBatch.from_arrays([rows.column("host").combine_chunks().take(pa.array(order[at])), pa.array(seq[at]), pa.array(np.concatenate(near).astype(np.int32)), pa.array(np.concatenate(other))], ["host", "seq", "distance", "other"])


def near_pairs(hashes: DataFrame, distance: int = 5, block: int = 4096) -> DataFrame:
    """(host, seq, other, distance): for each row of hashes(host, seq, simhash) the nearest earlier row of its host that shares one of four 16-bit bands, within
    `distance` bits (five at most); the first of several.

    Rows of one hash make a class: all but its first are nearest to that one, at distance 0, so only classes meet.  Rows with a null hash or seq have no
    partner, nor are they one; null hosts make one of their own; repeated rows with one seq are one.  An empty table gives no rows.
    """
    if not 0 <= distance <= 5:
        raise ValueError("five differing bits at most leave a byte beyond the band equal")
    hashes = materialize(hashes.select("host", "seq", "simhash").where("seq is not null and simhash is not null"))
    classes = materialize(hashes.groupBy("host", "simhash").agg(F.min("seq").alias("seq")))
    bands = classes.select("host", "seq", "simhash", F.posexplode(F.array(*(_bits(16 * k, 0xFFFF) for k in range(4)))).alias("at", "part"))
    full = bands.groupBy("host", "at", "part").agg(F.count("*").alias("n")).where(F.col("n") > block).withColumn("large", F.lit(True))
    full = materialize(full.drop("n"))
    same = lambda a, b: a["host"].eqNullSafe(b["host"]) & (a["at"] == b["at"]) & (a["part"] == b["part"])
    none = F.lit(0)
    plain = bands.join(full.hint("shuffle_merge"), same(bands, full), "left_anti").select("host", "seq", "simhash", "at", F.col("part").cast("bigint").alias("part"), none.alias("block"), none.alias("low"), none.alias("high"))
    units = plain
    if full.head(1):
        byte = F.array(*(F.struct(F.lit(b).alias("b"), _bits(8 * b, 0xFF).alias("v")) for b in range(8)))
        rows = bands.join(full.hint("shuffle_merge"), same(bands, full), "left_semi").select("host", "seq", "simhash", "at", "part", F.explode(F.filter(byte, lambda x: F.floor(x["b"] / 2) != F.col("at"))).alias("x"))
        rows = materialize(rows.select("host", "seq", "simhash", (4 + 8 * F.col("at") + F.col("x.b")).alias("at"), (F.col("part") * 256 + F.col("x.v")).alias("part")))
        sizes = materialize(rows.groupBy("host", "at", "part").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
        cut = rows.join(sizes.hint("shuffle_merge"), same(rows, sizes)).select(rows["host"], "seq", "simhash", rows["at"], rows["part"], "blocks", F.pmod(F.xxhash64("simhash"), F.col("blocks")).cast("int").alias("block"))
        met = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("to"))
        units = plain.unionByName(met.select("host", "seq", "simhash", "at", "part", "block", F.least("block", "to").alias("low"), F.greatest("block", "to").alias("high")))
    total = 4 * classes.count()
    shared = F.pmod(F.xxhash64("host", "at", "part", "low", "high"), F.lit(max(1, total // UNIT)))
    # The rows of large buckets don't crowd the groups of the others: each pair of blocks is a group.
    unit = F.when(F.col("at") < 4, shared).otherwise(F.xxhash64("host", "at", "part", "low", "high"))

    found = units.withColumn("large", F.col("at") >= 4).withColumn("unit", unit).groupBy("large", "unit").applyInArrow(lambda t: _table(_compare(t, distance)), FOUND)
    best = found.groupBy("host", "seq").agg(F.min(F.struct("distance", "other")).alias("best")).select("host", "seq", "best.other", "best.distance")
    firsts = classes.withColumnRenamed("seq", "other")
    copies = hashes.join(firsts.hint("shuffle_merge"), hashes["host"].eqNullSafe(firsts["host"]) & (hashes["simhash"] == firsts["simhash"])).where("other < seq").select(hashes["host"], "seq", "other", F.lit(0).alias("distance"))
    return best.unionByName(copies.distinct())


def _table(batches: Iterator[pa.RecordBatch]) -> pa.Table:
    schema = pa.schema([("host", pa.string()), ("seq", pa.int64()), ("distance", pa.int32()), ("other", pa.int64())])
    return pa.Table.from_batches([b.cast(schema) for b in batches], schema)
