"""MinHash near-duplicate detection with sequential Bayesian verification.

1. Each document's set of word shingles is hashed; documents with equal sets make one class.
2. A class has a MinHash signature, cut into bands.  Classes that share a band's value meet in a bucket.  A bucket's
   smallest and largest class are compared with all others in it, so work grows with the bucket, not with its
   square.  What is in different components after that and still shares a bucket is compared too, so nothing that
   the bands bring together is left out.
3. A pair's signatures are compared in batches.  After each, the posterior of the similarity given the matches so far
   (flat prior) decides: the pair goes if the chance that it reaches the threshold is below the miss probability.
4. Pairs that are left are verified on their full sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Numbered, bounds, materialize, number, scratch, slices, small_batches, utf8
from .components import components, relabel


@dataclass(frozen=True)
class Settings:
    words: int = 5
    """Words of a shingle."""
    percent: int = 80
    """Least similarity of a link, in percent."""
    rows: int = 7
    bands: int = 60
    """At a similarity of 0.8 a pair shares no band with probability (1 - 0.8**7)**60 < 8e-7; at 0.3 it shares one with 1.3 %."""
    batch: int = 42
    miss: float = 1e-9
    """Posterior chance of a link at which a pair is given up."""
    seed: int = 20240501
    whole: int = 2048
    """Sets of so many shingles go along where blocks of a group are compared; pairs of larger ones are verified one by one."""
    block: int = 512


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles.  Distinctness is decided on the words."""
    split = [t.lower().split() for t in texts]
    ids = Numbered()
    flat = number([w for s in split for w in s], ids)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, ids), np.uint64, len(ids))
    size, at = max(1, len(ids)), bounds(map(len, split))
    for a, b in zip(at, at[1:]):
        seq = flat[a:b]
        k = min(words, len(seq))
        if not k:
            yield np.zeros(0, np.uint64)
            continue
        n = len(seq) - k + 1
        key = seq[:n]
        for j in range(1, k):
            if j > 1:
                key = np.unique(key, return_inverse=True)[1]
            key = key * size + seq[j : j + n]
        first = np.unique(key, return_index=True)[1]
        h = np.full(len(first), k, np.uint64)
        for j in range(k):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + hashes[seq[first + j]])
        h.sort()
        yield h


@lru_cache(4)
def _permutations(s: Settings) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(s.seed)
    n = s.rows * s.bands
    return r.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1)


def signature(shingles: np.ndarray, s: Settings) -> np.ndarray:
    a, b = _permutations(s)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(shingles), 512):  # bounds the table's size
        part = shingles[k : k + 512]
        low, high = part.astype(np.uint32)[:, None], (part >> np.uint64(32)).astype(np.uint32)[:, None]
        np.minimum(out, (low * a + high * b).min(0), out=out)
    return out


def sketches(df: DataFrame, s: Settings) -> DataFrame:
    """(id, n_shingles, class, sketch) of each row of df(id, text).  class: digest of the whole set; sketch: low byte of each
    signature value.  Empty sets have no sketch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = list(shingle_sets(utf8(batch.column("text")), s.words))
            low = [signature(h, s).astype(np.uint8).tobytes() if len(h) else None for h in sets]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "n_shingles": pa.array(map(len, sets), pa.int64()), "class": pa.array(map(class_of, sets), pa.binary()), "sketch": pa.array(low, pa.binary())})

    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, n_shingles bigint, class binary, sketch binary")


def class_of(shingles: np.ndarray) -> bytes:
    return blake2b(shingles.tobytes(), digest_size=16).digest()


def buckets(s: Settings) -> Column:
    """A hash for each band of a sketch.  Unequal values have equal low bytes once in 256 times, so few more sketches meet."""
    return F.expr(f"transform(sequence(0, {s.bands - 1}), k -> xxhash64(k, substring(sketch, k * {s.rows} + 1, {s.rows})))")


@lru_cache(8)
def least_matches(s: Settings) -> np.ndarray:
    """By batch: the fewest matching values at which a pair stays.  Two values' low bytes also match by chance."""
    grid = (np.arange(20000) + 0.5) / 20000
    chance = grid + (1 - grid) / 256
    out = []
    for n in range(s.batch, s.rows * s.bands + 1, s.batch):
        m = np.arange(n + 1)[:, None]
        like = m * np.log(chance) + (n - m) * np.log1p(-chance)
        like = np.exp(like - like.max(1, keepdims=True))
        reach = like[:, grid >= s.percent / 100].sum(1) / like.sum(1)
        out.append(int(np.argmax(reach >= s.miss)))
    return np.array(out)


def plausible(pairs: DataFrame, s: Settings) -> DataFrame:
    """Pairs(a, b, sketch_a, sketch_b) that the sequential test leaves, with the number of `matches`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, width = least_matches(s), s.rows * s.bands
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(-1, width) for c in ("sketch_a", "sketch_b"))
                alive, matches = np.arange(len(x)), np.zeros(len(x), np.int64)
                for k, few in enumerate(least):
                    cols = slice(k * s.batch, (k + 1) * s.batch)
                    matches[alive] += (x[alive, cols] == y[alive, cols]).sum(1)
                    alive = alive[matches[alive] >= few]
                yield pa.RecordBatch.from_pydict({"a": part.column("a").take(pa.array(alive)), "b": part.column("b").take(pa.array(alive)), "matches": pa.array(matches[alive], pa.int32())})

    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.mapInArrow(run, f"a {kind}, b {kind}, matches int")


def payloads(docs: DataFrame, wanted: DataFrame, s: Settings) -> DataFrame:
    """(rep, n, sketch, shingles) of the classes wanted(rep, class, n, sketch), shingled anew from the text of a document that stands
    for one; so a set is stored once, and none of a document that met no other."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = list(shingle_sets(utf8(batch.column("text")), s.words))
            # Other versions under the same id have another class.
            own = pa.array([class_of(h) == c for h, c in zip(sets, batch.column("class").to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("rep", "n", "sketch")} | {"shingles": pa.array([h.tobytes() for h in sets], pa.binary())}).filter(own)

    texts = docs.join(wanted.hint("shuffle_merge"), docs["id"] == wanted["rep"]).select("rep", "class", "n", "sketch", "text", F.xxhash64("text").alias("version"))
    return texts.dropDuplicates(["rep", "class", "version"]).mapInArrow(run, f"rep {kind}, n bigint, sketch binary, shingles binary")


def verified(pairs: DataFrame, payload: DataFrame, s: Settings) -> DataFrame:
    """Pairs(a, b) whose full sets are similar enough."""
    kind = payload.schema["rep"].dataType.simpleString()

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(*(np.frombuffer(v.as_buffer(), np.uint64) for v in sets), s) for sets in zip(batch.column("set_a"), batch.column("set_b"))]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("a", "b")}).filter(pa.array(keep, pa.bool_()))

    first = payload.select(F.col("rep").alias("a"), F.col("shingles").alias("set_a")).hint("shuffle_merge")
    second = payload.select(F.col("rep").alias("b"), F.col("shingles").alias("set_b")).hint("shuffle_merge")
    return materialize(pairs.select("a", "b").distinct().join(first, "a").join(second, "b").mapInArrow(judge, f"a {kind}, b {kind}"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Each row's id with n_shingles, component_id (the smallest id that links reach) and kept (it is that id).

    Null, empty and blank texts have an empty set, link with nothing and are their own components; a text of fewer
    words than a shingle is one shingle.  Equal texts, and texts with equal sets, are linked.  Rows that share an id
    are versions of one document and end in one component; of such rows with equal sets the pair's links hold for
    all.  A null id is its own component (null), kept.  Texts of any length are used whole.
    """
    small_batches(df.sparkSession)
    with scratch(df.sparkSession):
        sizes, roots = _linked(df.select(df[id_col].alias("id"), df[text_col].alias("text")), settings)
    out = sizes.join(roots.hint("shuffle_merge"), "id", "left")
    root = F.coalesce("root", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", root.alias("component_id"), root.eqNullSafe(F.col("id")).alias("kept"))


def _linked(docs: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Kept tables (id, n_shingles) of all rows and (id, root) of all ids with a set."""
    sketched = materialize(sketches(docs, s))
    sizes = materialize(sketched.select("id", "n_shingles"), keep=True)
    full = sketched.where("n_shingles > 0 and id is not null")
    # One document stands for each class of equal sets.
    classes = materialize(full.groupBy("class").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")))
    rows = classes.select("rep", "n", F.explode(buckets(s)).alias("bucket"))
    several = materialize(rows.groupBy("bucket").count().where("count > 1").select("bucket"))
    met = materialize(rows.join(several.hint("shuffle_merge"), "bucket"))
    ends = materialize(met.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("low"), F.max(F.struct("rep", "n")).alias("high")))
    # Buckets with the same ends are one from here on.
    met = materialize(met.join(ends.hint("shuffle_merge"), "bucket").select("low", "high", F.struct("rep", "n").alias("own")).distinct())
    stars = met.select("own", F.explode(F.array("low", "high")).alias("end")).where(_alike("own.n", "end.n", s)).select(F.col("own.rep").alias("a"), F.col("end.rep").alias("b")).where("a <> b")
    tried = materialize(stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    groups = materialize(met.select(F.col("low.rep").alias("low"), F.col("own.rep").alias("rep"), F.col("own.n").alias("n")).distinct())
    payload = materialize(payloads(docs, classes.join(groups.select("rep").distinct().hint("shuffle_merge"), "rep", "left_semi"), s))
    likely = materialize(_likely(tried, payload, s))
    # The best partner of each first; then what still lies between components.
    best = materialize(likely.groupBy("a").agg(F.max_by("b", F.struct("matches", "b")).alias("b")))
    links = verified(best, payload, s)
    roots = components(links)
    links = links.unionByName(verified(_apart(likely.join(best.hint("shuffle_merge"), ["a", "b"], "left_anti").select("a", "b"), roots), payload, s))
    roots = components(links)
    rest = materialize(_apart(_mixed(groups, roots, payload, s), roots, "sure"))
    if rest.head(1):
        doubtful = rest.where("not sure").select("a", "b").join(tried.hint("shuffle_merge"), ["a", "b"], "left_anti")
        links = links.unionByName(rest.where("sure").select("a", "b")).unionByName(verified(doubtful, payload, s))
        roots = components(links)
    # From representatives to their classes' members, and to versions under one id.
    of_class = classes.select("class", "rep").join(roots.hint("shuffle_merge"), classes["rep"] == roots["id"], "left").select("class", F.coalesce("root", "rep").alias("root"))
    members = materialize(full.select("id", "class").join(of_class.hint("shuffle_merge"), "class").select("id", "root").distinct())
    if members.groupBy("id").count().where("count > 1").head(1):
        members = components(members.select(F.col("id").alias("a"), F.col("root").alias("b")))
    return sizes, materialize(members.groupBy("id").agg(F.min("root").alias("root")), keep=True)


def _likely(pairs: DataFrame, payload: DataFrame, s: Settings) -> DataFrame:
    a = payload.select(F.col("rep").alias("a"), F.col("sketch").alias("sketch_a")).hint("shuffle_merge")
    b = payload.select(F.col("rep").alias("b"), F.col("sketch").alias("sketch_b")).hint("shuffle_merge")
    return plausible(pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "sketch_a", "sketch_b"), s)


def _apart(pairs: DataFrame, roots: DataFrame, *more: str) -> DataFrame:
    """Pairs in different components."""
    kept = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "a", "b", *more)
    return relabel(kept, roots).where("a <> b").select(F.col("x").alias("a"), F.col("y").alias("b"), *more)


def _alike(n: str, m: str, s: Settings) -> Column:
    """Sets of such sizes can be similar enough."""
    return 100 * F.least(n, m) >= s.percent * F.greatest(n, m)


def _mixed(groups: DataFrame, roots: DataFrame, payload: DataFrame, s: Settings) -> DataFrame:
    """(a, b, sure): pairs of different components in one group that are links (sure), or may be, out of groups(low, rep, n): all that
    share a bucket whose smallest representative is `low`, so whatever shares a bucket shares a group.

    Of such a pair one at least is not in the group's largest component, so the rows of the others meet all rows: no square of a large
    component.  Rows go by number to each pair of blocks that they are in; a pair of blocks is tested and verified inside a
    task, and only links become rows.  Pairs that pass the test with a set too large for a block become rows to be verified.
    """
    rooted = materialize(groups.join(roots.hint("shuffle_merge"), groups["rep"] == roots["id"], "left").select("low", "rep", "n", F.coalesce("root", "rep").alias("root")))
    sizes = rooted.groupBy("low", "root").count()
    main = sizes.groupBy("low").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count("*").alias("roots"), F.sum("count").alias("size"), F.max("count").alias("most")).where("roots > 1").drop("roots")
    rows = rooted.join(materialize(main).hint("shuffle_merge"), "low")
    wide, high = F.ceil(F.col("size") / s.block), F.ceil((F.col("size") - F.col("most")) / s.block)
    at = lambda blocks: F.pmod(F.xxhash64("rep"), blocks)
    rows = materialize(rows.select("low", "rep", "root", (F.col("root") != F.col("main")).alias("other"), at(wide).alias("x"), at(high).alias("y"), wide.alias("wide"), high.alias("high")))
    # A row is on the left of all pairs of its block, and on the right too if it is one of the others.
    left = rows.select("low", "x", F.col("y").alias("own"), F.explode(F.sequence(F.lit(0), F.col("high") - 1)).alias("y"), "rep", "root", "other")
    left = left.select("low", "x", "y", "rep", "root", F.lit(True).alias("left"), (F.col("other") & (F.col("own") == F.col("y"))).alias("right"))
    right = rows.where("other").select("low", F.col("x").alias("own"), F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("x"), "y", "rep", "root").where("x <> own")
    placed = left.unionByName(right.select("low", "x", "y", "rep", "root", F.lit(False).alias("left"), F.lit(True).alias("right")))
    shingles = F.when(F.col("n") <= s.whole, F.col("shingles")).alias("shingles")
    row = F.struct("rep", "root", "n", "sketch", shingles, "left", "right").alias("row")
    blocks = placed.join(payload.hint("shuffle_merge"), "rep").select("low", "x", "y", row).groupBy("low", "x", "y").agg(F.collect_list("row").alias("rows"))
    kind = groups.schema["rep"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, width = least_matches(s), s.rows * s.bands
        for batch in batches:
            for rows in batch.column("rows"):
                fields = rows.values.flatten()
                rep, root, n, on_left, on_right = (fields[k].to_numpy(zero_copy_only=False) for k in (0, 1, 2, 5, 6))
                sketch = np.frombuffer(b"".join(fields[3].to_pylist()), np.uint8).reshape(-1, width)
                u, v = np.flatnonzero(on_left), np.flatnonzero(on_right)
                near = (root[u, None] != root[None, v]) & (100 * np.minimum(n[u, None], n[None, v]) >= s.percent * np.maximum(n[u, None], n[None, v]))
                i, j = (w[k] for w, k in zip((u, v), np.nonzero(near)))
                matches = np.zeros(len(i), np.int64)
                for at, few in enumerate(least):
                    cols = slice(at * s.batch, (at + 1) * s.batch)
                    for k in range(0, len(i), 1 << 16):
                        part = slice(k, k + (1 << 16))
                        matches[part] += (sketch[i[part], cols] == sketch[j[part], cols]).sum(1)
                    kept = matches >= few
                    i, j, matches = i[kept], j[kept], matches[kept]
                if not len(i):
                    continue
                sets = fields[4].to_pylist()
                sure = np.array([sets[p] is not None and sets[q] is not None for p, q in zip(i, j)])
                both = common_counts(sets, sets, i[sure], j[sure])
                keep = ~sure
                keep[sure] = 100 * both >= s.percent * (n[i[sure]] + n[j[sure]] - both)
                i, j, sure = i[keep], j[keep], sure[keep]
                a, b = rep[i], rep[j]
                yield pa.RecordBatch.from_pydict({"a": pa.array(np.maximum(a, b)), "b": pa.array(np.minimum(a, b)), "sure": pa.array(sure)})

    return blocks.select("rows").mapInArrow(run, f"a {kind}, b {kind}, sure boolean").distinct()


def common_counts(u: list, v: list, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many shingles sets u[i] and v[j] share, pair by pair: one by one for few pairs, else as a product of 0/1 matrices over the
    shingles that both sides have, some thousand columns at a time."""
    load = lambda b: np.frombuffer(b, np.uint64)
    if len(i) < 64:
        return np.array([len(np.intersect1d(load(u[p]), load(v[q]), assume_unique=True)) for p, q in zip(i, j)], np.int64)
    (left, at_i), (right, at_j) = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
    x, y = ([load(w[k]) for k in ks] for w, ks in ((u, left), (v, right)))
    shared = np.intersect1d(np.concatenate(x), np.concatenate(y))
    total = np.zeros((len(x), len(y)), np.float32)
    for start in range(0, len(shared), 4096):
        part = shared[start : start + 4096]
        sides = []
        for sets in (x, y):
            m = np.zeros((len(sets), len(part)), np.float32)
            for row, h in enumerate(sets):
                at = np.searchsorted(part, h)
                m[row, at[(at < len(part)) & (part[np.minimum(at, len(part) - 1)] == h)]] = 1
            sides.append(m)
        total += sides[0] @ sides[1].T
    return total[at_i, at_j].astype(np.int64)


def similar(x: np.ndarray, y: np.ndarray, s: Settings) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= s.percent * (len(x) + len(y) - both)
