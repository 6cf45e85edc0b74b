"""URL filter, hard negatives and token alignment against brute force, and on odd rows."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.conftest import SF
from webgauge.llm import bpe, hard_negatives, queries, token_align, url_filter

# --- URL filter


def test_url_rules_and_terms(spark):
    rules = url_filter.Rules(block=(("net", "/"), ("example.com", "/de/")), allow=(("example.net", "/en/"), ("org", "/fr/")))
    cases = [
        ("http://A.Net/x", "a.net", "/x", "net/", "block"), ("http://a.net", "a.net", "", None, "allow"), ("https://x.example.net/en/1", "x.example.net", "/en/1", "example.net/en/", "allow"),
        ("https://xexample.net/en/1", "xexample.net", "/en/1", "net/", "block"), ("http://org/fr/", "org", "/fr/", "org/fr/", "allow"), ("http://b.org/fr", "b.org", "/fr", None, "allow"),
        ("http://example.com/de/?a=casino", "example.com", "/de/", "example.com/de/", "block"), ("http://example.org/fr/casino", "example.org", "/fr/casino", "org/fr/", "allow"),
        ("http://my-casino.com/", "my-casino.com", "/", None, "block"), ("http://casinos-x.com/", "casinos-x.com", "/", None, "block"), ("http://occasino.com/", "occasino.com", "/", None, "allow"),
        ("http://cheap-cheap.com/cheap", "cheap-cheap.com", "/cheap", None, "allow"), ("http://cheap-pills.com", "cheap-pills.com", "", None, "block"), ("http://pillscheap.com", "pillscheap.com", "", None, "allow"),
        (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("no scheme casino", "", "", None, "block"), ("http://h" + "/a" * 50_000 + "/porn", "h", "/a" * 50_000 + "/porn", None, "block"),
        ("http://a.com?x://b.net/", "a.com", "", None, "allow"), ("http://ÄB.com/É#/q", "Äb.com", "/É", None, "allow"),
    ]
    df = spark.createDataFrame([(k, c[0], "clash", None) for k, c in enumerate(cases)] + [(None, "http://a.net/", "x", "y")] * 2, "page_id int, url string, host string, verdict string")
    got = url_filter.judge(df.repartition(3), rules).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got if r.page_id is not None) == [(k, *c[1:]) for k, c in enumerate(cases)]
    assert [r.rule for r in got if r.page_id is None] == ["net/", "net/"]
    assert not url_filter.judge(df.limit(0), rules).collect()


def test_url_terms_are_weighed_once():
    v = url_filter.Vocabulary(strict=("bad",), soft=(("a", 1), ("b", 2)), limit=4)
    weight = lambda u: sum(w for w, _ in url_filter.hits(u, v).values())
    assert [weight(u) for u in ("a/a/a", "a/b", "a.b.bad", "ab", "")] == [1, 3, 7, 0, 0]
    assert url_filter.hits("a/a/a", v) == {"a": (1, 3)}
    with pytest.raises(ValueError):
        url_filter.Vocabulary(soft=(("a", 4),), limit=4)


# --- hard negatives


def mined(rows, anchors, k=5):
    """Every score, in whole numbers."""
    rows = [(i, label, [int(np.floor(256 * np.float64(x))) for x in v]) for i, label, v in rows if None not in (i, label, v) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, label, v in {(i, label, tuple(v)) for i, label, v in rows if anchors(i)}:
        score = lambda w: sum(a * b for a, b in zip(v, w))
        others = sorted((-score(w), j, own) for j, own, w in rows if j != i and len(w) == len(v))
        for p, j, own in [x for x in others if x[2] == label][:k]:
            fit = [x for x in sorted((-score(w), j2, o) for j2, o, w in rows if len(w) == len(v)) if x[2] != label and 80 * -p <= 100 * -x[0] <= 100 * -p]
            out += [(i, j, n + 1, x[1], -p, -x[0]) for n, x in enumerate(fit[:k])]
    return sorted(out)


def test_intervals_hold():
    rng = np.random.default_rng(1)
    for d in (1, 3, 64, 100, 200):
        v = np.floor(rng.normal(0, 40, (300, d))).astype(np.int64)
        v[:3] = np.array([[0], [1], [-7]])
        q = np.floor(rng.normal(0, 40, (20, d))).astype(np.int64)
        q[0] = 0
        low, high = hard_negatives.Queries(q).interval(*hard_negatives.codes(v), slice(0, 20))
        true = v @ q.T
        assert (low <= true).all() and (true <= high).all()
        if d == 64:
            assert np.median(high - low) < 1.5 * np.median(np.linalg.norm(v, axis=1)) * np.median(np.linalg.norm(q, axis=1))


def test_hard_negatives_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    near = rng.normal(0, 0.2, (6, 24))
    rows = [(i, int(i % 4), [float(x) for x in np.float32(near[i % 6] + rng.normal(0, 0.08, 24))]) for i in range(700)]
    rows += [(1000 + i, i % 2, rows[0][2]) for i in range(300)]  # very many equal vectors: ties by id
    rows += [(2000, 1, [0.0] * 24), (2001, 2, [0.0] * 24), (2100, 3, [1.0, 2.0]), (2101, 3, [1.0, 1.0]), (2102, 1, [1.0, 1.5]), (2200, 0, []), (2201, 0, []), (2202, 1, [])]
    rows += [rows[50], rows[100], (3, None, rows[0][2]), (None, 1, rows[0][2]), (4000, 1, None), (4001, 1, [float("nan")] * 24), (4002, 1, [float("inf")] * 24), (4003, 1, [None] * 24)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, label int, embedding array<float>, code string, id int").repartition(5)
    got = hard_negatives.mine(df, "id % 100 = 0").collect()
    assert sorted(map(tuple, got)) == mined(rows, lambda i: i % 100 == 0)
    small = hard_negatives.BLOCK_BYTES
    hard_negatives.BLOCK_BYTES = 8 * 24 * 3  # three anchors a block
    try:
        assert sorted(map(tuple, hard_negatives.mine(df, "id % 100 = 0").collect())) == sorted(map(tuple, got))
    finally:
        hard_negatives.BLOCK_BYTES = small
    assert not hard_negatives.mine(df.limit(0), "id % 100 = 0").collect()
    assert not hard_negatives.mine(df, "false").collect()


# --- token alignment

ODD = [
    None, "", " ", "  a  b\n\n\nc \r\n\t x ", "▁", "a▁b", "<|endoftext|> <s> </s> <unk> <0x41>", "\x00 é́ 😀 字字字 " * 50, "x" * 3000, " " * 1000, "\n" * 500, "\n \n  a\n b", "a;\r\nb);\r \r", "  　 a", "\u2028\x85 x\x1c y",
    "naïve café naïve", "the the the the", "ab" * 20_000, "\u0378\U0010ffff", "ﬁ ½ Ⅷ",
]


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def grouped(text, libraries):
    """Groups by offsets where tokens of both libraries end."""
    first, second = libraries
    if not text:
        return []
    letters = bpe._byte_letters()
    a = [(i, len(first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
    of = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
    b = [(i, len(of(second.id_to_piece(i)))) for i in second.encode(text)]
    whole = (" " + text).encode()
    if b"".join(of(second.id_to_piece(i)) for i, _ in b) != whole or bytes(letters[c] for i, _ in a for c in first.id_to_token(i)) != whole:
        return []
    ends_a, ends_b = np.cumsum([n for _, n in a]), np.cumsum([n for _, n in b])
    out, i, j = [], 0, 0
    for end in sorted({*ends_a.tolist()} & {*ends_b.tolist()}):
        k, m = int(np.searchsorted(ends_a, end)) + 1, int(np.searchsorted(ends_b, end)) + 1
        out.append(([x for x, _ in a[i:k]], [x for x, _ in b[j:m]]))
        i, j = k, m
    return out


def aligned(texts, libraries):
    groups = [grouped(t, libraries) for t in texts]
    links = [Counter((a, b) for x, y in g for a in x for b in y) for g in groups]
    held = Counter(p for own in links for p in own)
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    out = []
    for g, own in zip(groups, links):
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(own.values()), sum(n for (a, b), n in own.items() if held[a, b] == best[a]), sum(n * held[p] for p, n in own.items()), hashlib.sha256(said.encode()).hexdigest() if said else ""))
    return out


FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_equals_libraries(spark, libraries):
    texts = ODD + ODD[5:8] + ["the café the"] * 40
    schema = T.StructType.fromDDL("doc_id bigint, text string, pairs string, chunk int, id string")
    df = spark.createDataFrame([(k, t, "x", 1, None) for k, t in enumerate(texts)], schema).repartition(4)
    got = sorted(token_align.align(df).collect())
    assert [tuple(r[c] for c in FIGURES) for r in got] == aligned(texts, libraries)
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in got if r.groups)
    assert not token_align.align(df.limit(0)).collect()
    twice = token_align.align(df.withColumn("doc_id", F.lit(None).cast("bigint")), groups=False).collect()
    assert sorted(tuple(r[c] for c in FIGURES) for r in twice) == sorted(tuple(r[c] for c in FIGURES) for r in got)


def test_alignment_of_a_whole_table_equals_libraries(spark, libraries):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = queries.op13_token_align(spark, SF).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in ("doc_id", *FIGURES)) for r in got] == [(r.doc_id, *x) for r, x in zip(rows, aligned([r.text for r in rows], libraries))]


def test_pointers_end_where_components_do():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        a, b = (np.append(np.flatnonzero(rng.random(n - 1) < p), n - 1) for p in rng.random(2))
        group_a, group_b, k = token_align.components(a, b)
        both = np.intersect1d(a, b)
        assert k == len(both)
        assert (group_a == np.searchsorted(both, a)).all() and (group_b == np.searchsorted(both, b)).all()


def test_large_groups_are_crossed_in_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    args = rng.integers(0, 50, 300), rng.integers(0, 40, 200), np.sort(rng.integers(0, 6, 300)), np.sort(rng.integers(0, 6, 200)), np.array([0, 0, 1, 1, 1, 2]), 50, 40
    want = Counter((int(args[4][g]) * 50 + int(a)) * 40 + int(b) for a, g in zip(args[0], args[2]) for b, h in zip(args[1], args[3]) if g == h)
    for size in (1, 100, 2_000_000):
        monkeypatch.setattr(token_align, "EXPANDED", size)
        keys, times = token_align.linked(*args)
        assert dict(zip(keys.tolist(), times.tolist())) == dict(want)


def test_units_beyond_the_limit_are_forgotten(libraries):
    units = token_align.Units(bpe.default_vocabulary(), token_align.default_pieces(), limit=10)
    for k in range(3):
        texts = [f"some words {k} and {j} more {j * k} of them\n\n x\ty" for j in range(20)]
        got = token_align.Aligned(texts, units)
        assert [x.decode() for x in got.written()] == [";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in grouped(t, libraries)) for t in texts]
        assert len(units) <= 10 and len(units.good) == len(units)


@pytest.mark.parametrize("name", ["op11_url_filter", "op12_hard_negatives"])
def test_queries_equal_sql(spark, name):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(map(str, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(str, want.fetchall()))
