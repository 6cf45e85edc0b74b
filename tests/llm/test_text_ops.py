"""Operators on texts against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webgauge.llm import bpe, decontaminate, lm, near_dedup, ngram_trie, quality_rules
from webgauge.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


# --- BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


def test_bpe_equals_library(library):
    own, r = bpe.load(bpe.default_vocabulary()), random.Random(3)
    parts = ["a", "the ", "ing", " ", "  ", "\n", "\t", "<|endoftext|>", "é", "字", "😀", "​", "\x1c", "\x85", "½", "'s", "!!", "0" * 30, "ab" * 20, "-" * 70, "\x00", "aaaa", "́"]
    texts = ["", " ", "\n"] + ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(1500)] + ["".join(r.choice("etaoinshr") for _ in range(r.randint(0, 300))) for _ in range(300)]
    ids, at = own.encode_batch(texts)
    for k, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        mine = ids[at[k] : at[k + 1]]
        assert mine.tolist() == e.ids, texts[k]
        assert own.decode(mine).decode() == texts[k]


def test_bpe_operator(spark, odd_docs, no_docs, library):
    out = bpe.encode(odd_docs).collect()
    assert len(out) == odd_docs.count()
    by = {r.doc_id: r for r in out}
    for i, t in texts_of(odd_docs):
        ids = library.encode(t, add_special_tokens=False).ids
        assert (by[i].ids, by[i].n_tokens, by[i].decoded) == (ids, len(ids), t)
        assert by[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert by[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert bpe.encode_digests(no_docs).count() == 0
    assert set(bpe.encode_digests(odd_docs, carry=True).select("row.*").columns) == set(odd_docs.columns)


# --- quality rules


def test_rules_figures(spark, odd_docs, no_docs):
    got = {r.doc_id: r for r in quality_rules.apply_rules(odd_docs).collect()}
    for i, t in texts_of(odd_docs):
        w = WORD.findall(t)
        c, hit = collections.Counter(zip(w, w[1:], w[2:])), set()
        for k in range(len(w) - 2):
            if c[tuple(w[k : k + 3])] > 1:
                hit |= {k, k + 1, k + 2}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality_rules.apply_rules(no_docs).count() == 0


def test_distance_is_a_distance():
    p = np.random.default_rng(0).dirichlet(np.ones(5), 6)
    d = quality_rules.distances(p, p)
    assert np.allclose(np.diag(d), 0, atol=1e-6) and np.allclose(d, d.T) and (d <= 1).all()
    assert quality_rules.distances(np.array([[1.0, 0]]), np.array([[0, 1.0]]))[0, 0] == 1
    assert all(d[a, c] <= d[a, b] + d[b, c] + 1e-9 for a in range(6) for b in range(6) for c in range(6))


def test_rules_reject_other_distributions(spark):
    r = random.Random(1)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(300)]
    good = [(k, " ".join(r.choice(words) for _ in range(300)), "en") for k in range(30)]
    bad = [(100, " ".join(r.choice(words).upper() + "!!" for _ in range(300)), "en"), (101, " ".join(r.choice(words) + " |" for _ in range(150)), "en")]
    got = {x.doc_id: x for x in quality_rules.apply_rules(spark.createDataFrame(good + bad, "doc_id bigint, text string, lang string")).collect()}
    assert all(got[k].kept for k in range(30)) and not got[100].kept and not got[101].kept


def test_rules_with_languages_without_reference_words(spark):
    r = random.Random(3)
    make = lambda n: ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(4, 7))) for _ in range(n)]
    words, other = make(100), make(300)
    rows = [(k, " ".join(r.choice(words) for _ in range(300)), "en") for k in range(40)] + [(100, " ".join(r.choice(other) for _ in range(300)), "en")]
    thai = " ".join("".join(r.choice("กขคงจชซดตนบปผพมยรลวสหอ") for _ in range(20)) for _ in range(300))
    df = spark.createDataFrame([*rows, (200, thai, "th"), (201, "", "xx"), (202, None, "yy")], "doc_id bigint, text string, lang string")
    got = {x.doc_id: x for x in quality_rules.apply_rules(df).collect()}
    assert all(got[k].kept for k in range(40)) and not got[100].kept and got[100].word_distance > 0.36 and not got[100].base_failed
    few = thai.split()[:50]
    more = [(k, " ".join(r.choice(few) for _ in range(300)), "th") for k in range(300, 305)]
    df = spark.createDataFrame([*rows, (200, thai, "one text"), *more], "doc_id bigint, text string, lang string")
    whole = {x.doc_id: x for x in quality_rules.apply_rules(df, quality_rules.Rules(common_bytes=None, min_reference_words=1000)).collect()}
    assert not whole[100].kept and all(whole[k].kept for k in (*range(40), *range(300, 305)))


# --- contamination


def brute(docs, items, window=13):
    found, out = collections.defaultdict(set), {}
    words = lambda s: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(s or "").encode())
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            found[tuple(w[k : k + window])].add("" if i is None else str(i))
    for i, t in docs:
        w = words(t)
        hit, names = [0] * len(w), set()
        for n in {len(k) for k in found}:
            for k in range(len(w) - n + 1):
                x = found.get(tuple(w[k : k + n]))
                if x:
                    names |= x
                    hit[k : k + n] = [1] * n
        out[i] = len(w), sum(hit), sorted(names)
    return out


@pytest.mark.parametrize("limit", [1 << 20, 200])
def test_contamination(spark, odd_docs, limit):
    r = random.Random(5)
    word = lambda: r.choice(["aa", "bb", "cc", "dd", "É", "x1"])
    docs = [(k, " ".join(word() for _ in range(r.randint(0, 120)))) for k in range(150)] + [(1000 + i, t) for i, t in enumerate(t for _, t in texts_of(odd_docs))]
    items = [(k, " ".join(word() for _ in range(r.choice([1, 3, 4, 5, 6, 15, 20])))) for k in range(2, 14)] + [(20, docs[3][1]), (21, docs[3][1]), (22, None), (23, " . "), (24, "the of and")]
    got = decontaminate.verdict(decontaminate.contamination(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), spark.createDataFrame(items, "item_id bigint, text string"), window=4, max_benchmark_bytes=limit)).collect()
    want = brute(docs, items, 4)
    assert len(got) == len(docs)
    for x in got:
        assert (x.n_words, x.n_hit, x["items"]) == want[x.doc_id]
        assert x.contaminated == (x.n_hit > 0 and 20 * x.n_hit >= x.n_words)
        assert all(a.stop < b.start or a.stop <= b.start for a, b in zip(x.spans, x.spans[1:]))


def test_contamination_without_items_or_docs(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert {x.n_hit for x in decontaminate.verdict(decontaminate.contamination(odd_docs, none)).collect()} == {0}
    assert decontaminate.contamination(no_docs, none).count() == 0


def test_fm_index():
    r = np.random.default_rng(1)
    text = np.append(r.integers(0, 5, 800), 0)
    index = decontaminate.FmIndex(text, 5)
    for n in (1, 2, 3, 5):
        pats = r.integers(1, 5, (40, n))
        low, high = index.search(pats, np.full(40, n))
        for p, a, b in zip(pats, low, high):
            places = [k for k in range(len(text) - n + 1) if (text[k : k + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == places


# --- near-duplicates


def brute_components(docs, words, percent=80):
    sets, parent = {}, {}
    for i, t in docs:
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a > b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                u, v = find(a), find(b)
                parent[max(u, v)] = min(u, v)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_dedup_equals_brute_force(spark, odd_docs):
    r = random.Random(9)
    vocab = [f"w{k}" for k in range(400)]
    docs = []
    for group in range(25):
        base = [r.choice(vocab) for _ in range(r.randint(5, 150))]
        for _ in range(r.choice([1, 2, 6, 20])):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 12))):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            docs.append((len(docs), " ".join(copy)))
    line = " ".join(f"line{k}" for k in range(13))
    docs += [(len(docs) + k, line + " " + " ".join(r.choice(vocab) for _ in range(r.randint(0, 6)))) for k in range(60)]
    docs += [(2000 + i, t) for i, t in texts_of(odd_docs) if i is not None and i != 10]
    r.shuffle(docs)
    got = {x.doc_id: x for x in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), settings=near_dedup.Settings(words=2)).collect()}
    for i, (n, root) in brute_components(docs, 2).items():
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, root, root == i)


def test_near_dedup_odd_rows(spark, odd_docs, no_docs):
    got = near_dedup.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count() and near_dedup.near_duplicates(no_docs).count() == 0
    by = collections.defaultdict(list)
    for x in got:
        by[x.doc_id].append(x)
    assert by[2][0].component_id == 1 and not by[2][0].kept and by[None][0].component_id is None and by[None][0].kept
    assert len(by[10]) == 2 and by[8][0].component_id == 7 and by[4][0].n_shingles == 0 and by[5][0].component_id == 5


def test_chain_of_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 99), (99, 98), (98, 100)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {99: 98, 100: 98}


def test_pruning_keeps_similar_pairs():
    s = near_dedup.Settings(words=2)
    least = near_dedup.least_matches(s)
    r = np.random.default_rng(0)
    for _ in range(300):
        m = (r.random(s.rows * s.bands) < 0.8).cumsum()[s.batch - 1 :: s.batch]
        assert (m >= least).all()


# --- language model


def test_elias_fano():
    r = np.random.default_rng(0)
    for n, top in ((0, 5), (1, 1), (5, 3), (1000, 10), (1000, 10**6), (777, 2**40)):
        v = np.sort(r.integers(0, top, n))
        ef = ngram_trie.EliasFano(ngram_trie.EliasFano.build(v))
        assert (ef.at(np.arange(n)) == v).all()
        q = r.integers(0, top, 500)
        q = q[q <= (v[-1] if n else -1)]
        assert (ef.find(q) == np.searchsorted(v, q)).all()


def test_elias_fano_finds():
    r = np.random.default_rng(1)
    for n, top in ((1, 1), (1000, 10), (1000, 10**6), (777, 2**40)):
        v = np.sort(r.integers(0, top, n))
        q = np.concatenate((v[::7], r.integers(0, v[-1] + 1, 500)))
        many, few = (ngram_trie.EliasFano(ngram_trie.EliasFano.build(v)) for _ in range(2))
        place, same = many.found(q)
        assert (same == np.isin(q, v)).all() and (place == np.searchsorted(v, q)).all()
        # One by one these are too few to unpack the high bits for, unless there is but one value.
        assert [int(few.find(q[k : k + 1])[0]) for k in range(50)] == place[:50].tolist()
        assert [int(few.at(np.array([k]))[0]) for k in range(min(n, 50))] == v[:50].tolist()
        assert n == 1 or not few._unpacked and many._unpacked


def tokens_of(df):
    return [(i, WORD.findall(lower(t)) + [None]) for i, t in texts_of(df)]


def brute_model(docs, usable, s=lm.Settings()):
    """p(context, word), each order drawn to the lower one."""
    c = [collections.Counter() for _ in range(4)]
    for i, d in docs:
        for k in (1, 2, 3):
            c[k].update(tuple(d[j : j + k]) for j in range(len(d) - k + 1) if usable(i))
    total, kinds = sum(c[1].values()), len(c[1])

    def p(g):
        if len(g) == 1:
            return (c[1][g] + s.add) / (total + s.add * (kinds + 1))
        mass = s.pair_mass if len(g) == 2 else s.triple_mass
        return (c[len(g)][g] + mass * p(g[1:])) / (c[len(g) - 1][g[:-1]] + mass)

    return p, c[1]


@pytest.mark.parametrize("settings", [lm.Settings(), lm.Settings(shard=40, piece=120)])
def test_lm_equals_brute_force(spark, odd_docs, settings):
    r = random.Random(5)
    words = [f"w{k}" for k in range(40)] + ["y" * 100]
    rows = [(100 + k, " ".join(words[min(40, int(r.expovariate(0.12)))] for _ in range(r.randint(0, 60)))) for k in range(80)]
    df = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id bigint, text string")).repartition(3)
    usable = lambda i: i is not None and i % 4 != 0
    docs = tokens_of(df)
    got = lm.scores(df, "doc_id % 4 <> 0", settings).collect()
    p, c = brute_model(docs, usable, settings)
    by = collections.defaultdict(list)
    for x in got:
        by[x.doc_id].append(x)
    assert len(got) == len(docs)
    for i, d in docs:
        base = sum(np.log10(p((w,))) for w in d)
        score = sum(np.log10(p(tuple(d[max(0, j - 2) : j + 1]))) for j in range(len(d)))
        for x in by[i]:
            assert abs(x.base_score - base) < 1e-6 * max(1, abs(base)) and abs(x.score - score) < 5e-4 * len(d) + 1e-6
            assert x.n_tokens == len(d) and x.n_known == sum(c[(w,)] > 0 for w in d) and x.train_tokens == sum(c.values())


def test_lm_contexts_sum_to_one():
    r = random.Random(2)
    docs = [(k, [r.choice("abcde") for _ in range(r.randint(0, 9))] + [None]) for k in range(30)]
    p, c = brute_model(docs, lambda i: True)
    words = [w for (w,) in c] + ["unseen"]
    for a in words:
        for b in words:
            if a is not None and b is not None:
                assert abs(sum(p((a, b, w)) for w in words) - 1) < 1e-9 and abs(sum(p((b, w)) for w in words) - 1) < 1e-9


def test_lm_tokens():
    texts = ["", " ", "A b\x0b\fb", "\xa0É a\x00b \n\n B", "x", "\u2003 x\t"]
    want = [[w.encode() for w in WORD.findall(lower(t))] for t in texts]
    for n in (1, 2, len(texts)):  # the first ones are blank
        for end in (False, True):
            codes, at, known = lm.coded([t.encode() for t in texts[:n]], end)
            assert len(set(known)) == len(known)
            assert [[known[c] for c in codes[a:b]] for a, b in zip(at, at[1:])] == [w + [lm.END] * end for w in want[:n]]


def test_distinct_keys():
    r = np.random.default_rng(3)
    for keys in (np.zeros(0, np.int64), np.zeros(5, np.int64), r.integers(0, 9, 100), r.integers(0, 60, 100) << 57):
        for got, want in zip(lm.distinct(keys), np.unique(keys, return_index=True, return_inverse=True)):
            assert (got == want).all()


def test_lm_sorts_numbers_only(monkeypatch):
    """Pairs and triples are told apart by sorting plain numbers: sorting places by keys took most of the time of a pass."""
    r = np.random.default_rng(4)
    words = (r.zipf(1.3, 20000) % 5000).astype(str)
    codes, at, known = lm.coded([" ".join(words[k : k + 100]).encode() for k in range(0, len(words), 100)], True)
    packed = {"codes": codes, "at": at, "lead": np.zeros(len(at) - 1, np.int64)}
    batch = pa.RecordBatch.from_pydict({**{k: pa.array([lm.pack(v)]) for k, v in packed.items()}, "train": pa.array([[True] * (len(at) - 1)])})
    sorted_places = []
    unique = np.unique
    monkeypatch.setattr(np, "unique", lambda a, **how: sorted_places.append(len(a)) or unique(a, **how))
    chunk = lm.Chunk(batch, 0)
    a, b, _, at_pair = chunk.pairs(len(known))
    before, after, ends, which = chunk.triples(at_pair, len(a))
    assert not sorted_places
    token = lambda k: codes[ends - k]
    assert (a[before[which]] == token(2)).all() and (b[before[which]] == token(1)).all() and (b[after[which]] == token(0)).all()
    assert len(before) == len(set(zip(token(2).tolist(), token(1).tolist(), token(0).tolist())))


def test_lm_without_rows(spark, odd_docs, no_docs):
    assert lm.scores(no_docs, "true").count() == 0
    assert all(abs(x.score) < 1e-9 and x.train_tokens == 0 for x in lm.scores(odd_docs, "false").collect())


def test_trie():
    r = np.random.default_rng(1)
    paths = np.unique(r.integers(0, 30, (2000, 3)), axis=0)
    pairs, node = np.unique(paths[:, :2], axis=0, return_inverse=True)
    trie = ngram_trie.opened(ngram_trie.image(ngram_trie.build(30, (pairs[:, 0], pairs[:, 1], np.arange(len(pairs))), (node.ravel(), paths[:, 2], np.arange(len(paths))))))
    asked = r.integers(0, 30, (5000, 3))
    pair, triple = trie.find(*asked.T)
    known = {tuple(x): k for k, x in enumerate(paths.tolist())}
    known_pairs = {tuple(x): k for k, x in enumerate(pairs.tolist())}
    assert triple.tolist() == [known.get(tuple(x), -1) for x in asked.tolist()]
    assert pair.tolist() == [known_pairs.get(tuple(x[:2]), -1) for x in asked.tolist()]


def test_common_counts():
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 300, 80).astype(np.uint64)) for _ in range(24)]
    packed = [h.tobytes() for h in sets]
    i, j = (a.ravel() for a in np.meshgrid(np.arange(24), np.arange(24)))
    want = [len(set(sets[p].tolist()) & set(sets[q].tolist())) for p, q in zip(i, j)]
    assert near_dedup.common_counts(packed, packed, i, j).tolist() == want
    assert near_dedup.common_counts(packed, packed, i[:5], j[:5]).tolist() == want[:5]
