"""Each stage of the pipeline against a plain version, on rows of all kinds; and the registered SQL of the operators."""

import collections
import random

import duckdb
import pytest

import corpus_pipeline
from tests.llm.test_text_ops import WORD, brute, brute_components
from webgauge.llm import bpe, quality_mil, queries
from webgauge.llm.common import crc_mod

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with benchmark and labels, and documents: clean ones, copies, contaminated and repetitive ones, odd rows, further columns."""
    r = random.Random(4)
    path = str(tmp_path_factory.mktemp("corpus"))
    items = [(k, " ".join(r.choice(WORDS) + str(r.randint(0, 9)) for _ in range(20))) for k in range(5)]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    base = [" ".join(r.choice(WORDS) for _ in range(150)) for _ in range(12)]
    texts = base + [t + " more words" for t in base[:4]] + base[:3] + [base[5] + " " + items[0][1], items[1][1] * 3, "same words again " * 40, "too few words", "", " \n ", None, "x" * 90000 + " " + base[7]]
    rows = [(k, t, "en", "web", len(t or ""), "a", "b") for k, t in enumerate(texts)] + [(3, base[3], "en", "web", 1, "a", "b"), (3, base[9] + " z", None, None, 1, "a", "b"), (None, base[11], "en", "web", 1, "a", "b")]
    spark.createDataFrame([(k, int(k % 2 == 0), 0) for k in range(len(texts))], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, `a.b` string, row string").repartition(3)
    docs.write.parquet(f"{path}/documents.parquet")
    return path, spark.read.parquet(f"{path}/documents.parquet")


WORDS = "alpha beta gamma delta river stone garden winter summer bread market letter window forest silver number common simple every under".split()


def counted(rows):
    return collections.Counter(tuple(r) for r in rows)


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_rules(spark, corpus):
    path, docs = corpus
    got = stage("quality_rules")(spark, docs, path)
    assert got.columns == docs.columns
    kept = counted(got.collect())
    for row in docs.collect():
        w = WORD.findall(row.text or "")
        c = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        if len(w) < 50 or 100 * len(hit) > 50 * len(w):
            assert tuple(row) not in kept
        elif row.text.startswith(tuple(WORDS)) and len(w) < 200:
            assert tuple(row) in kept


def test_classifier(spark, corpus):
    path, docs = corpus
    got = stage("quality_classifier")(spark, docs, path)
    model = quality_mil.train(docs, spark.read.parquet(f"{path}/labels.parquet"), crc_mod("doc_id", 3) != 1)
    rows = docs.collect()
    x, at = quality_mil.encode_passages([(r.text or "").encode() for r in rows], model.s)
    good = model.score(x, at) >= 0.5
    assert got.columns == docs.columns and counted(got.collect()) == counted(r for r, g in zip(rows, good) if g)


def test_near_duplicates(spark, corpus):
    path, docs = corpus
    got = stage("near_dedup")(spark, docs, path)
    rows = docs.collect()
    one = {}
    for r in rows:  # of rows that share an id
        if r.doc_id is not None:
            one.setdefault(r.doc_id, []).append(r)
    roots = brute_components([(k, t) for k, t in enumerate(r.text or "" for r in rows)], 5)
    # Rows to components; versions under one id are one document.
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_id = {}
    for k, r in enumerate(rows):
        for other in (roots[k][1], by_id.setdefault(r.doc_id, k) if r.doc_id is not None and roots[k][0] else k):
            if r.doc_id is not None and rows[other].doc_id is not None:
                a, b = find(k), find(other)
                parent[max(a, b)] = min(a, b)
    least = {}
    for k, r in enumerate(rows):
        if r.doc_id is not None:
            least[find(k)] = min(least.get(find(k), r.doc_id), r.doc_id)
    want = [min(v, key=lambda r: (r.text is not None, r.text)) for i, v in one.items() if any(least[find(k)] == i for k, r in enumerate(rows) if r.doc_id == i)]
    assert got.columns == docs.columns
    left = got.collect()
    assert sorted((r.doc_id, r.text or "") for r in left if r.doc_id is not None) == sorted((r.doc_id, r.text or "") for r in want)
    assert sum(r.doc_id is None for r in left) == sum(r.doc_id is None for r in rows)


def test_decontamination(spark, corpus):
    path, docs = corpus
    got = stage("decontamination")(spark, docs, path)
    rows = docs.collect()
    found = brute(list(enumerate(r.text for r in rows)), [tuple(r) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()])
    want = [r for k, r in enumerate(rows) if not (found[k][1] > 0 and 20 * found[k][1] >= found[k][0])]
    assert len(want) < len(rows) and got.columns == docs.columns and counted(got.collect()) == counted(want)


def test_tokens_and_run(spark, corpus):
    path, docs = corpus
    got = stage("bpe")(spark, docs, path).collect()
    encoder = bpe.load(bpe.default_vocabulary())
    want = collections.Counter((r.doc_id, tuple(encoder.encode_batch([r.text or ""])[0].tolist())) for r in docs.collect())
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    whole = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in whole} <= {r.doc_id for r in docs.collect()}


def test_no_rows(spark, corpus):
    path, docs = corpus
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs.limit(0), path).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_registered_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    assert collections.Counter(want.fetchall()) == counted(queries.QUERIES[name](spark, SF).select(*names).collect())
