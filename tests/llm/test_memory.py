"""What the Python steps hold: all workers of an executor share its memory, and Spark uses them again for later steps."""

import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from webgauge.llm import bpe, decontaminate, near_dedup, quality_mil

ROWS = 4000


@pytest.fixture(scope="module")
def texts():
    """About 8 MB of words that the benchmark has too."""
    r = random.Random(5)
    words = ["".join(r.choices("etaoinshrdlu", k=r.randint(2, 9))) for _ in range(3000)]
    return [" ".join(r.choices(words, k=320)) for _ in range(ROWS)]


@pytest.fixture
def step(monkeypatch):
    """The function that f hands to mapInArrow last."""
    found, real = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, func, *a, **k: (found.append(func), real(self, func, *a, **k))[1])
    return lambda f: (f(), found[-1])[1]


def batches(texts):
    for k in range(0, len(texts), 500):
        yield pa.RecordBatch.from_pydict({"id": pa.array(range(k, k + 500), pa.int64()), "text": texts[k : k + 500]})


def peak_mb(f):
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def test_decontamination_memory(spark, step, texts):
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    items = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts[:40])], "item_id string, text string")
    run, out = step(lambda: decontaminate.contamination(docs, items)), []
    assert peak_mb(lambda: out.extend(x for b in run(batches(texts)) for x in b.column("items").to_pylist())) < 160
    assert [i for i, x in enumerate(out) if x] == list(range(40)) and len(out) == ROWS


def test_passages_memory(texts):
    raw, s = [t.encode() for t in texts[: ROWS // 2]], quality_mil.Settings()
    assert peak_mb(lambda: quality_mil.encode_passages(raw, s)) < 80
    # Pieces give the same as texts one by one.
    x, at = quality_mil.encode_passages(raw, s)
    for k in (0, 1, 777, len(raw) - 1):
        assert (x[at[k] : at[k + 1]] == quality_mil.encode_passages([raw[k]], s)[0]).all()


def test_bpe_memory(spark, step, texts):
    """What is remembered of texts stays for the step's next tasks, and goes once another step's task begins."""
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    run, own = step(lambda: bpe.encode(docs)), bpe.load(bpe.default_vocabulary())
    other = step(lambda: near_dedup.sketches(docs.toDF("id", "text"), near_dedup.Settings()))
    list(run(batches(texts[:500])))
    known = len(own.words)
    assert known > 1000
    list(run(batches(texts[:500])))
    assert len(own.words) == known
    list(other(batches(texts[:500])))
    assert len(own.words) == 0
    want = [own.encode_batch([t])[0].tolist() for t in texts[:500]]
    assert [x for b in run(batches(texts[:500])) for x in b.column("ids").to_pylist()] == want
