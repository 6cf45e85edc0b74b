"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 4 << 20
"""Text that a Python task works on at a time; bounds its memory whatever the Arrow batch holds."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: str, m: int) -> Column:
    """crc32 of the id's decimal text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % m


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.  A temporary one only in local mode, where none is set."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="webgauge-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


_made: ContextVar[tuple[list[str], ...]] = ContextVar("made", default=())
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20
"""Bytes of an Arrow batch that goes to a Python worker; Spark's default is eight times that, in every worker at once."""


def small_batches(spark: SparkSession) -> None:
    """From here on the session sends small batches to Python; a smaller setting of the user's stays."""
    now = str(spark.conf.get(BATCH, "64m")).lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30}.get(now[-1:], 0)
    if int(now.rstrip("kmg")) << unit > BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def materialize(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors, and gives the optimizer the
    table's true size.  The shuffle files of the write go when it ends.  At the end of scratch() the table goes too; a table to `keep`
    belongs to the scratch() around that."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/webgauge/{uuid.uuid4().hex}"
    made, before = _made.get(), spark.conf.get(CLEANUP, "false")
    if len(made) > keep:
        made[-1 - keep].append(path)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the tables that materialize() wrote meanwhile.  What is read later must come from kept ones."""
    made: list[str] = []
    token = _made.set((*_made.get(), made))
    try:
        yield
    finally:
        _made.reset(token)
        for path in made:
            drop_table(spark, path)


def drop_table(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Hand freed memory back to the system: Spark uses a Python worker again, and what its largest step took would stay with it."""
    pa.default_memory_pool().release_unused()
    if _trim:  # not every C library has it
        _trim(0)


_remembered: list[Callable[[], None]] = []
"""Of a worker: what drops the memory of the step that ran last in it, if that step remembers texts from task to task."""


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES, forget: Callable[[], None] | None = None) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows with about `limit` bytes of text; a longer text stands alone.  Freed memory goes back
    to the system with each batch and at the end.  forget: drops what the caller remembers, once a task of another step begins."""
    for drop in _remembered:
        if drop != forget:
            drop()
    _remembered[:] = [forget] if forget else []
    for batch in batches:
        give_back()
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def inputs(df: DataFrame, id_col: str, text_col: str, carry: bool) -> DataFrame:
    """df's id and text under fixed names; with carry instead `row`, all its columns, of which id and text are a part already."""
    small_batches(df.sparkSession)
    if not carry:
        return df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return df.select(F.struct(*(df[f"`{c.replace('`', '``')}`"] for c in df.columns)).alias("row"))


def places(df: DataFrame, id_col: str, text_col: str) -> tuple[int, int]:
    """Where id and text are in df's rows."""
    return df.columns.index(id_col), df.columns.index(text_col)


def opened(batches: Iterable[pa.RecordBatch], at: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Batches of inputs() with id and text; they are read out of the row, if that is carried, and aren't sent beside it."""
    for batch in batches:
        if "row" in batch.schema.names:
            row = batch.column("row")
            batch = pa.RecordBatch.from_arrays([row.field(at[0]), row.field(at[1]), row], ["id", "text", "row"])
        yield batch


def outputs(docs: DataFrame, kind: T.DataType, ddl: str) -> T.StructType:
    """The schema of an operator's result: id, ddl, and the row if it is carried."""
    schema = T.StructType([T.StructField("id", kind), *T.StructType.fromDDL(ddl)])
    return schema.add("row", docs.schema["row"].dataType) if "row" in docs.columns else schema


def carried(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    return {"row": batch.column("row")} if "row" in batch.schema.names else {}


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    return pc.fill_null(column, "").cast(pa.binary()).to_pylist()


def csr_take(offsets: np.ndarray, data: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs data[offsets[i]:offsets[i+1]] for i in idx, end to end, and each run's length."""
    start = offsets[idx]
    lens = offsets[idx + 1] - start
    ends = np.cumsum(lens)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - lens), lens)
    return data[at], lens


def bounds(lens: Iterable[int]) -> np.ndarray:
    """Run lengths to offsets, with the leading 0."""
    return np.concatenate(([0], np.cumsum(np.fromiter(lens, np.int64)))).astype(np.int64)


class Numbered(dict):
    """Numbers its keys in the order of their first look-up."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def number(words: list, ids: dict) -> np.ndarray:
    return np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
