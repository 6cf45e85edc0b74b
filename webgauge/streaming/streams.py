"""The same checks over arriving data, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import checks


def arriving(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Parquet files as they come."""
    return spark.readStream.schema(schema).parquet(path)


def fetch_issues(fetches: DataFrame) -> DataFrame:
    """The checks of a fetch have no state: the batch function serves the stream."""
    return checks.fetch_issues(fetches)


def probe_windows(probes: DataFrame, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(host, start, n, ok): probes of each window; a stream drops what comes later than `late`."""
    rows = probes.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return rows.groupBy("host", window.alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("status_code").between(200, 399)).alias("ok")).select("host", F.col("w.start").alias("start"), "n", "ok")


def probe_sessions(probes: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    rows = probes.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy("host", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("host", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Repeats(StatefulProcessor):
    """Of one share of a host: its keys with their first seq.  A key that hasn't come for `ttl_ms` is forgotten."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getMapState("first", "key string", "seq bigint", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("seq", kind="stable")
        again = []
        for k, part in frame.groupby("key", sort=False):
            seq = part["seq"]
            first = self.first.getValue((k,))[0] if self.first.containsKey((k,)) else int(seq.iloc[0])
            again.append(part[seq > first])
            # Written anew, so that the time it's kept begins again.
            self.first.updateValue((k,), (min(first, int(seq.iloc[0])),))
        out = pd.concat(again)
        if len(out):
            yield out[["host", "key", "seq", "url"]]

    def close(self) -> None:
        pass


def repeated(rows: DataFrame, shares: int = 64, ttl: str = "30 days") -> DataFrame:
    """(host, key, seq, url): rows(host, key, seq, url) of a stream that aren't the first of their host with their key, flagged as they come.  The first goes free.

    Rows of a batch count in the order of seq, and batches as they come, so on rows that arrive in the order of seq these are content.repeated's.  A host's keys are
    dealt over `shares` states, which hold a number for each key seen within `ttl`; null and empty keys have no part.  It needs a state store with map state: the
    session's is set where it's Spark's default.  With a trigger that ends, turn batches without data off, as expiring state asks for them on and on.
    """
    conf = rows.sparkSession.conf
    if "RocksDB" not in conf.get(STATE_STORE, ""):
        conf.set(STATE_STORE, ROCKS)
    kept = rows.where("key <> '' and seq is not null").select("host", "key", F.col("seq").cast("bigint").alias("seq"), "url", F.pmod(F.xxhash64("key"), F.lit(shares)).alias("share"))
    ttl_ms = int(pd.Timedelta(ttl).total_seconds() * 1000)
    return kept.groupBy("host", "share").transformWithStateInPandas(_Repeats(ttl_ms), "host string, key string, seq bigint, url string", "append", "ProcessingTime")


def first_seen(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first row of each (host, key) within the watermark; rows(host, key, ts)."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["host", "key"])


def uniformity_alerts(fetches: DataFrame, first: int = 50, step: int = 25, share: float = 0.75) -> DataFrame:
    """(host, pages, top_length, top_count): once for each host, when at `first` pages, or each `step` after, one length dominates.

    A host's state is its lengths' counts, not its pages.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lengths, counts, done = state.get if state.exists else ([], [], False)
        seen = dict(zip(lengths, counts))
        pages = sum(counts)
        for frame in frames:
            for length in frame.sort_values("seq")["content_length"]:
                seen[int(length)] = seen.get(int(length), 0) + 1
                pages += 1
                if not done and pages >= first and (pages - first) % step == 0:
                    top, n = min(seen.items(), key=lambda x: (-x[1], x[0]))
                    if n / pages >= share:
                        done = True
                        yield pd.DataFrame({"host": [key[0]], "pages": [pages], "top_length": [top], "top_count": [n]})
        state.update((list(seen), list(seen.values()), done))

    return fetches.select("host", "seq", "content_length").groupBy("host").applyInPandasWithState(update, "host string, pages bigint, top_length bigint, top_count bigint", "lengths array<bigint>, counts array<bigint>, done boolean", "append", GroupStateTimeout.NoTimeout)
