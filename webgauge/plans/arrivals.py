"""Queries of streams: files arrive in two parts, with a restart from the checkpoint between them; windows of probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources import shared
from ..streaming import streams
from . import duck as d
from .content import _titles
from .fixtures import view
from .pages import HEAD
from .registry import query


NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


def _drained(stream: DataFrame, out: str, checkpoint: str) -> None:
    """All that is there, and no batches without rows after it, which state that expires would ask for on and on."""
    conf = stream.sparkSession.conf
    before = conf.get(NO_DATA)
    conf.set(NO_DATA, "false")
    try:
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.set(NO_DATA, before)


@query(f"SELECT host, key, seq, url FROM (SELECT host, page_id AS seq, url, {d.fold('title')} AS key FROM head) k WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY host, key ORDER BY seq) >= 2", head=HEAD)
def st3_d2_repeated_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second half of the titles arrives after the first has been worked through and the stream has been started anew."""
    rows = shared.materialize(_titles(spark, sf_dir, "title").select("host", text.fold(F.col("value")).alias("key"), "seq", "url"))
    middle = rows.agg(F.percentile_approx("seq", 0.5)).first()[0]
    arrives, out, checkpoint = (shared.new_path(spark) for _ in range(3))
    for part in (rows.where(F.col("seq") <= middle), rows.where(F.col("seq") > middle)):
        part.write.mode("append").parquet(arrives)
        _drained(streams.repeated(streams.arriving(spark, arrives, rows.schema)), out, checkpoint)
    return spark.read.schema(rows.select("host", "key", "seq", "url").schema).parquet(out)


@query("SELECT host, CAST(start AS TIMESTAMP) AS start, count(*) AS n, count(*) FILTER (status_code BETWEEN 200 AND 399) AS ok FROM (SELECT *, time_bucket(INTERVAL 5 MINUTE, ts) - k * INTERVAL 5 MINUTE AS start FROM probes, (VALUES (0), (1)) AS s(k)) x GROUP BY host, start")
def st4_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.probe_windows(view(spark, sf_dir, "probes"), "10 minutes", "5 minutes").withColumn("start", F.col("start").cast("timestamp_ntz"))


GAPS = "SELECT host, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY host ORDER BY ts) < INTERVAL 20 MINUTE THEN 0 ELSE 1 END AS begins FROM probes"
ISLANDS = "SELECT host, ts, sum(begins) OVER (PARTITION BY host ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM gaps"


@query('SELECT host, min(ts) AS start, max(ts) + INTERVAL 20 MINUTE AS "end", count(*) AS n FROM islands GROUP BY host, island', gaps=GAPS, islands=ISLANDS)
def st4_probe_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = streams.probe_sessions(view(spark, sf_dir, "probes"), "20 minutes")
    return made.select("host", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
