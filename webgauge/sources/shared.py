"""Tables in the folder that all executors share, and readers and writers of the library's tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FETCHES = "seq bigint, host string, original_url string, final_url string, status_code int, content_type string, content_length bigint, load_seconds double, headers map<string,string>, redirects array<struct<from_url:string,status_code:int,location:string>>, html string"


def new_path(spark: SparkSession) -> str:
    """A path of its own in the folder that all executors share; in a temporary folder only in local mode, where no shared one is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="webgauge-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/webgauge/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Remove what this application has written under new_path: when its results have been read, as they may read those tables."""
    own = new_path(spark).rsplit("/", 1)[0]
    where = spark._jvm.org.apache.hadoop.fs.Path(own)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page snapshots; columns that a query doesn't use aren't read."""
    return spark.read.parquet(path)


def read_fetches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FETCHES).parquet(path)


def read_whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, body) of text files, one row each; .gz files are unpacked.  For sitemaps and robots files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))


def read_observations(spark: SparkSession, path: str, ddl: str, bad: str = "bad_record") -> DataFrame:
    """JSON lines with a given schema; nothing is inferred.  A line that isn't JSON, or whose values don't fit the schema, stays as a row with its text in
    `bad` and what could be read of it beside; others have null there."""
    read = F.from_json("value", f"{ddl}, `{bad}` string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})
    return spark.read.text(path).where(F.trim("value") != "").select(read.alias("r")).select("r.*")


def split_bad(rows: DataFrame, bad: str = "bad_record") -> tuple[DataFrame, DataFrame]:
    """Readable rows without the column of unreadable ones, and the texts of the unreadable ones as `record`."""
    return rows.where(F.col(bad).isNull()).drop(bad), rows.where(F.col(bad).isNotNull()).select(F.col(bad).alias("record"))


def pick_robots(files: DataFrame) -> DataFrame:
    """One robots file for each host: https before http, answered before failed."""
    order = F.struct((F.col("status_code") != 200).cast("int").alias("failed"), (F.col("scheme") != "https").cast("int").alias("plain"))
    return files.groupBy("host").agg(F.min_by(F.struct("scheme", "status_code", "body"), order).alias("f")).select("host", "f.*")


def replace_hosts(df: DataFrame, path: str) -> None:
    """Write rows by host; hosts that df has are replaced, others stay."""
    df.write.partitionBy("host").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
