"""Bounded training samples for classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column | str, size: int, seed: int, ones: float = 0.5, id_col: str = "doc_id", label_id: str = "doc_id") -> DataFrame:
    """docs(id, text) with `label` 0/1 for about size * ones rows of label 1 and the rest of label 0, all where there are fewer.

    Rows are picked by a hash of their id against the wanted over the actual number of rows with that label, so the same rows
    are picked whatever the partitioning and no ordering of all labels takes place.  Of several labels of an id the
    largest counts, of several texts the first in order; rows with null ids, texts or labels don't.  usable: a condition on the labels' id.
    """
    known = labels.where(usable).select(F.col(label_id).alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    n = {r.label: r["count"] for r in known.groupBy("label").count().collect()}  # two rows at most
    share = F.when(F.col("label") == 1, size * ones / max(1, n.get(1, 0))).otherwise(size * (1 - ones) / max(1, n.get(0, 0)))
    picked = known.where(F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1 << 30)) / (1 << 30) < share)
    # About `size` rows of two numbers: small enough for every executor.
    return docs.where("text is not null").join(F.broadcast(picked), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
