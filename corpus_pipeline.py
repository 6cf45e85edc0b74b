"""From documents to training tokens: quality rules, quality classifier, near-duplicates, benchmark contamination, BPE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webgauge.llm import bpe, decontaminate, near_dedup, quality_mil, quality_rules
from webgauge.llm.common import crc_mod, materialize, table


def columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.  Null, empty and blank texts go; repeated rows stay or go together; a null id or
    language plays no part."""
    return quality_rules.apply_rules(docs, carry=True).where("kept").select("row.*")


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones; it learns from labelled documents that are left.  Null and empty texts are
    scored as an empty passage; repeated rows stay or go together.  Without labels all scores are near one half."""
    model = quality_mil.train(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)
    return quality_mil.predicted(quality_mil.scores(docs, model, carry=True)).where("predicted = 1").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id, and of rows that share it the one whose text, then
    whose whole row as JSON, comes first.  Documents without an id stay, and so do null and empty texts under ids of their own.  Only rows of ids that
    occur twice are compared; the ids alone tell which these are."""
    gone = near_dedup.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    left = docs.join(gone.hint("shuffle_merge"), "doc_id", "left_anti").select(*columns(docs))
    twice = materialize(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not twice.head(1):
        return left
    row = F.struct(*columns(docs))
    one = left.join(twice.hint("shuffle_merge"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct("text", F.to_json(row))).alias("row")).select("row.*")
    return one.unionByName(left.join(twice.hint("shuffle_merge"), "doc_id", "left_anti").select(*columns(docs)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark.  Null and empty texts stay; repeated rows stay or go together; an
    empty benchmark removes nothing."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), carry=True)
    return decontaminate.verdict(found).where("not contaminated").select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, and the digests of ids and decoded text; null and empty texts have no ids; repeated rows give a
    row each."""
    return bpe.encode(docs).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("near_dedup", near_duplicates), ("decontamination", decontamination), ("bpe", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
