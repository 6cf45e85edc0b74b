"""Registrable domains by a table of public suffixes with wildcards and exceptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def registrable_domains(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, suffix, domain) of distinct hosts(host) under rules(rule): the longest suffix that a rule names, and the domain one label below it.

    A rule is a suffix, *.suffix for each name right below it, or !name for an exception, which beats all others and whose suffix is the name without its
    first label.  Where no rule fits, the last label is the suffix.  Case and a last dot don't count; a host that is a suffix itself has a null
    domain, and so have blank hosts, with a null suffix.  Each host asks once for each of its endings, so the work doesn't depend on how many rules there are.
    """
    known = rules.select(F.lower(F.trim("rule")).alias("rule")).where("rule <> ''").distinct()
    names = hosts.select("host").distinct().withColumn("labels", F.filter(F.split(F.lower("host"), r"\."), lambda x: F.trim(x) != ""))
    size = F.size("labels")
    ends = names.select("host", "labels", F.explode(F.sequence(F.lit(1), F.greatest(size, F.lit(1)))).alias("n")).withColumn("ending", F.expr("array_join(slice(labels, -least(n, size(labels)), least(n, size(labels))), '.')")).where("n <= size(labels)")
    below = F.when(F.col("n") > 1, F.concat(F.lit("*."), F.regexp_replace("ending", r"^[^.]*\.", "")))
    asks = ends.select("host", F.explode(F.array(F.struct(F.lit(0).alias("wins"), F.col("n").alias("labels"), F.col("ending").alias("rule")), F.struct(F.lit(0).alias("wins"), F.col("n").alias("labels"), below.alias("rule")), F.struct(F.lit(1).alias("wins"), (F.col("n") - 1).alias("labels"), F.concat(F.lit("!"), "ending").alias("rule")))).alias("a")).select("host", "a.*").where("rule is not null")
    best = asks.join(known.hint("shuffle_merge"), "rule").groupBy("host").agg(F.max(F.struct("wins", "labels")).alias("b"))
    found = names.join(best.hint("shuffle_merge"), "host", "left").withColumn("k", F.least(F.coalesce("b.labels", F.lit(1)), size))
    end = lambda k: f"array_join(slice(labels, -({k}), {k}), '.')"
    return found.select("host", F.expr(f"CASE WHEN size(labels) > 0 AND k > 0 THEN {end('k')} END").alias("suffix"), F.expr(f"CASE WHEN size(labels) > k THEN {end('k + 1')} END").alias("domain"))
