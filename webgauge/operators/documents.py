"""Answers whose shape isn't fixed, as VARIANT values: page speed and RDAP without a schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hosts import AUDITS, parse_date


def _double(v: str, path: str) -> Column:
    return F.try_variant_get(v, path, "double")


def pagespeed_results(observations: DataFrame) -> DataFrame:
    """hosts.pagespeed_results of observations(host, strategy, url, psi_json) without a fixed schema, and with `shape`: what the performance category looks like.

    A number that comes as text counts; a member that is missing or something else is null and leaves the others alone; an answer that isn't a JSON object has failed.
    """
    read = observations.withColumn("v", F.try_parse_json("psi_json"))
    light = "$.lighthouseResult"
    success = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    score = F.round(_double("v", f"{light}.categories.performance.score") * 100).cast("int")
    audits = [_double("v", f"{light}.audits['{a}'].numericValue").alias(c) for a, c in AUDITS.items()]
    out = read.select("host", "strategy", "url", success.alias("success"), score.alias("score"), *audits, F.try_variant_get("v", f"{light}.finalUrl", "string").alias("final_url"), F.schema_of_variant(F.try_variant_get("v", f"{light}.categories.performance", "variant")).alias("shape"))
    code = F.when(~F.col("success"), "PSI_FAILED").when(F.col("score") < 50, "PSI_SCORE_LOW").when(F.col("score") < 90, "PSI_SCORE_NEEDS_IMPROVEMENT")
    return out.withColumn("code", F.concat("strategy", F.lit("_"), code))


def rdap_dates(domains: DataFrame) -> DataFrame:
    """(host, created, expires, country, shape) of domains(host, json): the first registration and expiration that have a date, whatever else the events hold, the first
    two-letter country of four places, and the shape of the events."""
    v = domains.withColumn("v", F.try_parse_json("json"))
    events = F.try_variant_get("v", "$.events", "array<variant>")
    text = lambda e, path: F.try_variant_get(e, path, "string")

    def first(action: str) -> Column:
        dates = F.transform(F.filter(events, lambda e: F.lower(text(e, "$.eventAction")) == action), lambda e: parse_date(text(e, "$.eventDate")))
        return F.get(F.filter(dates, lambda d: d.isNotNull()), F.lit(0))

    entities = F.transform(F.coalesce(F.try_variant_get("v", "$.entities", "array<variant>"), F.array().cast("array<variant>")), lambda e: text(e, "$.country"))
    places = F.concat(F.array(*(text("v", f"$.{k}") for k in ("country", "countryCode", "cc"))), entities)
    country = F.upper(F.get(F.filter(places, lambda c: F.length(c) == 2), F.lit(0)))
    return v.select("host", first("registration").alias("created"), first("expiration").alias("expires"), country.alias("country"), F.schema_of_variant(F.try_variant_get("v", "$.events", "variant")).alias("shape"))
