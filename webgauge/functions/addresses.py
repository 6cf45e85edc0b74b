"""IP addresses as column expressions: 32 nibbles or 128 bits whatever the spelling, lookup names of blocklists, network prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .urls import let

V4 = r"^(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}$"
GROUPS = r"^([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?$"


def _quads(ip: Column) -> Column:
    """A dotted address as two groups of four nibbles."""
    n = lambda k: F.lpad(F.lower(F.hex(F.get(F.split(ip, r"\."), F.lit(k)).try_cast("int"))), 2, "0")
    return F.concat(n(0), n(1), F.lit(":"), n(2), n(3))


def nibbles(ip: Column) -> Column:
    """The 32 nibbles of an address in lower case: IPv6 in any spelling, also with a dotted end, IPv4 as ::ffff:a.b.c.d.  Null where it is no address."""
    text = F.lower(F.trim(ip))
    v6 = F.when(text.rlike(V4), F.concat(F.lit("::ffff:"), _quads(text))).when(F.regexp_extract(text, r":([0-9.]+)$", 1).rlike(V4), F.concat(F.regexp_extract(text, r"^(.*:)[0-9.]+$", 1), _quads(F.regexp_extract(text, r":([0-9.]+)$", 1)))).otherwise(text)

    def written(a: Column) -> Column:
        twice = a.contains("::")
        left, right = F.when(twice, F.substring_index(a, "::", 1)).otherwise(a), F.when(twice, F.regexp_replace(a, "^.*?::", "")).otherwise("")
        groups = lambda s: F.filter(F.split(s, ":"), lambda g: g != "")
        n = F.size(groups(left)) + F.size(groups(right))
        good = a.contains(":") & left.rlike(GROUPS) & right.rlike(GROUPS) & F.when(twice, n < 8).otherwise(n == 8)
        zeros = F.array_repeat(F.lit("0"), F.greatest(8 - n, F.lit(0)))
        whole = F.array_join(F.transform(F.concat(groups(left), zeros, groups(right)), lambda g: F.lpad(g, 4, "0")), "")
        return F.when(good, whole)

    return let(v6, written)


def bits(ip: Column) -> Column:
    """The 128 bits of an address as a string of zeros and ones."""
    half = lambda s: F.lpad(F.conv(s, 16, 2), 64, "0")
    return let(nibbles(ip), lambda n: F.concat(half(F.substring(n, 1, 16)), half(F.substring(n, 17, 16))))


def lookup_name(ip: Column, zone: Column) -> Column:
    """What a blocklist is asked for: octets in reverse before the zone, of IPv6 nibbles in reverse.  Null where it is no address."""
    text = F.trim(ip)
    four = F.array_join(F.reverse(F.split(text, r"\.")), ".")
    six = F.array_join(F.split(F.reverse(nibbles(text)), ""), ".")
    return F.concat(F.when(text.rlike(V4), four).otherwise(F.regexp_replace(six, r"\.$", "")), F.lit("."), zone)


def networks(ranges: DataFrame) -> DataFrame:
    """ranges(cidr, ...) with `length` and `prefix`: that many first bits.  Those that are no network go."""
    text, size = F.substring_index("cidr", "/", 1), F.regexp_extract("cidr", r"/([0-9]{1,3})$", 1).try_cast("int")
    length = F.when(F.trim(text).rlike(V4), size + 96).otherwise(size)
    known = ranges.withColumn("length", length).withColumn("bits", bits(text))
    return known.where(F.col("bits").isNotNull() & F.col("length").between(0, 128)).withColumn("prefix", F.expr("substring(bits, 1, length)")).drop("bits")


def in_networks(ips: DataFrame, ranges: DataFrame, *values: str) -> DataFrame:
    """Distinct addresses of ips(ip) with the values of the longest of ranges(cidr, values) that they lie in; those in none have nulls.

    An address is asked for by each length that the ranges have, 129 at most, and meets them by equality: no comparison of ranges.  Networks that
    occur twice count with the smallest values.
    """
    known = networks(ranges).groupBy("length", "prefix").agg(F.min(F.struct(*values)).alias("v"))
    lengths = F.array(*(F.lit(r.length) for r in known.select("length").distinct().orderBy("length").collect()))
    rows = ips.select("ip").distinct().withColumn("bits", bits(F.col("ip")))
    asked = rows.select("ip", "bits", F.explode(lengths.cast("array<int>")).alias("length")).select("ip", "length", F.expr("substring(bits, 1, length)").alias("prefix"))
    best = asked.join(known.hint("shuffle_merge"), ["length", "prefix"]).groupBy("ip").agg(F.max_by("v", "length").alias("v"))
    return rows.select("ip").join(best.hint("shuffle_merge"), "ip", "left").select("ip", *(F.col(f"v.{c}").alias(c) for c in values))
