"""Text columns: entities, white space, tokens, previews, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entities that the flat decoder knows, the ampersand last.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
#: Fixed value: white space, with the no-break space.
SPACE = "[ \\t\\n\\r\\f\\x0B\\x{00A0}]+"


def decode_entities(s: Column) -> Column:
    for name, value in ENTITIES:
        s = F.replace(s, F.lit(name), F.lit(value))
    return s


def fold(s: Column) -> Column:
    """Entities decoded, white space made one space, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(decode_entities(s), SPACE, " ")))


def tokenize(s: Column) -> Column:
    """Lower-case runs of letters and digits, two long or more."""
    return F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}\p{Nd}]{2,}"), F.lit(0))


def word_count(s: Column) -> Column:
    f = fold(s)
    return F.when(f == "", 0).otherwise(F.size(F.split(f, " ")))


def preview(s: Column, n: int) -> Column:
    flat = F.trim(F.regexp_replace(s, "[\\r\\n]+", " "))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("…"))).otherwise(flat)


def fnv1a(token: Column) -> Column:
    """FNV-1a, 64 bits, over the low byte of each UTF-16 unit.  The product runs in halves, as a bigint that overflows is an error."""
    # Each byte as a letter; each second one is a low byte.
    letters = F.split(F.decode(F.encode(token, "UTF-16BE"), "ISO-8859-1"), "")
    low = F.transform(F.filter(letters, lambda _, i: i.bitwiseAND(1) == 1), lambda c: F.ascii(c).cast("bigint"))
    mask = F.lit(0xFFFFFFFF).cast("bigint")

    def step(h: Column, b: Column) -> Column:
        x = h.bitwiseXOR(b)
        lo = x.bitwiseAND(mask) * 435
        hi = F.shiftrightunsigned(x, 32) * 435 + F.shiftleft(x.bitwiseAND(mask), 8) + F.shiftrightunsigned(lo, 32)
        return F.shiftleft(hi, 32).bitwiseOR(lo.bitwiseAND(mask))

    return F.aggregate(low, F.lit(-3750763034362895579).cast("bigint"), step)
