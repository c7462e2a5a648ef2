"""Normal form, hashes and counts of texts, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that a split on Unicode white space removes.
WHITE_SPACE = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def norm_text(text: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends. Null stays null."""
    return F.trim(F.regexp_replace(F.lower(text), WHITE_SPACE, " "))


def norm_key(text: Column) -> Column:
    """The key by which texts are the same: sha1 of the normal form."""
    return F.sha1(norm_text(text))


def word_count(text: Column) -> Column:
    """Words between white space; 0 of a blank text, null of a null."""
    n = norm_text(text)
    return F.when(n == "", 0).when(text.isNotNull(), F.size(F.split(n, " "))).cast("bigint")


def bucket_of(key: Column, buckets: int = 10_000) -> Column:
    """A number below ``buckets`` that the sha1 ``key`` chooses: its first 8 digits as an integer, modulo."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") % buckets


def split_of(text: Column, val_share: float) -> Column:
    """``val`` or ``train``: which split a text is in depends on its normal form alone."""
    return F.when(bucket_of(norm_key(text)) < val_share * 10_000, "val").otherwise("train")


def over_rate(part: Column, whole: Column, cap: float) -> Column:
    """Whether part / whole, rounded to four places, is over ``cap``, in integers: no floating rounding can tip it."""
    return F.lit(20_000) * part > (F.lit(20_000) * F.lit(cap).cast("decimal(10,6)") + 1) * whole


def bag_to_list(counts: Column) -> Column:
    """A map word -> count as the sorted list in which a word occurs count times."""
    return F.array_sort(F.flatten(F.transform(F.map_entries(counts), lambda e: F.array_repeat(e["key"], e["value"].cast("int")))))
