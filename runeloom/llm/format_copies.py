"""Copies hidden by format: canonical text, 128-bit hash, counts with map-side combining, collision checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runeloom.work import materialize


def canonical(text: Column) -> Column:
    """Lower case, letters and digits only; null where nothing is left. Other characters are not folded."""
    return F.nullif(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", ""), F.lit(""))


def canonical_record(fields: dict[str, Column]) -> Column:
    """One canonical text of a record of several fields, whatever order they are given in: the fields' canonical texts by name. Null where all are empty."""
    parts = [F.coalesce(canonical(fields[k]), F.lit("")) for k in sorted(fields)]
    return F.when(F.coalesce(*[F.nullif(p, F.lit("")) for p in parts]).isNotNull(), F.concat_ws("\x1f", *parts))


def canonical_object(line: Column) -> Column:
    """One canonical text of a JSON object with any fields: names and values canonical, in the order of the names; values that are empty count as absent.
    Null where the line isn't an object or nothing is left."""
    pairs = F.transform(F.map_entries(F.from_json(line, "map<string,string>")), lambda e: F.struct(F.coalesce(canonical(e["key"]), F.lit("")).alias("k"), canonical(e["value"]).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda e: e["v"].isNotNull()))
    return F.nullif(F.array_join(F.transform(kept, lambda e: F.concat(e["k"], F.lit("\x1e"), e["v"])), "\x1f"), F.lit(""))


def json_field(line: Column, field: str) -> Column:
    """A field of a line that is one whole JSON object; null where the line doesn't parse, holds more than one value, repeats a key or lacks the field.
    The order and layout of the object's fields don't matter; a number counts as its text. (The parser stops after the first value, so the line is put into an array, which must end.)"""
    v = F.try_parse_json(F.concat(F.lit("["), line, F.lit("]")))
    return F.when(F.try_variant_get(v, "$[1]", "variant").isNull(), F.try_variant_get(v, f"$[0].{field}", "string"))


def keyed(df: DataFrame, no_col: str, text: Column, record: bool = False) -> DataFrame:
    """(no, key, check): the 128-bit hash of the canonical text, and a second, independent hash with its length. With ``record``, ``text`` is a record's
    canonical text already (``canonical_record``, ``canonical_object``) and hashed as it is, marks between fields included."""
    c = df.select(F.col(no_col).cast("bigint").alias("no"), (text if record else canonical(text)).alias("c")).where("c is not null and no is not null")
    return c.select("no", F.unhex(F.md5("c")).alias("key"), F.xxhash64("c", F.length("c")).alias("check"))


def copy_counts(df: DataFrame, no_col: str, text: Column, record: bool = False) -> DataFrame:
    """One row for each distinct canonical text: (key, check, first_no, copies, collided). Two texts are one only if both hashes
    agree; ``collided`` tells that the 128-bit hash alone would have merged different texts. Null and empty texts and rows
    without a number are left out. Partial counts are made before the shuffle, so a text that holds a third of the rows is a few rows there."""
    g = keyed(df, no_col, text, record).groupBy("key", "check").agg(F.min("no").alias("first_no"), F.count(F.lit(1)).alias("copies"))
    by_key = g.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.lit(True).alias("collided"))
    return g.join(by_key, "key", "left").withColumn("collided", F.coalesce("collided", F.lit(False)))


def copies_of_first(df: DataFrame, no_col: str, text: Column, record: bool = False) -> DataFrame:
    """(first_no, copy_no) for each copy but the first. Only texts with copies go to the join's small side; a text that very many
    rows share is a skewed key of the join, which adaptive execution splits."""
    rows = materialize(keyed(df, no_col, text, record), "keys")  # 40 bytes a row, so that texts are read and canonicalized once
    many = rows.groupBy("key", "check").agg(F.min("no").alias("first_no"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(many, ["key", "check"]).where("no > first_no").select("first_no", F.col("no").alias("copy_no"))
