"""From translated records to a corpus: filters, first-wins dedupe, split, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runeloom.functions.text import norm_key, over_rate, split_of


def first_of_each(df: DataFrame, key: Column, order_col: str) -> DataFrame:
    """The row with the smallest ``order_col`` of each key, with all columns. Rows with a null key or order are left out.

    Only key and order are aggregated, with partial minima, so neither texts nor a key that a third of the rows share
    gather in one task; the survivors' orders, which are unique, then pick the rows in a semi join."""
    first = df.select(key.alias("k"), F.col(order_col).alias("o")).where("k is not null and o is not null").groupBy("k").agg(F.min("o").alias(order_col))
    return df.join(first.select(order_col), order_col, "left_semi")


def dedupe(df: DataFrame, text_col: str, order_col: str) -> DataFrame:
    """Exact duplicates by normal form; the first in order stays. ``order_col`` must be unique."""
    return first_of_each(df, norm_key(F.col(text_col)), order_col)


def shard_of(order: Column, size: int) -> Column:
    """The shard of a row by its place alone: shards don't depend on workers or partitions."""
    return F.floor(order / size).cast("bigint")


def first_failure(unknown: Column, loans: Column, words: Column, max_loan_rate: float, min_words: int) -> Column:
    """The first test that a record fails, or null."""
    return F.when(unknown > 0, "unknown tokens").when(over_rate(loans, words, max_loan_rate), "loan rate").when(words < min_words, "too short")


def drop_reasons(df: DataFrame, text_col: str, order_col: str, unknown: Column, loans: Column, words: Column, max_loan_rate: float = 0.05, min_words: int = 20) -> DataFrame:
    """``df`` with the column ``reason``: why a record is dropped, null where it is kept. Only records that pass the other tests can be
    duplicates, of the first of them. Counts that are null pass their test; a null text has no duplicates."""
    # whether there is a text is told before the join, so that texts take part in its shuffle only where the caller wants them
    x = df.withColumn("reason", first_failure(unknown, loans, words, max_loan_rate, min_words)).withColumn("__text", F.col(text_col).isNotNull())
    first = x.where("reason is null").select(norm_key(F.col(text_col)).alias("k"), F.col(order_col).alias("o")).where("k is not null").groupBy("k").agg(F.min("o").alias("__keep")).select("__keep", F.lit(True).alias("__first"))
    x = x.join(first, F.col(order_col) == F.col("__keep"), "left").drop("__keep")
    dup = F.col("reason").isNull() & F.col("__first").isNull() & F.col("__text")
    return x.withColumn("reason", F.when(dup, "duplicate").otherwise(F.col("reason"))).drop("__first", "__text")


def pack(df: DataFrame, text_col: str, order_col: str, unknown: Column, loans: Column, words: Column, max_loan_rate: float = 0.05, min_words: int = 20, val_share: float = 0.05) -> DataFrame:
    """The records that are kept, with the column ``pack_split`` (train or val), which is told before the join: who counts only moves no texts."""
    x = df.withColumn("pack_split", split_of(F.col(text_col), val_share))
    return drop_reasons(x, text_col, order_col, unknown, loans, words, max_loan_rate, min_words).where("reason is null").drop("reason")


def pack_counts(packed: DataFrame, chars: Column, loans: Column, words: Column) -> DataFrame:
    """Per split: stories, words, characters of the target text, loans. ``chars`` should be a column made before packing, see ``pack``."""
    return packed.groupBy("pack_split").agg(F.count(F.lit(1)).alias("stories"), F.sum(words).alias("words"), F.sum(chars).alias("chars"), F.sum(loans).alias("loans"))


def shard_stats(df: DataFrame, order_col: str, size: int, words: Column, loans: Column, unknown: Column) -> DataFrame:
    """Per shard: stories, words, loans, unknown words."""
    return df.groupBy(shard_of(F.col(order_col), size).alias("shard")).agg(F.count(F.lit(1)).alias("stories"), F.sum(words).alias("words"), F.sum(loans).alias("loans"), F.sum(unknown).alias("unknown"))


def run_summary(df: DataFrame, words: Column, loans: Column, unknown: Column) -> DataFrame:
    """One row for the whole run, with the loan rate (0 without words)."""
    s = df.agg(F.count(F.lit(1)).alias("stories"), F.coalesce(F.sum(words), F.lit(0)).alias("words"), F.coalesce(F.sum(loans), F.lit(0)).alias("loans"), F.coalesce(F.sum(unknown), F.lit(0)).alias("unknown"))
    return s.withColumn("loan_rate", F.col("loans") / F.greatest("words", F.lit(1)))


def top_words(df: DataFrame, counts_col: str, k: int) -> DataFrame:
    """The k most frequent keys of a map column word -> count; ties in the order of the words."""
    return df.select(F.explode(counts_col).alias("word", "n")).groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(k)


def rate_histogram(df: DataFrame, loans: Column, words: Column) -> DataFrame:
    """Stories by loan rate in hundredths, 20 and above together; the rate is rounded half up, in integers."""
    pct = F.least(F.lit(20), F.when(words > 0, F.floor((loans * 200 + words) / (words * 2))).otherwise(0))
    return df.groupBy(pct.cast("bigint").alias("percent")).agg(F.count(F.lit(1)).alias("stories"))
