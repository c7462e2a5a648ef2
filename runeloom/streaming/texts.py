"""Streams of records through the same column functions. An extension: the batch operators are the reference.

In a stream "the first" of equal texts is the first to arrive within the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runeloom.functions.text import norm_key, over_rate, split_of


def read_table_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A growing folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def pack_stream(df: DataFrame, text_col: str, time_col: str, late: str = "1 hour", max_loan_rate: float = 0.05, min_words: int = 20, val_share: float = 0.05) -> DataFrame:
    """Records (unknown_n, loans, words) that pass the filters, each text once within the watermark, with their split. The state is keys only, and is dropped as the watermark passes."""
    x = df.where((F.col("unknown_n") == 0) & ~over_rate(F.col("loans"), F.col("words"), max_loan_rate) & (F.col("words") >= min_words) & F.col(text_col).isNotNull())
    x = x.withColumn("norm_sha1", norm_key(F.col(text_col))).withColumn("pack_split", split_of(F.col(text_col), val_share))
    return x.withWatermark(time_col, late).dropDuplicatesWithinWatermark(["norm_sha1"])


def loan_rate_windows(df: DataFrame, time_col: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Stories, words, loans and loan rate of each window of time."""
    w = df.withWatermark(time_col, late).groupBy(F.window(time_col, width).alias("w")).agg(F.count(F.lit(1)).alias("stories"), F.sum("words").alias("words"), F.sum("loans").alias("loans"))
    return w.select(F.col("w.start").alias("start"), "stories", "words", "loans", (F.col("loans") / F.greatest("words", F.lit(1))).alias("loan_rate"))


def run_to_memory(df: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over what is there now into a table in memory; for tests."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
