"""Shard records: JSON lines in, JSON lines and Parquet shards out."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "id STRING, en STRING, kz STRING, words INT, loans INT, loan_rate DOUBLE, unknown INT, names INT, loan_words ARRAY<STRING>"


def parse_records(df: DataFrame, line_col: str) -> DataFrame:
    """``df`` with the fields of the JSON objects in its lines; lines that aren't one whole JSON object are left out, missing fields are null."""
    v = F.try_parse_json(F.concat(F.lit("["), F.col(line_col), F.lit("]")))
    x = df.withColumn("__v", F.when(F.try_variant_get(v, "$[1]", "variant").isNull(), F.try_variant_get(v, "$[0]", "variant")))
    x = x.where(F.col("__v").isNotNull() & F.schema_of_variant("__v").startswith("OBJECT"))
    fields = [f.rsplit(" ", 1) for f in RECORD.split(", ")]
    return x.select(*df.columns, *[F.try_variant_get("__v", f"$.{n}", t).alias(n) for n, t in fields if n not in df.columns])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Shard files as a table with a fixed schema, and the place of each record: the number at the end of its id."""
    return spark.read.schema(RECORD).json(path).withColumn("ordinal", F.regexp_extract("id", r"(\d+)$", 1).cast("bigint"))


def write_shards(df: DataFrame, path: str, shard_col: str = "shard", mode: str = "errorifexists") -> None:
    """JSON lines in one folder for each shard; a shard is written as a whole or not at all. ``mode``: with ``overwrite`` and dynamic partitions only the shards at hand are replaced."""
    df.repartition(F.col(shard_col)).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(shard_col).json(path)


def missing_shards(df: DataFrame, done: DataFrame, shard_col: str = "shard") -> DataFrame:
    """Rows of shards that aren't there yet or hold fewer rows than they should: what a resumed run has to do, told from the data."""
    have = done.groupBy(shard_col).agg(F.count(F.lit(1)).alias("n"))
    want = df.groupBy(shard_col).agg(F.count(F.lit(1)).alias("w"))
    todo = want.join(have, shard_col, "left").where("n is null or n < w").select(shard_col)
    return df.join(F.broadcast(todo), shard_col, "left_semi")


def write_parquet_shards(df: DataFrame, path: str, text_col: str, split_col: str | None = None, rows_per_file: int = 100_000, mode: str = "errorifexists") -> None:
    """Files of one column ``text``, at most ``rows_per_file`` rows each, row groups of 1,024 rows, zstd; a folder for each split."""
    cols = [F.col(text_col).alias("text")] + ([F.col(split_col)] if split_col else [])
    w = df.select(*cols).write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).option("parquet.block.row.count.limit", 1024)
    (w.partitionBy(split_col) if split_col else w).parquet(path)


def write_parallel(df: DataFrame, path: str, split_col: str, mode: str = "errorifexists") -> None:
    """{id, en, kz} lines in a folder for each split."""
    df.select("id", "en", "kz", split_col).write.mode(mode).partitionBy(split_col).json(path)


def _file(spark: SparkSession, path: str):
    """(file system, path) of any file system that Spark can reach."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file, as a whole."""
    fs, p = _file(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, written beside its place and then put there."""
    fs, p = _file(spark, path)
    tmp = p.suffix(".tmp")
    stream = fs.create(tmp, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    fs.delete(p, False)
    fs.rename(tmp, p)


def write_manifest(spark: SparkSession, path: str, content: dict) -> None:
    """A JSON file beside the data; ``content`` comes from aggregates of the data itself."""
    write_text(spark, path, json.dumps(content | {"written": datetime.now(timezone.utc).isoformat()}, indent=1, ensure_ascii=False))


def markdown_table(df: DataFrame, limit: int) -> list[str]:
    """The first ``limit`` rows of a small, ordered result as Markdown."""
    rows = df.limit(limit).collect()
    return [f"| {' | '.join(df.columns)} |", "|" + "---|" * len(df.columns), *[f"| {' | '.join('' if v is None else f'{v:,}' if isinstance(v, int) else str(v) for v in r)} |" for r in rows]]
