"""Exact comparison of candidate pairs by their sets of word sequences."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runeloom.llm.words import shingles, slices, words

#: Bits of the filter that keeps texts nobody asks for out of the shuffle: 8 MB at most, whatever the data.
FILTER_BITS = 1 << 26


def long_texts(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """One row for each non-null text: (key, text); key = id * number of fields + index of the field."""
    n = len(fields)
    items = F.array(*[F.struct((F.col(id_col) * n + i).alias("key"), F.col(f).alias("text")) for i, f in enumerate(fields)])
    return df.select(F.explode(items).alias("x")).select("x.key", "x.text").where("text is not null and key is not null")


def asked_only(texts: DataFrame, need: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose key may be in ``need``: a broadcast bitmap of fixed size over the keys modulo its bits.
    Rows passed by chance are dropped by the join that follows."""
    at = lambda c: F.pmod(F.col(c), F.lit(FILTER_BITS)).cast("bigint")
    bits = need.select(at("key").alias("h")).groupBy(F.expr("bitmap_bucket_number(h + 1)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(h + 1))").alias("bits"))
    t = texts.withColumn("h", at("key")).withColumn("bucket", F.expr("bitmap_bucket_number(h + 1)"))
    byte = F.expr("cast(conv(hex(substring(bits, cast(bitmap_bit_position(h + 1) div 8 as int) + 1, 1)), 16, 10) as int)")
    return t.join(F.broadcast(bits), "bucket").where(byte.bitwiseAND(F.expr("shiftleft(1, cast(bitmap_bit_position(h + 1) % 8 as int))")) != 0).select(*texts.columns)


def _compare(size: int, least_words: int, threshold: tuple[int, int]):
    num, den = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets: dict[str, tuple[int, set[int]]] = {}
            texts = list(dict.fromkeys(b.column("ta").to_pylist() + b.column("tb").to_pylist()))
            split = [words(t) for t in texts]
            hashes, at = shingles(split, size)
            all_, at = hashes.tolist(), at.tolist()
            for i, t in enumerate(texts):
                sets[t] = (len(split[i]), set(all_[at[i] : at[i + 1]]))
            keep, shared, either = [], [], []
            for i, (x, y) in enumerate(zip(b.column("ta").to_pylist(), b.column("tb").to_pylist())):
                (n, s), (m, t) = sets[x], sets[y]
                both = len(s & t)
                if min(n, m) >= least_words and both * den >= num * (u := len(s) + len(t) - both) and u:
                    keep.append(i)
                    shared.append(both)
                    either.append(u)
            rows = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column("a"), rows.column("b"), pa.array(shared, pa.int32()), pa.array(either, pa.int32())], names=["a", "b", "shared", "either"])

    return run


def verify(pairs: DataFrame, texts: DataFrame, size: int = 3, least_words: int = 8, threshold: tuple[int, int] = (3, 5)) -> DataFrame:
    """The pairs (a, b) of text keys whose sets of ``size``-word sequences have at least ``threshold`` (a fraction) in common:
    (a, b, shared, either). Only the texts that some pair names are shuffled."""
    need = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    t = asked_only(texts, need)
    j = pairs.select("a", "b").join(t.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a")
    j = j.join(t.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    return j.mapInArrow(_compare(size, least_words, threshold), "a bigint, b bigint, shared int, either int")
