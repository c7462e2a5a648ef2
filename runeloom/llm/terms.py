"""How often, and in how many records, every distinct term occurs.

Blocks of records count their terms with numbers of their own. The distinct terms of all blocks get global
numbers: they are sorted by range, and a term's number is its place. The blocks' counts, encoded with these
numbers, go to the task that holds their range of numbers, where arrays of occurrences and of records are summed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runeloom.llm.words import slices, words
from runeloom.work import materialize, spread

#: Numbers in one range: two arrays of 8 bytes each make 1 MB.
RANGE = 1 << 16
#: Distinct terms, and records, at which a block ends.
BLOCK_TERMS, BLOCK_RECORDS = 200_000, 200_000


class _Block(dict):
    """Terms by their number in the block, and the counts by number."""

    def __init__(self):
        self.occurrences = self.records = np.zeros(0, np.int64)
        self.n = 0

    def __missing__(self, term: str) -> int:
        self[term] = n = len(self)
        return n

    def add(self, texts: list[list[str]]) -> None:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ids = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64, int(lengths.sum()))
        v = len(self)
        once = np.unique(np.repeat(np.arange(len(texts)), lengths) * v + ids) % max(v, 1)
        grow = np.zeros(v - len(self.occurrences), np.int64)
        self.occurrences = np.concatenate([self.occurrences, grow]) + np.bincount(ids, minlength=v)
        self.records = np.concatenate([self.records, grow]) + np.bincount(once, minlength=v)
        self.n += len(texts)

    def rows(self, field: str) -> pa.RecordBatch:
        n = len(self)
        return pa.RecordBatch.from_arrays([pa.array([field] * n), pa.array(list(self), pa.string()), pa.array(self.occurrences), pa.array(self.records)], names=["field", "term", "occurrences", "records"])


_COUNTS = "field string, term string, occurrences bigint, records bigint"


def text_terms(df: DataFrame, text_col: str, field: str) -> DataFrame:
    """Blockwise counts of the words of a text column: (field, term, occurrences, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for b in slices(batches):
            block.add([words(t) for t in b.column(0).to_pylist()])
            if len(block) >= BLOCK_TERMS or block.n >= BLOCK_RECORDS:
                yield block.rows(field)
                block = _Block()
        yield block.rows(field)

    return spread(df.select(text_col).where(F.col(text_col).isNotNull())).mapInArrow(run, _COUNTS)


def map_terms(df: DataFrame, id_col: str, map_col: str, field: str) -> DataFrame:
    """Blockwise counts of the keys of a map column, trimmed and in lower case, one record for each distinct id. Where a record has several rows,
    a key counts as often as in the row that has it most. Null counts are 0; keys that are empty when trimmed are left out."""
    e = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(map_col).alias("key", "n")).repartition("id")
    e = e.groupBy("id", "key").agg(F.max(F.coalesce("n", F.lit(0))).alias("n"))
    e = e.withColumn("term", F.lower(F.regexp_replace("key", r"(?U)^\s+|\s+$", ""))).where("term <> ''").groupBy("id", "term").agg(F.sum("n").cast("bigint").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for b in batches:
            counts = b.column(1).to_numpy(zero_copy_only=False)
            block.add([[t] for t in b.column(0).to_pylist()])
            ids = np.fromiter(map(block.__getitem__, b.column(0).to_pylist()), np.int64, b.num_rows)
            block.occurrences = block.occurrences + np.bincount(ids, weights=counts - 1, minlength=len(block)).astype(np.int64)
            if len(block) >= BLOCK_TERMS:
                yield block.rows(field)
                block = _Block()
        yield block.rows(field)

    return e.select("term", "n").mapInArrow(run, _COUNTS)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = 0
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(n, n + b.num_rows))], names=["field", "term", "part", "place"])
        n += b.num_rows


def dictionary(terms: DataFrame) -> DataFrame:
    """(field, term, number): dense numbers from 0 in the order of (field, term). Written once; only the number of terms of each partition is looked at on the way."""
    d = terms.select("field", "term").distinct().repartitionByRange("field", "term").sortWithinPartitions("field", "term")
    d = materialize(d.withColumn("part", F.spark_partition_id()).mapInArrow(_numbered, "field string, term string, part int, place bigint"), "dictionary")
    sizes = d.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return d.join(F.broadcast(before), "part").select("field", "term", (F.col("before") + F.col("place")).alias("number"))


def _sum_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in the order of their numbers: the sums of one range after another, one range in memory."""
    now, sums = -1, np.zeros((2, RANGE), np.int64)

    def full() -> pa.RecordBatch:
        some = np.flatnonzero(sums[1])
        return pa.RecordBatch.from_arrays([pa.array(some + now * RANGE), pa.array(sums[0][some]), pa.array(sums[1][some])], names=["number", "occurrences", "records"])

    for b in batches:
        number, counts = b.column(0).to_numpy(), (b.column(1).to_numpy(), b.column(2).to_numpy())
        for r in np.unique(number // RANGE).tolist():
            if r != now:
                if now >= 0:
                    yield full()
                now, sums = r, np.zeros((2, RANGE), np.int64)
            lo, hi = np.searchsorted(number, [r * RANGE, (r + 1) * RANGE])
            for k in (0, 1):
                np.add.at(sums[k], number[lo:hi] - r * RANGE, counts[k][lo:hi])
    if now >= 0:
        yield full()


def term_counts(blocks: DataFrame, totals: DataFrame, rare: int = 2, common: float = 0.1) -> DataFrame:
    """(field, term, occurrences, records, mark) for every distinct term of ``blocks``. mark: ``rare`` in at most ``rare`` records, ``common`` in more
    than the share ``common`` of the field's records (``totals``: field, total), unless rare; null otherwise."""
    blocks = materialize(blocks, "blocks")
    numbers = dictionary(blocks)
    coded = blocks.join(numbers, ["field", "term"]).select("number", "occurrences", "records")
    sums = coded.repartition(F.expr(f"number div {RANGE}")).sortWithinPartitions("number").mapInArrow(_sum_ranges, "number bigint, occurrences bigint, records bigint")
    out = sums.join(numbers, "number").join(F.broadcast(totals), "field")
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > common * F.col("total"), "common")
    return out.select("field", "term", "occurrences", "records", mark.alias("mark"))


def total_records(df: DataFrame, field: str, n: Column) -> DataFrame:
    return df.agg(n.alias("total")).select(F.lit(field).alias("field"), "total")
