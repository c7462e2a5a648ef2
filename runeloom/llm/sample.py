"""A reproducible sample that keeps what it chose when the collection grows: randomised block selection.

Every unit (all rows of one id) has a persistent sequence number, the one of its first row. Sequence numbers
fall into blocks of 2**BITS; the hash of a block's number seeds a permutation of its positions, and the
positions that it maps below ``per_block`` are the chosen ones, whether or not a record has them yet. So a
record's fate depends on its number and the seed alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runeloom.llm.verify import asked_only

#: Size of a block as a power of two.
BITS = 10


def permuted(seq: Column, seed: int, bits: int = BITS) -> Column:
    """Where the permutation of its block puts a sequence number: three rounds of odd multiplication, addition and shift-xor, each a bijection of the block's positions, with keys from the hash of (seed, block)."""
    low = (1 << bits) - 1
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.shiftright(seq, bits).cast("string"))), 1, 15), 16, 10).cast("bigint")
    p = seq.bitwiseAND(F.lit(low).cast("bigint"))
    for r in range(3):
        k = F.shiftright(h, 20 * r)
        p = (p * (k.bitwiseAND(F.lit(low).cast("bigint")) * 2 + 1) + F.shiftright(k, bits)).bitwiseAND(F.lit(low).cast("bigint"))
        p = p.bitwiseXOR(F.shiftright(p, bits // 2))
    return p


def block_sample(df: DataFrame, id_col: str, text_col: str, seq_col: str, order_col: str, per_block: int, seed: int = 1, bits: int = BITS) -> DataFrame:
    """The rows of the chosen units, with all their columns.

    A unit is all rows with one ``id_col``; rows without an id belong together where ``text_col`` is equal, and
    a row with neither is a unit of its own. Its sequence number is ``seq_col`` of its first row in the order of
    (``order_col``, ``seq_col``), nulls last: rows of later deliveries don't change it. Rows with a null
    ``seq_col`` are never chosen. Units are aggregated with partial minima; rows meet the chosen units in a
    semi join, in which adaptive execution splits an id that holds many rows; a bitmap of fixed size keeps nearly all other rows, and their texts, out of its shuffle."""
    unit = F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.concat(F.lit("t"), F.md5(F.col(text_col))), F.concat(F.lit("s"), F.col(seq_col).cast("string")))
    first = F.min(F.struct(F.col(order_col).isNull().alias("n"), F.col(order_col).alias("o"), F.col(seq_col).alias("s")))
    units = df.where(F.col(seq_col).isNotNull()).groupBy(unit.alias("__unit")).agg(first.alias("f"))
    chosen = units.where(permuted(F.col("f.s"), seed, bits) < per_block).select("__unit")
    name = "unit"
    chosen = chosen.select(F.col("__unit").alias(name), F.xxhash64("__unit").alias("key"))
    rows = df.where(F.col(seq_col).isNotNull()).select(F.struct(*[F.col(c) for c in df.columns]).alias("row"), unit.alias(name)).withColumn("key", F.xxhash64(name))
    # an inner join with distinct units: a semi join would be moved below the bitmap and shuffle every row
    return asked_only(rows, chosen.select("key")).join(chosen.select(name), name).select("row.*")


def sample_sql(source: str, columns: str, id_col: str, text_col: str, seq_col: str, order_col: str, per_block: int, seed: int = 1, bits: int = BITS) -> str:
    """The same in DuckDB."""
    low, p, steps = (1 << bits) - 1, f"(s & {(1 << bits) - 1})", []
    for r in range(3):
        k = f"(h >> {20 * r})"
        steps.append((f"q{r}", f"(({p} * ((({k}) & {low}) * 2 + 1) + ({k} >> {bits})) & {low})"))
        p = f"xor(q{r}, q{r} >> {bits // 2})"
    inner = f"SELECT *, ('0x' || substr(md5('{seed}:' || (s >> {bits})::VARCHAR), 1, 15))::BIGINT AS h FROM units"
    for name, e in steps:
        inner = f"SELECT *, {e} AS {name} FROM ({inner})"
    unit = f"coalesce('i' || {id_col}::VARCHAR, 't' || md5({text_col}), 's' || {seq_col}::VARCHAR)"
    return f"""WITH src AS (SELECT *, {unit} AS unit FROM {source} WHERE {seq_col} IS NOT NULL),
ranked AS (SELECT unit, {seq_col} AS s, row_number() OVER (PARTITION BY unit ORDER BY {order_col} ASC NULLS LAST, {seq_col}) AS rn FROM src),
units AS (SELECT unit, s FROM ranked WHERE rn = 1),
chosen AS (SELECT unit FROM ({inner}) WHERE {p} < {per_block})
SELECT {columns} FROM src WHERE unit IN (SELECT unit FROM chosen)"""
