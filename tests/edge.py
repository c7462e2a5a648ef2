"""Tables for edge cases, made of the test tables' schemas."""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tests.compare import SF


def _odd(df: DataFrame) -> DataFrame:
    """Some rows, each twice, the same with a null in one column after the other, a row of nulls, and a column more."""
    some = df.limit(6).cache()
    one = some.limit(2)
    nulls = [one.withColumn(c, F.lit(None).cast(df.schema[c].dataType)) for c in df.columns]
    none = one.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
    return reduce(DataFrame.unionByName, [some, some, *nulls, none])


def make(spark: SparkSession, to: Path, kind: str) -> str:
    """``empty``: no rows anywhere but in the fixed table of limits; ``odd``: see above, with columns named like those that operators make."""
    for p in Path(SF).glob("*.parquet"):
        df = spark.read.parquet(str(p))
        if p.stem == "size_limits":
            out = df
        elif kind == "empty":
            out = df.limit(0)
        else:
            out = _odd(df)
            for c in ("key", "cls", "n", "a", "b", "reason", "__unit", "form", "word", "rank"):
                out = out if c in df.columns else out.withColumn(c, F.lit("clash"))
        out.coalesce(1).write.parquet(f"{to}/{p.name}")
    return str(to)
