"""Ranks and running sums over a whole table without a window in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runeloom.work import materialize


def ranked(df: DataFrame, *order: Column | str, total: str | None = None) -> DataFrame:
    """``df`` with ``rank`` (from 1, in ``order``, which should leave no ties) and, where ``total`` names a column, with ``running``, its sum up to the row.

    Rows are put in order by range; each range is numbered for itself and starts after what the ranges before it hold. Only the ranges' sizes meet in one task."""
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    value = F.coalesce(F.col(total), F.lit(0)) if total else F.lit(0)
    p = df.withColumn("__v", value).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    p = materialize(p, "ranked")
    sizes = p.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.sum("__v").alias("v"))
    upto = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("__part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("__n"), F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("__s"))
    own = Window.partitionBy("__part").orderBy(*order)
    x = p.join(F.broadcast(before), "__part").withColumn("rank", (F.row_number().over(own) + F.col("__n")).cast("bigint"))
    x = x.withColumn("running", F.sum("__v").over(own.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__s")) if total else x
    return x.drop("__part", "__n", "__s", "__v")
