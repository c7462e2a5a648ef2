"""Connected components of a graph given by its links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runeloom.work import materialize

_EDGE = "u bigint, v bigint"


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a batch's links: each of its nodes points to the smallest of its part. Links within a batch become a forest of stars."""
    for batch in batches:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (p := parent.setdefault(root, root)) != root:
                root = p
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        rows = [(x, r) for x in parent if (r := find(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["u", "v"])


def components(links: DataFrame, src: str, dst: str, max_rounds: int = 50) -> DataFrame:
    """The nodes of ``links`` with the smallest node they are connected to: (node, root), roots included.

    Large-star and small-star rounds in turn: each is an aggregation with partial minima and a join on the
    node, so no part of the graph is gathered anywhere; a hub is a skewed join key, which adaptive execution
    splits. Every round's links are written to the shared folder. Links with a null end and loops of a node
    to itself are left out; no links give no rows.
    """
    e = links.select(F.col(src).cast("bigint").alias("u"), F.col(dst).cast("bigint").alias("v")).where("u is not null and v is not null and u <> v")
    e = materialize(e.mapInArrow(_contract, _EDGE).distinct(), "links")
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.distinct()
        low = small.groupBy("u").agg(F.min("v").alias("m"))
        small = small.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e = materialize(small, "links")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components: no end after {max_rounds} rounds")
