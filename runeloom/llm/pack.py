"""Containers of fixed capacity filled with items by vector best-fit.

An item is a vector of tokens, one document and its attention cost (tokens squared). It goes, in the order of
falling size, to the open container whose residual capacities it leaves smallest (weighted squared norm of what
would remain, each part by its capacity), among those where every part fits; else a new one is opened. Each of the
three capacities can bind: a container of many short texts is full by documents, one that a long text nearly fills
is full by cost before its last tokens are used. An item whose cost alone is over that capacity has a container of its own.
Items are packed in shards of about SHARD items, which their ids choose; a shard's last, half-filled containers
are what that costs, one or two of thousands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runeloom.llm.tokens import TOKENIZER, broadcast_ranks, tokenizer
from runeloom.work import materialize, spread

SHARD = 8192
#: Weights of tokens, documents and attention cost in the residual norm.
WEIGHTS = (1.0, 0.01, 0.05)
#: Documents that a container holds at most, and its attention cost at most as a share of that of one text that fills it.
MAX_DOCS, COST_SHARE = 32, 0.95


def best_fit(sizes: np.ndarray, capacity: int, max_docs: int = MAX_DOCS, max_cost: float | None = None) -> np.ndarray:
    """The container of each item; sizes are from 1 to ``capacity`` and fall. An item that costs more than ``max_cost`` (COST_SHARE of capacity**2 by default) is alone in its container."""
    max_cost = COST_SHARE * capacity * capacity if max_cost is None else max_cost
    n = len(sizes)
    out = np.empty(n, dtype=np.int64)
    left = np.empty((3, n + 1))  # residuals of the open containers, one column each
    name = np.empty(n + 1, dtype=np.int64)
    open_, made = 0, 0
    smallest = int(sizes[-1]) if n else 0
    scale = np.array([capacity, max_docs, max_cost], dtype=float)
    full, w = np.ones(3), np.array(WEIGHTS)
    least = np.array([smallest, 1, smallest * smallest]) / scale
    for i, t in enumerate(sizes.tolist()):
        need = np.array([t, 1, t * t]) / scale
        r = left[:, :open_]
        fits = np.flatnonzero((r >= need[:, None] - 1e-12).all(axis=0)) if open_ else np.zeros(0, int)
        if len(fits):
            rest = r[:, fits] - need[:, None]
            k = fits[np.argmin(w @ (rest * rest))]
            left[:, k] -= need
        else:
            k = open_
            left[:, k], name[k] = full - need, made
            open_, made = open_ + 1, made + 1
        out[i] = name[k]
        if (left[:, k] < least - 1e-12).any():  # nothing that comes can fit
            open_ -= 1
            left[:, k], name[k] = left[:, open_], name[open_]
    return out


def token_counts(df: DataFrame, id_col: str, text_col: str, path: str = TOKENIZER) -> DataFrame:
    """(id, tokens) of every row; a null or empty text has 0 tokens."""
    ranks = broadcast_ranks(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(ranks.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([tok.count(t) for t in b.column(1).to_pylist()], pa.int64())], names=["id", "tokens"])

    return spread(df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, "id bigint, tokens bigint")


def _pack(max_docs: int, cost_share: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "id", "piece"], ascending=[False, True, True], kind="stable")
        capacity, shard, name = int(pdf["capacity"].iloc[0]), int(pdf["shard"].iloc[0]), pdf["limit_name"].iloc[0]
        where = best_fit(pdf["size"].to_numpy(), capacity, max_docs, cost_share * capacity * capacity)
        return pd.DataFrame({"limit_name": name, "capacity": capacity, "container": [f"{name}-{shard}-{c}" for c in where], "id": pdf["id"].to_numpy(), "piece": pdf["piece"].to_numpy(), "tokens": pdf["size"].to_numpy()})

    return run


def containers(df: DataFrame, id_col: str, text_col: str, limits: list[tuple[str, int]], path: str = TOKENIZER, max_docs: int = MAX_DOCS, cost_share: float = COST_SHARE) -> DataFrame:
    """(limit_name, capacity, container, id, piece, tokens): every text assigned to containers of every capacity of ``limits`` (name, capacity).

    A text that fits an empty container is one item (piece 0). A longer one fills containers of its own as often as it can; what is left of it is
    an item. A container holds at most ``capacity`` tokens and ``max_docs`` items, and with more than one item at most the attention cost
    ``cost_share`` * capacity**2. Texts without tokens (null, empty) have the container null and 0 tokens. Rows with a null id are left out; repeated rows are items of their own."""
    sizes = materialize(token_counts(df.where(F.col(id_col).isNotNull()), id_col, text_col, path), "sizes")
    shards = -(-sizes.count() // SHARD) or 1
    lim = F.array(*[F.struct(F.lit(n).alias("limit_name"), F.lit(c).cast("bigint").alias("capacity")) for n, c in limits])
    x = sizes.select("id", "tokens", F.explode(lim).alias("l")).select("id", "tokens", "l.*").withColumn("whole", F.expr("tokens div capacity"))
    # the containers that a text fills alone are named by its id and size, equal rows by their number too: names don't depend on where rows lie
    own = x.where("whole > 0").groupBy("limit_name", "capacity", "id", "tokens", "whole").agg(F.count(F.lit(1)).alias("n"))
    own = own.select("limit_name", "capacity", "id", "tokens", "whole", F.explode(F.expr("sequence(1, n)")).alias("row"))
    own = own.select("limit_name", "capacity", "id", "tokens", "row", F.explode(F.expr("sequence(0, whole - 1)")).alias("piece"))
    own = own.select("limit_name", "capacity", F.concat_ws("-", "limit_name", F.lit("f"), "id", "tokens", "row", "piece").alias("container"), "id", F.col("piece").cast("int").alias("piece"), F.col("capacity").alias("tokens"))
    none = x.where("tokens = 0").select("limit_name", "capacity", F.lit(None).cast("string").alias("container"), "id", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("tokens"))
    rest = x.withColumn("size", F.col("tokens") - F.col("whole") * F.col("capacity")).where("size > 0").select("limit_name", "capacity", F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), "id", F.col("whole").cast("int").alias("piece"), "size")
    schema = "limit_name string, capacity bigint, container string, id bigint, piece int, tokens bigint"
    return rest.groupBy("limit_name", "shard").applyInPandas(_pack(max_docs, cost_share), schema).unionByName(own).unionByName(none)
