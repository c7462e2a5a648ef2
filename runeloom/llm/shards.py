"""Indexes made of arrays, built by executors shard by shard, kept as tables in the shared folder and loaded by the workers that need them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runeloom.work import new_path

#: Bytes of an array in one row.
_PART = 4 << 20

_LOADED: dict[str, object] = {}


def write_shards(df: DataFrame, shards: int, build: Callable[[list[dict]], dict[str, np.ndarray]], name: str) -> str:
    """Build one index of all rows with one ``shard`` (0 to ``shards`` - 1), each in a task of its own; the URI under which ``load`` finds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _LOADED.clear()
        rows: list[dict] = []
        for b in batches:
            rows += b.to_pylist()
        if rows:
            shard = rows[0]["shard"]
            arrays = build(rows)
            del rows
            for k, a in arrays.items():
                raw = a.tobytes()
                for part in range(-(-len(raw) // _PART) or 1):
                    yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "name": [k], "dtype": [a.dtype.str], "part": pa.array([part], pa.int32()), "data": [raw[part * _PART : (part + 1) * _PART]]})

    spark = df.sparkSession
    path = new_path(spark, name)
    df.repartitionById(shards, F.col("shard")).mapInArrow(run, "shard int, name string, dtype string, part int, data binary").write.option("compression", "zstd").partitionBy("shard").parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    path = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def load(path: str, shard: int, make: Callable[[dict[str, np.ndarray]], object]) -> object | None:
    """What ``make`` makes of a shard's arrays, None for a shard without rows; a worker keeps one."""
    key = f"{path}/shard={shard}"
    if key not in _LOADED:
        import pyarrow.parquet as pq
        from pyarrow import fs

        _LOADED.clear()
        files, root = fs.FileSystem.from_uri(key)
        parts: dict[str, list[tuple[int, str, bytes]]] = {}
        for info in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if info.base_name.endswith(".parquet"):
                with files.open_input_file(info.path) as f:
                    for b in pq.ParquetFile(f).iter_batches(batch_size=1):
                        r = b.to_pylist()[0]
                        parts.setdefault(r["name"], []).append((r["part"], r["dtype"], r["data"]))
        arrays = {}
        for k in list(parts):
            v = sorted(parts.pop(k))
            arrays[k] = np.frombuffer(b"".join(x[2] for x in v), dtype=v[0][1])
            del v
        _LOADED[key] = make(arrays) if arrays else None
    return _LOADED[key]
