"""Rows of a Spark query against DuckDB's on the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def connect(sf: str = SF):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*' if p.is_dir() else ''}'")
    return con


def assert_same(spark, query, sql: str, sf: str, tmp_path) -> None:
    con = connect(sf)
    query(spark, sf).write.parquet(f"{tmp_path}/got")
    con.execute(f"create view got as select * from '{tmp_path}/got/*.parquet'")
    con.execute(f"create table want as {sql}")
    names = lambda t: sorted(r[0] for r in con.execute(f"describe {t}").fetchall())
    assert names("got") == names("want")
    cols = ", ".join(f'"{c}"' for c in names("got"))
    for a, b in (("got", "want"), ("want", "got")):
        assert con.execute(f"select {cols} from {a} except all select {cols} from {b} limit 3").fetchall() == []
