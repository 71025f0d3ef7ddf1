"""python tests/verify.py [-s SCALE] NAME...: compare queries with their SQL on the test tables."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = os.environ.get("TESTDATA", "/root/testdata")


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]").appName("reelgrid")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(v: object) -> object:
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def rows_of(columns: list[str], rows: list) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def compare(spark: SparkSession, name: str, query, sql: str | None, folder: str, con: duckdb.DuckDBPyConnection) -> tuple[bool | None, str]:
    began = time.time()
    df = query(spark, folder)
    got = rows_of(df.columns, df.collect())
    took = time.time() - began
    if sql is None:
        return None, f"{name}: {len(got)} rows, no SQL, {took:.1f} s"
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    want = rows_of(columns, rel.fetchall())
    if sorted(columns) != sorted(df.columns):
        return False, f"{name}: columns {df.columns} but {columns}"
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        return False, f"{name}: {len(got)} rows, SQL {len(want)}; only here {sorted(a)[:3]}; only SQL {sorted(b)[:3]}"
    return True, f"{name}: {len(got)} rows equal, {took:.1f} s"


def main(args: list[str]) -> int:
    scale = args[1] if args[:1] == ["-s"] else "0.01"
    names = args[2:] if args[:1] == ["-s"] else args
    import __spark_entry__ as e

    folder, spark = f"{DATA}/sf{scale}", session()
    con = connect(folder)
    queries, sql = e.queries(), e.oracle_sql()
    bad = 0
    for name in names or queries:
        try:
            ok, text = compare(spark, name, queries[name], sql.get(name), folder, con)
        except Exception as x:
            ok, text = False, f"{name}: {type(x).__name__} {str(x)[:1500]}"
        bad += ok is False
        print("FAIL" if ok is False else "ok", text, flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
