"""Run registered queries against DuckDB: python -m tests.oracle_check [key ...]."""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "<null>"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{value + 0.0:.6f}"
    return f"{type(value).__name__}:{value}"


def sorted_rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def mismatch(spark_df, con, sql: str) -> str | None:
    """None when both results hold the same rows, else a short account of the difference."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = sorted_rows(names, result.fetchall())
    found = sorted_rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    if len(expected) != len(found):
        return f"{len(found)} rows, expected {len(expected)}"
    for a, b in zip(found, expected):
        if a != b:
            return f"{sorted(names)}\n  found    {a}\n  expected {b}"
    return None


def session(cores: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("mlwatch")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="mlwatch-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(keys: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = session(), connect(sf_dir)
    failures = 0
    for key, query in entry.queries().items():
        if keys and key not in keys:
            continue
        start = time.time()
        try:
            frame = query(spark, sf_dir)
            sql = entry.oracle_sql().get(key)
            problem = mismatch(frame, con, sql) if sql else None
            note = "ok" if sql else f"rows only: {frame.count()}"
        except Exception as error:  # report and go on with the other keys
            problem, note = f"{type(error).__name__}: {str(error)[:1500]}", ""
        failures += problem is not None
        print(f"{key:26s} {time.time() - start:6.1f}s  {problem or note}", flush=True)
    return failures


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
