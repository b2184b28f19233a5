"""Reading and writing model tables and reference snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from mlwatch.operators.prepare import fixed_sample


def read_table(
    spark: SparkSession, path: str, schema: StructType | str | None = None, kind: str | None = None
) -> DataFrame:
    """Parquet or CSV with a header, as ``kind`` says, else Parquet by suffix and anything else as CSV.

    A CSV without a schema is inferred.
    """
    if kind not in (None, "parquet", "csv"):
        raise ValueError(f"unknown kind of table {kind!r}")
    if kind == "parquet" or kind is None and path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(path)


def union_normalised(frames: list[DataFrame], casts: dict[str, str]) -> DataFrame:
    """Union by name of frames whose column types differ; a column missing from one is null there."""
    typed = [
        f.withColumns({c: f[c].cast(t) for c, t in casts.items() if c in f.columns}) for f in frames
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), typed)


def read_union(spark: SparkSession, paths: list[str], casts: dict[str, str]) -> DataFrame:
    """Union of Parquet files written with inconsistent types: one scan for each schema among them."""
    groups: dict[str, list[str]] = {}
    for path in paths:
        groups.setdefault(spark.read.parquet(path).schema.json(), []).append(path)
    return union_normalised([spark.read.parquet(*same) for same in groups.values()], casts)


def write_once(df: DataFrame, path: str) -> None:
    """Write Parquet unless the path already holds a table."""
    df.write.mode("ignore").parquet(path)


def write_snapshot(df: DataFrame, path: str, keys: list[str], rows: int) -> None:
    """Write a bounded drift reference as CSV: at most ``rows`` rows, picked by hashed key.

    A reference need not be cut: ``write_once`` keeps the whole table as Parquet.
    """
    fixed_sample(df, keys, rows).write.mode("overwrite").option("header", True).csv(path)
