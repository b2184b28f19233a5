"""Dataset statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mlwatch.functions.numbers import null_safe, number
from mlwatch.operators.quantiles import bracketed_quantiles, exact_quantiles, sketched
from mlwatch.sources.shared import written
from mlwatch.spec import FeatureSpec


def table_shape(df: DataFrame) -> DataFrame:
    """One row per column: rows, columns, and null (or NaN) count, from one aggregate."""
    floating = {n for n, t in df.dtypes if t in ("double", "float")}
    nulls = [
        F.count_if(F.col(c).isNull() | F.isnan(c) if c in floating else F.col(c).isNull()).alias(c)
        for c in df.columns
    ]
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"n.{c}").alias("nulls")) for c in df.columns]
    return (
        df.agg(F.count(F.lit(1)).alias("rows"), F.struct(*nulls).alias("n"))
        .select("rows", F.explode(F.array(*cells)).alias("cell"))
        .select("cell.*", "rows", F.lit(len(df.columns)).alias("columns"))
    )


def numeric_profile(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """One row per column: mean, sample deviation, min, max and median; two scans, as medians start from sketches that
    are taken along with the moments."""
    stats = [
        F.struct(
            F.avg(number(c)).alias("mean"),
            F.stddev_samp(number(c)).alias("std"),
            F.min(number(c)).alias("min"),
            F.max(number(c)).alias("max"),
        ).alias(c)
        for c in columns
    ]
    cells = [
        F.struct(
            F.lit(c).alias("feature"),
            *[F.col(f"`{c}`.{part}").alias(part) for part in ("mean", "std", "min", "max")],
        )
        for c in columns
    ]
    summary = df.agg(*stats) if approximate else sketched(df, columns, [], stats)
    moments = summary.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")
    found = (
        exact_quantiles(df, columns, [0.5], approximate=True)
        if approximate
        else bracketed_quantiles(df, summary, columns, [0.5])
    )
    medians = found.select("feature", F.col("value").alias("median"))
    return moments.join(medians, "feature", "left")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per column and non-null value (as text)."""
    cells = [
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns
    ]
    return (
        df.select(F.explode(F.array(*cells)).alias("cell"))
        .select("cell.*")
        .filter("value is not null")
        .groupBy("feature", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def categorical_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Value counts with the number of distinct values of their column.

    The counts are written once: the distinct numbers come from them, not from another scan.
    """
    counts = written(value_counts(df, columns), "value-counts")
    distinct = counts.groupBy(F.col("feature").alias("__feature")).agg(
        F.count(F.lit(1)).alias("distinct_values")
    )
    on = null_safe([counts["feature"]], [distinct["__feature"]])
    return counts.join(F.broadcast(distinct), on).drop("__feature")  # one row per named column


def dataset_stats(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """The statistics kept with a training run, one per row: column, statistic, value.

    Holds rows, columns and nulls per column; moments, range and median of numeric columns and the
    target; the number of distinct values and their counts for categorical and binary columns.
    """
    df = df.select(*[c for c in spec.columns if c in df.columns])
    numeric = [c for c in (*spec.numeric, spec.target) if c in df.columns]
    discrete = [c for c in (*spec.categorical, *spec.binary) if c in df.columns]

    def tall(frame: DataFrame, key: str, statistics: list[str]) -> DataFrame:
        cells = [
            F.struct(F.lit(name).alias("statistic"), F.col(name).cast("double").alias("value"))
            for name in statistics
        ]
        return frame.select(F.col(key).alias("column"), F.explode(F.array(*cells)).alias("c")).select(
            "column", "c.*"
        )

    counts = categorical_profile(df, discrete)
    per_value = counts.select(
        F.col("feature").alias("column"),
        F.concat(F.lit("count of "), F.col("value")).alias("statistic"),
        F.col("rows").cast("double").alias("value"),
    )
    distinct = counts.groupBy(F.col("feature").alias("column")).agg(
        F.max("distinct_values").cast("double").alias("value")
    ).select("column", F.lit("distinct_values").alias("statistic"), "value")
    return (
        tall(table_shape(df), "column", ["rows", "nulls"])
        .unionByName(tall(numeric_profile(df, numeric), "feature", ["mean", "std", "min", "max", "median"]))
        .unionByName(distinct)
        .unionByName(per_value)
    )
