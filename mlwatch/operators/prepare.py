"""Feature preparation: derived columns, dimension lookup, outlier filter, sampling and splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import MapType

from mlwatch.functions import trips as fn
from mlwatch.spec import FeatureSpec, TRIP_SPEC

_SPARK_TYPE = {"int": "int", "float": "double", "str": "string"}


def time_features(
    df: DataFrame, pickup: str = "pickup_ts", dropoff: str = "dropoff_ts"
) -> DataFrame:
    """Add duration, hour, weekday, month and the two flags."""
    return df.withColumns(
        {
            "trip_duration_minutes": fn.duration_minutes(pickup, dropoff),
            "pickup_hour": fn.hour_of(pickup),
            "pickup_day_of_week": fn.day_of_week(pickup),
            "pickup_month": fn.month_of(pickup),
            "is_weekend": fn.is_weekend(pickup),
            "is_rush_hour": fn.is_rush_hour(pickup),
        }
    )


def lookup(
    df: DataFrame,
    dimension: DataFrame,
    key: str,
    dimension_key: str,
    value: str,
    output: str,
    missing: str | None = None,
) -> DataFrame:
    """Add ``output`` = the dimension's ``value`` for ``key``; a miss is null or ``missing``.

    The row count stays: of a key that the dimension holds several times the least value counts. The join
    has no hint; the optimizer broadcasts a dimension under its byte threshold, and otherwise adaptive
    execution splits the partitions of a hot key.
    """
    side = dimension.groupBy(F.col(dimension_key).alias("__lookup_key")).agg(
        F.min(value).alias("__lookup_value")
    )
    found = F.col("__lookup_value")
    if missing is not None:
        found = F.coalesce(found, F.lit(missing))
    return (
        df.join(side, F.col(key) == F.col("__lookup_key"), "left")
        .withColumn(output, found)
        .drop("__lookup_key", "__lookup_value")
    )


def cast_to_rules(df: DataFrame, spec: FeatureSpec = TRIP_SPEC) -> DataFrame:
    """Cast every ruled column to its type; a value that does not fit becomes null.

    An integer that arrives as a fraction or as text goes through double first and is truncated.
    """

    def cast(rule) -> Column:
        column = F.col(rule.column)
        if rule.kind == "int":
            return column.try_cast("double").try_cast("int")
        return column.try_cast(_SPARK_TYPE[rule.kind])

    return df.withColumns({r.column: cast(r) for r in spec.rules if r.column in df.columns})


def within_rules(spec: FeatureSpec = TRIP_SPEC) -> Column:
    """True for rows whose ruled columns are all non-null and inside the inclusive bounds their rules have."""

    def inside(rule) -> Column:
        column = F.col(rule.column)
        bounds = [column >= rule.minimum] if rule.minimum is not None else []
        bounds += [column <= rule.maximum] if rule.maximum is not None else []
        return reduce(lambda a, b: a & b, bounds, column.isNotNull())

    return reduce(lambda a, b: a & b, map(inside, spec.rules))


def prepare(df: DataFrame, spec: FeatureSpec = TRIP_SPEC, keep: list[str] | None = None) -> DataFrame:
    """Typed, filtered and pruned model table: the spec's columns, after any ``keep`` columns."""
    typed = cast_to_rules(df, spec).filter(within_rules(spec))
    return typed.select(*(keep or []), *spec.columns).dropna(subset=spec.columns)


def feature_target_split(df: DataFrame, spec: FeatureSpec = TRIP_SPEC) -> tuple[DataFrame, DataFrame]:
    """(features, target); an absent target is an error."""
    if spec.target not in df.columns:
        raise ValueError(f"target column {spec.target!r} not found")
    return df.drop(spec.target), df.select(spec.target)


def categories_as_text(df: DataFrame, spec: FeatureSpec = TRIP_SPEC) -> DataFrame:
    """Categorical columns as strings, as encoding and scoring expect them."""
    return df.withColumns({c: F.col(c).cast("string") for c in spec.categorical})


def key_hash(*keys: str) -> Column:
    """Number from 0 to 2^32-1 per row key, the same on every run and under every partitioning."""
    digest = F.md5(F.concat_ws("-", *[F.col(k).cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def key_bucket(*keys: str, buckets: int = 100) -> Column:
    return (key_hash(*keys) % buckets).cast("int")


def split_by_key(
    df: DataFrame, keys: list[str], train_percent: int = 80
) -> tuple[DataFrame, DataFrame]:
    """Repeatable (train, test) split on the row key."""
    bucket = key_bucket(*keys)
    return df.filter(bucket < train_percent), df.filter(bucket >= train_percent)


def cap_by_key(df: DataFrame, keys: list[str], cap: int, rows: int | None = None) -> DataFrame:
    """Bernoulli sample of about ``cap`` rows, decided by the row key; all rows when there are fewer.

    For fitting a model on a bounded sample of labelled rows, and nothing else. Pass ``rows`` when the count
    is known already.
    """
    total = df.count() if rows is None else rows
    if total <= cap:
        return df
    return df.filter(key_hash(*keys) < int((cap / total) * 2**32))


def fixed_sample(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Exactly ``min(rows, count)`` rows without replacement: those of the lowest hashed keys.

    Rows that share a key go by all their columns, so the sample is the same under every partitioning; rows that are
    equal in every column are interchangeable. A top-k: every partition keeps its ``rows`` lowest before they meet.
    """
    digest = F.md5(F.concat_ws("-", *[F.col(k).cast("string") for k in keys]))
    return df.orderBy(digest, *_in_total_order(df, keys)).limit(rows)


def _in_total_order(df: DataFrame, keys: list[str]) -> list[Column]:
    """The keys, then every other column, nulls first; maps, which have no order, as sorted entries."""
    others = [f for f in df.schema.fields if f.name not in keys]
    return [F.col(k).asc_nulls_first() for k in keys] + [
        (F.array_sort(F.map_entries(f.name)) if isinstance(f.dataType, MapType) else F.col(f.name)).asc_nulls_first()
        for f in others
    ]
