"""Column expressions that turn raw trips into model features, bins and packed statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType


def duration_minutes(start: str, end: str) -> Column:
    """Minutes between two timestamps, counted in whole seconds."""
    return (F.unix_timestamp(end) - F.unix_timestamp(start)) / F.lit(60.0)


def hour_of(ts: str) -> Column:
    return F.hour(ts).cast("int")


def day_of_week(ts: str) -> Column:
    """1 is Sunday, 7 is Saturday."""
    return F.dayofweek(ts).cast("int")


def month_of(ts: str) -> Column:
    return F.month(ts).cast("int")


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (null counts as 0)."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def is_weekend(ts: str) -> Column:
    return flag(F.dayofweek(ts).isin(1, 7))


def is_rush_hour(ts: str) -> Column:
    hour = F.hour(ts)
    return flag(hour.between(7, 9) | hour.between(16, 19))


# Labels of the distance, duration and hour bins, with their upper bounds.
DISTANCE_BINS = ((1, "0-1"), (3, "1-3"), (5, "3-5"), (10, "5-10"), (None, "10+"))
DURATION_BINS = ((5, "0-5"), (15, "5-15"), (30, "15-30"), (60, "30-60"), (None, "60+"))
HOUR_BINS = ((6, "night"), (10, "morning"), (16, "midday"), (20, "evening"), (None, "night"))


def labelled_bin(value: Column, bins: tuple, closed: bool = True) -> Column:
    """Label of the first bin whose upper bound holds the value; the bound belongs to it if ``closed``."""
    label = F.lit(bins[-1][1])
    for bound, name in reversed(bins[:-1]):
        inside = value <= bound if closed else value < bound
        label = F.when(inside, F.lit(name)).otherwise(label)
    return label


def distance_bin(value: str) -> Column:
    return labelled_bin(F.coalesce(F.col(value), F.lit(0.0)), DISTANCE_BINS)


def duration_bin(value: str) -> Column:
    return labelled_bin(F.coalesce(F.col(value), F.lit(0.0)), DURATION_BINS)


def hour_bin(value: str) -> Column:
    return labelled_bin(F.coalesce(F.col(value), F.lit(0)), HOUR_BINS, closed=False)


# What a missing key becomes when statistics are packed for the log ...
PACK_DEFAULTS = {
    "passenger_count": 1,
    "pickup_borough": "Unknown",
    "dropoff_borough": "Unknown",
    "RatecodeID": 1,
    "payment_type": 1,
    "is_weekend": 0,
    "is_rush_hour": 0,
    "trip_distance": 0.0,
    "trip_duration_minutes": 0.0,
}

# ... and when they are unpacked from it.
UNPACK_DEFAULTS = {
    "trip_distance": 3.0,
    "trip_duration_minutes": 15.0,
    "passenger_count": 1,
    "pickup_hour": 12,
    "is_weekend": 0,
    "is_rush_hour": 0,
    "pickup_borough": "Manhattan",
    "dropoff_borough": "Manhattan",
    "RatecodeID": 1,
    "payment_type": 1,
}

_TYPE_OF = {float: DoubleType(), int: IntegerType(), str: StringType()}

STATS_SCHEMA = StructType(
    [StructField(name, _TYPE_OF[type(value)]) for name, value in UNPACK_DEFAULTS.items()]
    + [StructField("pickup_day_of_week", IntegerType())]
)


def pack_stats() -> Column:
    """JSON text with the three bins and the raw values of a scored record, its hour and weekday among them:
    rebuilt from the bins, these two would drift by construction."""
    bins = [
        distance_bin("trip_distance").alias("trip_distance_bin"),
        duration_bin("trip_duration_minutes").alias("trip_duration_bin"),
        hour_bin("pickup_hour").alias("hour_bin"),
    ]
    values = [
        F.coalesce(F.col(name), F.lit(default)).alias(name)
        for name, default in PACK_DEFAULTS.items()
    ]
    return F.to_json(F.struct(*bins, *values, "pickup_hour", "pickup_day_of_week"))


def unpack_stats(df: DataFrame, stats: str) -> DataFrame:
    """Add typed columns from packed statistics, missing keys replaced by their defaults.

    The text is parsed once into a struct. A day of week that was not logged is rebuilt as Sunday for weekend
    trips and Tuesday otherwise.
    """
    parsed = df.withColumn("__stats", F.from_json(F.col(stats), STATS_SCHEMA))
    filled = parsed.withColumns(
        {
            name: F.coalesce(F.col(f"__stats.{name}"), F.lit(default))
            for name, default in UNPACK_DEFAULTS.items()
        }
    )
    rebuilt = F.when(F.col("is_weekend") != 0, F.lit(1)).otherwise(F.lit(3))
    return filled.withColumn(
        "pickup_day_of_week", F.coalesce("__stats.pickup_day_of_week", rebuilt)
    ).drop("__stats")


def feature_hash(names: list[str]) -> Column:
    """First 16 hex digits of SHA-256 over ``name=value`` pairs in name order; null is written as null."""
    pairs = [
        F.concat(F.lit(f"{n}="), F.coalesce(F.col(n).cast("string"), F.lit("null")))
        for n in sorted(names)
    ]
    return F.substring(F.sha2(F.concat_ws("|", *pairs), 256), 1, 16)


def stable_id(*parts: Column, prefix: str = "") -> Column:
    """Id derived from the run's own keys, so that repeating a run repeats its id."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.substring(F.sha2(F.concat(F.lit(prefix), text), 256), 1, 16)


# The tariff of the baseline fare formula.
BASE_FARE, PER_MILE, PER_MINUTE, RUSH_SURCHARGE, MIN_FARE = 3.0, 2.5, 0.5, 2.5, 2.5


def floor_score(score: Column) -> Column:
    """Score no lower than the minimum fare, in cents; a NaN becomes the minimum."""
    return F.round(F.greatest(F.nanvl(score.cast("double"), F.lit(MIN_FARE)), F.lit(MIN_FARE)), 2)


def score_label(score: Column) -> Column:
    """Whole-number label used when counting predictions (halves go to the even neighbour)."""
    return F.bround(score, 0).cast("int")


def baseline_fare(
    distance: str = "trip_distance",
    minutes: str = "trip_duration_minutes",
    rush: str = "is_rush_hour",
) -> Column:
    """Tariff estimate used when no model is available."""
    return floor_score(
        F.lit(BASE_FARE)
        + F.coalesce(F.col(distance), F.lit(UNPACK_DEFAULTS["trip_distance"])) * PER_MILE
        + F.coalesce(F.col(minutes), F.lit(UNPACK_DEFAULTS["trip_duration_minutes"])) * PER_MINUTE
        + F.when(F.col(rush) != 0, F.lit(RUSH_SURCHARGE)).otherwise(F.lit(0.0))
    )
