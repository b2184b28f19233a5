"""The benchmark tables seen as trips, prediction logs, request logs and candidate models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mlwatch.operators import decide, evaluate
from mlwatch.operators.prepare import time_features
from mlwatch.spec import TRIP_SPEC

REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
SPEC = TRIP_SPEC.allowing({"pickup_borough": REGIONS, "dropoff_borough": REGIONS})
KEYS = ["l_orderkey", "l_linenumber"]
DRIFT_SPLIT = "1999-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation key to region name; the last nation is left unmapped."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return (
        nation.filter("n_nationkey < 24")
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select("n_nationkey", "r_name")
    )


def repeated_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zones, some keys twice, the second time with a later name."""
    once = zones(spark, sf_dir)
    again = once.filter("n_nationkey % 5 = 0").withColumn("r_name", F.lit("ZONE"))
    return once.unionByName(again)


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as trips. Customers and suppliers carry the two zones.

    Customers meet the orders before the line items do, and zones travel as nation keys that get their names last:
    the line items are shuffled for their orders, in few and narrow columns, and for their suppliers only where those
    are many. The sides of the joins are left to the optimizer, which knows the size of the tables; but orders grow
    with the line items, so they are merged with them at every size and never sent whole to every executor.
    """
    zone = zones(spark, sf_dir)
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("pickup_nation"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dropoff_nation"))
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderdate",
        F.substring("o_orderpriority", 1, 1).cast("int").alias("RatecodeID"),
        F.when(F.col("o_orderstatus") == "F", 1)
        .when(F.col("o_orderstatus") == "O", 2)
        .otherwise(5)
        .alias("payment_type"),
    )
    placed = orders.join(customer, orders.o_custkey == customer.c_custkey)
    lines = table(spark, sf_dir, "lineitem").select(
        *KEYS, "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
    )
    minutes = (F.col("l_partkey") * 7 + F.col("l_linenumber") * 13) % 200
    rows = lines.join(placed.hint("merge"), lines.l_orderkey == placed.o_orderkey).join(
        supplier, lines.l_suppkey == supplier.s_suppkey
    )
    for side in ("pickup", "dropoff"):
        named = zone.select(
            F.col("n_nationkey").alias(f"{side}_key"), F.col("r_name").alias(f"{side}_borough")
        )
        # at most the 25 rows of nation
        rows = rows.join(F.broadcast(named), F.col(f"{side}_nation") == F.col(f"{side}_key"), "left")
    pickup = F.expr("o_orderdate + make_dt_interval(0, cast(o_orderkey % 24 as int), 0, 0)")
    return rows.select(
        *KEYS,
        "l_partkey",
        "l_suppkey",
        pickup.alias("pickup_ts"),
        (pickup + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"))).alias("dropoff_ts"),
        (F.col("l_quantity") * 2.2).alias("trip_distance"),
        F.col("l_linenumber").alias("passenger_count"),
        "RatecodeID",
        "payment_type",
        "pickup_borough",
        "dropoff_borough",
        (F.col("l_extendedprice") / 500.0).alias("fare_amount"),
    )


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_features(trips(spark, sf_dir))


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips with NaN distances, missing passenger counts and an unknown borough."""
    part = F.col("l_partkey")
    return featured(spark, sf_dir).withColumns(
        {
            "trip_distance": F.when(part % 101 == 0, F.lit(float("nan"))).otherwise(
                F.col("trip_distance")
            ),
            "passenger_count": F.when(part % 97 != 0, F.col("passenger_count")),
            "pickup_borough": F.when(part % 89 == 0, "Atlantis").otherwise(F.col("pickup_borough")),
        }
    )


def sided(spark: SparkSession, sf_dir: str, shifted: bool = False) -> DataFrame:
    """Trips marked as reference (before the split) or current (from it).

    ``shifted`` makes the current half drift: longer distances, one region taking a third of the pickups.
    Some distances are infinite then, on both sides.
    """
    current = F.col("pickup_ts") >= F.lit(DRIFT_SPLIT).cast("timestamp_ntz")
    rows = featured(spark, sf_dir).withColumn(
        "side", F.when(current, "current").otherwise("reference")
    )
    if shifted:
        late = F.col("side") == "current"
        rows = rows.withColumns(
            {
                "trip_distance": F.when(F.col("l_partkey") % 211 == 0, F.lit(float("inf")))
                .when(late, F.col("trip_distance") * 1.5)
                .otherwise(F.col("trip_distance")),
                "pickup_borough": F.when(late & (F.col("l_partkey") % 3 == 0), "ASIA").otherwise(
                    F.col("pickup_borough")
                ),
            }
        )
    return rows


def events_with_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn(
        "k", F.get_json_object("props", "$.k").cast("int")
    )


def as_predictions(events: DataFrame) -> DataFrame:
    """Events (with k) as a prediction log."""
    return events.select(
        F.col("event_id").alias("request_id"),
        "ts",
        F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model_name"),
        (F.col("user_id") % 4 + 1).cast("int").alias("model_version"),
        F.col("value").alias("predicted_fare"),
        ((F.col("k") + 1) * 0.5).alias("latency_ms"),
        "k",
        F.col("props").alias("numeric_feature_stats"),
    )


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_predictions(events_with_k(spark, sf_dir))


def as_requests(events: DataFrame) -> DataFrame:
    """Events (with k) as a request log."""
    k = F.col("k")
    text_k = k.cast("string")
    return events.select(
        "event_id",
        "user_id",
        "ts",
        F.when(F.col("event_type").isin("purchase", "signup"), "POST").otherwise("GET").alias("method"),
        F.when(k % 10 == 0, "/healthz")
        .when(k % 10 == 1, "/doc/3f2504e0-4f89-11d3-9a0c-0305e82c3301/view")
        .otherwise(
            F.concat(
                F.lit("/api/v1/user/"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type")
            )
        )
        .alias("path"),
        F.when(
            F.col("event_type") == "error", F.when(k % 2 == 0, F.lit(500)).otherwise(F.lit(422))
        )
        .otherwise(F.lit(200))
        .alias("status"),
        ((k + 1) * 0.005).alias("latency_seconds"),
        F.when(k % 3 == 0, F.concat(F.lit(" 10.0.0."), text_k, F.lit(" , 10.1.1.1"))).alias("forwarded"),
        F.when(k % 3 == 1, F.concat(F.lit("10.9.0."), text_k)).alias("peer"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_requests(events_with_k(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prediction per trip; each version errs by its own factor."""
    factor = F.lit(0.5)
    for version, value in ((6, 0.8), (5, 1.2), (4, 2.1), (3, 2.0), (2, 2.95), (1, 3.0)):
        factor = F.when(F.col("l_linenumber") == version, F.lit(value)).otherwise(factor)
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("m"), (F.col("l_suppkey") % 3).cast("string")).alias("model_name"),
        F.col("l_linenumber").alias("model_version"),
        (F.col("l_extendedprice") / 500.0).alias("label"),
        (F.col("l_extendedprice") / 500.0 + (F.col("l_partkey") % 21 - 10) * factor).alias("prediction"),
        (
            (F.col("l_partkey") % 50 + 1)
            * F.when(F.col("l_linenumber") == 6, F.lit(0.2)).otherwise(F.lit(0.1))
        ).alias("latency_ms"),
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate versions with their quality and latency, one per model and version."""
    rows = scored(spark, sf_dir)
    keys = ["model_name", "model_version"]
    quality = evaluate.regression_metrics(
        rows, "label", "prediction", by=keys, extra=[F.avg("latency_ms").alias("avg_latency_ms")]
    )
    return quality.select(
        *keys,
        "rmse",
        "mae",
        "r2",
        "mape",
        "avg_latency_ms",
        (F.col("model_version") != 5).alias("validation_passed"),
        F.expr(
            "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(model_version, 0, 0, 0)"
        ).alias("decided_at"),
    )
