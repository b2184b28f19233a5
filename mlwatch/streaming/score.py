"""Requests in, validated and scored log out; rejected requests go to quarantine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from mlwatch.functions.trips import baseline_fare, feature_hash, unpack_stats
from mlwatch.operators.validate import row_errors
from mlwatch.sources.history import exists, first_per_key, key_bucket, present_keys
from mlwatch.sources.shared import discard, written
from mlwatch.spec import FeatureSpec, TRIP_SPEC
from mlwatch.streaming.runtime import run_to_end, write_batch


def first_requests(
    requests: DataFrame,
    key: str = "request_id",
    ts: str = "ts",
    watermark: str = "1 hour",
    salts: int = 8,
) -> DataFrame:
    """Each request once.

    Rows behind the watermark of the preceding micro-batch are late and dropped, repeats among them
    included. A stateful step takes all copies of a key to one task, so with ``salts`` > 1 the copies are
    first thinned out in that many places, by input partition, and at most that many meet.
    """
    marked = requests.withWatermark(ts, watermark)
    if salts > 1:
        marked = (
            marked.withColumn("__salt", F.spark_partition_id() % salts)
            .dropDuplicatesWithinWatermark([key, "__salt"])
            .drop("__salt")
        )
    return marked.dropDuplicatesWithinWatermark([key])


def score_baseline(features: DataFrame) -> DataFrame:
    """Scores by tariff, for when there is no model."""
    return features.withColumn("predicted_fare", baseline_fare())


def checked_features(requests: DataFrame, stats: str, spec: FeatureSpec) -> DataFrame:
    """Requests with their features unpacked from JSON and the errors found in them."""
    unpacked = unpack_stats(requests, stats)
    checked = FeatureSpec(
        spec.numeric,
        spec.binary,
        spec.categorical,
        spec.target,
        tuple(r for r in spec.rules if r.column in unpacked.columns),
    )
    return unpacked.withColumn("errors", row_errors(unpacked, checked))


def seen_path(log_path: str) -> str:
    """Where the ids of a log are kept by bucket and batch."""
    return f"{log_path.rstrip('/')}-seen"


def newest_path(log_path: str) -> str:
    """Where the newest time of all batches so far is kept, by batch."""
    return f"{log_path.rstrip('/')}-newest"


def _newest(spark: SparkSession, log_path: str, batch_id: int) -> int | None:
    """The newest time (microseconds) of all batches up to this one."""
    path = f"{newest_path(log_path)}/batch={batch_id}"
    return spark.read.schema("newest long").parquet(path).first()["newest"] if exists(spark, path) else None


def score_log(
    requests: DataFrame,
    log_path: str,
    quarantine_path: str,
    checkpoint: str,
    stats: str = "numeric_feature_stats",
    spec: FeatureSpec = TRIP_SPEC,
    watermark: str = "1 hour",
    score: Callable[[DataFrame], DataFrame] = score_baseline,
) -> None:
    """Run the scoring stream over everything available.

    ``score`` adds ``predicted_fare``: the tariff, or a saved model's transform. A micro-batch keeps the first copy of
    each request, leaves out those that earlier batches had, checks and scores the rest in one pass and writes it to
    the log or the quarantine. The stream holds no state: the ids seen are kept beside the log by buckets (``seen_path``),
    and a batch reads those of its own ids. A logged request is never logged or refused again; a refused one may come
    again when the watermark is past its time and ``watermark`` more. As in :func:`first_requests`, rows behind the
    watermark of the preceding batch are late and dropped. Rows without an id are one request in each batch. A retried
    batch replaces itself in every table.
    """
    spark = requests.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        # a stream plans without adaptive execution; what it brings is worked on in the session that started it
        given = written(batch, "requests", spark)
        delay = F.expr(f"interval {watermark}")
        passed = F.timestamp_micros(F.lit(_newest(spark, log_path, batch_id - 2)).cast("long")) - delay
        on_time = given.filter(F.coalesce(F.col("ts") > passed, F.lit(True)))
        fresh = first_per_key(on_time, "request_id", "ts").withColumn("key_bucket", key_bucket("request_id"))
        fresh, seen = written(fresh, "fresh"), seen_path(log_path)
        unique = fresh
        if exists(spark, seen):
            schema = fresh.select("request_id").schema.add("until", "timestamp")
            held = spark.read.schema(schema.add("key_bucket", "integer").add("batch", "long")).parquet(seen)
            held = held.filter((F.col("batch") < batch_id) & F.coalesce(F.col("until") > passed, F.lit(True)))
            unique = fresh.join(present_keys(fresh, held, "request_id"), "request_id", "left_anti")
        checked = checked_features(unique, stats, spec)
        names = [c for c in spec.features if c in checked.columns]
        checked = written(score(checked.withColumn("feature_hash", feature_hash(names))), "scored")
        good = F.size("errors") == 0
        write_batch(checked.filter(good).drop("errors", "key_bucket"), log_path, batch_id, "ts")
        write_batch(checked.filter(~good).drop("key_bucket"), quarantine_path, batch_id, "ts")
        until = F.when(~good, F.coalesce("ts", F.timestamp_seconds(F.lit(0))) + delay).alias("until")
        ids = checked.select("request_id", until, "key_bucket", F.lit(batch_id).cast("long").alias("batch"))
        ids.repartition("key_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "key_bucket", "batch"
        ).parquet(seen)
        before = F.lit(_newest(spark, log_path, batch_id - 1)).cast("long")
        newest = given.agg(F.greatest(F.max(F.unix_millis("ts")) * 1000, before).alias("newest"))
        newest.coalesce(1).write.mode("overwrite").parquet(f"{newest_path(log_path)}/batch={batch_id}")
        for table in (given, fresh, checked):
            discard(table)

    run_to_end(requests.writeStream.foreachBatch(write), checkpoint)
