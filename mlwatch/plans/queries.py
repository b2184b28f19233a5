"""One registered query per operator group, over the benchmark tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mlwatch.functions import requests as req, trips as fn
from mlwatch.functions.severity import alert_severity
from mlwatch.operators import (
    decide,
    drift,
    drift_windows,
    evaluate,
    prepare,
    profile,
    quantiles,
    rollups,
    train,
    validate,
)
from mlwatch.plans import monitor, retrain, views
from mlwatch.sources import files, history
from mlwatch.sources.shared import discard, scratch_path, written
from mlwatch.spec import PREDICTION_LATENCY_BOUNDS, REQUEST_LATENCY_BOUNDS, Rule, TRIP_SPEC
from mlwatch.streaming import drift as stream_drift_check, runtime
from mlwatch.streaming import score as stream_score, windows as stream_windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NUMERIC = list(TRIP_SPEC.drift_numeric)
CATEGORICAL = list(TRIP_SPEC.drift_categorical)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(*names: str, digits: int = 6) -> list[Column]:
    return [F.round(name, digits).alias(name) for name in names]


DRIFT_VALUES = ("psi", "kl_divergence", "js_divergence")
MOMENTS = ("reference_mean", "current_mean", "reference_std", "current_std")


@query
def feature_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drift(spark, sf_dir, NUMERIC, CATEGORICAL, shifted=True).select(
        "feature", *rounded(*DRIFT_VALUES), "severity", *rounded(*MOMENTS), "reference_rows", "current_rows",
        "reference_odd", "current_odd",
    )


# ---- sources and sinks


@query
def scan_union_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items written as two tables of different types, read as one."""
    lines = views.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"
    )
    odd = F.col("l_orderkey") % 2 == 1
    first, second = scratch_path(spark, "part"), scratch_path(spark, "part")
    lines.filter(odd).withColumn("l_quantity", F.col("l_quantity").cast("bigint")).drop(
        "l_returnflag"
    ).write.parquet(first)
    lines.filter(~odd).write.parquet(second)
    return (
        files.read_union(spark, [first, second], {"l_quantity": "double"})
        .groupBy("l_linenumber", "l_returnflag")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    )


@query
def csv_snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [*views.KEYS, "trip_distance", "passenger_count", "pickup_borough", "fare_amount"]
    rows = views.trips(spark, sf_dir).select(*columns)
    path = scratch_path(spark, "reference-csv")
    files.write_snapshot(rows, path, views.KEYS, rows=1000)
    return files.read_table(spark, path, rows.schema)


@query
def append_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prediction log arrives in two overlapping halves; every request is kept once."""
    rows = views.preds(spark, sf_dir)
    path = scratch_path(spark, "prediction-log")
    history.append_unique(rows.filter("k < 60"), path, "request_id", "ts")
    history.append_unique(
        rows.filter("k >= 40"), path, "request_id", "ts", dates_fixed_by_key=True
    )
    return (
        history.read_history(spark, path)
        .groupBy("date", "model_name")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_distinct("request_id").alias("requests"),
            F.round(F.sum("predicted_fare"), 2).alias("fares"),
        )
    )


@query
def table_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = views.table(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_type").alias("prediction"),
        F.lit(0.5).alias("probability"),
        F.when(F.col("user_id") % 3 != 0, F.col("value")).alias("predicted_fare"),
    )
    new = history.upgrade_table(
        old, drop=["prediction", "probability"], add={"predicted_fare": 0.0}
    )
    history.assert_not_null(new, ["predicted_fare"])
    return new


@query
def reference_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(views.featured(spark, sf_dir).select(*TRIP_SPEC.columns, "pickup_ts"), "features")
    path = scratch_path(spark, "references")
    early = rows.filter(F.col("pickup_ts") < F.lit(views.DRIFT_SPLIT).cast("timestamp_ntz"))
    for name, sample, day in (("first", early, "2024-01-01"), ("second", rows, "2024-02-01")):
        entry = history.reference_entry(
            sample,
            name,
            "fare",
            TRIP_SPEC.features,
            ["trip_distance", "fare_amount"],
            f"{day} 00:00:00",
            f"references/{name}",
        )
        history.append_unique(entry, path, "name", "created_at")
    moments = "struct<mean:double,min:double,max:double>"
    stats = f"struct<trip_distance:{moments},fare_amount:{moments}>"
    return (
        history.active_reference(history.read_history(spark, path))
        .withColumn("s", F.from_json("dataset_stats", stats))
        .select(
            "name",
            "model_name",
            "sample_count",
            "feature_count",
            "storage_path",
            F.round("s.trip_distance.mean", 4).alias("distance_mean"),
            F.round("s.trip_distance.max", 4).alias("distance_max"),
            F.round("s.fare_amount.mean", 4).alias("fare_mean"),
            F.round("s.fare_amount.min", 4).alias("fare_min"),
        )
    )


@query
def log_window_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.recent_log(views.preds(spark, sf_dir), "2024-01-15 12:00:00", 24, "m1")


# ---- features, bins, hashes, requests


@query
def time_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.featured(spark, sf_dir).select(
        *views.KEYS,
        F.round("trip_duration_minutes", 6).alias("trip_duration_minutes"),
        "pickup_hour",
        "pickup_day_of_week",
        "pickup_month",
        "is_weekend",
        "is_rush_hour",
    )


@query
def zone_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = views.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    zones = views.repeated_zones(spark, sf_dir)
    one = prepare.lookup(customer, zones, "c_nationkey", "n_nationkey", "r_name", "zone")
    return prepare.lookup(
        one, zones, "c_nationkey", "n_nationkey", "r_name", "zone_or_unknown", missing="Unknown"
    )


@query
def prepare_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = prepare.prepare(views.featured(spark, sf_dir), views.SPEC, keep=views.KEYS)
    return ready.withColumns(
        {c: F.round(c, 6) for c in ("trip_distance", "trip_duration_minutes", "fare_amount")}
    )


@query
def feature_target_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per column role and categorical text length, from both halves of the split."""
    rows = written(views.featured(spark, sf_dir).select(*TRIP_SPEC.columns), "features")  # both halves are read
    features, target = prepare.feature_target_split(rows)
    text = prepare.categories_as_text(features)
    widths = text.agg(
        *[F.sum(F.length(c)).cast("double").alias(c) for c in TRIP_SPEC.categorical],
        *[
            F.round(F.sum(c), 2).cast("double").alias(c)
            for c in (*TRIP_SPEC.numeric, *TRIP_SPEC.binary)
        ],
    )
    cells = [
        F.struct(F.lit(c).alias("column"), F.col(c).alias("total")) for c in TRIP_SPEC.features
    ]
    totals = widths.select(F.explode(F.array(*cells)).alias("c")).select("c.*").unionByName(
        target.agg(F.round(F.sum(TRIP_SPEC.target), 2).alias("total")).select(
            F.lit(TRIP_SPEC.target).alias("column"), "total"
        )
    )
    roles = TRIP_SPEC.as_frame(spark).select("column", "role", "position")
    return totals.join(F.broadcast(roles), "column")  # one row per column of the spec


@query
def feature_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.featured(spark, sf_dir).groupBy(
        fn.distance_bin("trip_distance").alias("distance_bin"),
        fn.duration_bin("trip_duration_minutes").alias("duration_bin"),
        fn.hour_bin("pickup_hour").alias("hour_bin"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query
def pack_unpack_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics packed and unpacked again for trips with gaps, and unpacked from the raw log."""
    packed = views.dirty(spark, sf_dir).select(
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").alias("part"),
        fn.pack_stats().alias("stats"),
    )
    logged = views.preds(spark, sf_dir).select(
        F.col("request_id").alias("id"), F.lit(0).alias("part"), F.col("numeric_feature_stats").alias("stats")
    )
    unpacked = fn.unpack_stats(packed.unionByName(logged), "stats").drop("stats")
    return unpacked.withColumns(
        {
            "trip_distance": F.round(F.nanvl("trip_distance", F.lit(-1.0)), 6),
            "trip_duration_minutes": F.round("trip_duration_minutes", 6),
        }
    )


@query
def feature_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [*TRIP_SPEC.categorical, "passenger_count", "pickup_hour"]
    return views.featured(spark, sf_dir).select(
        *views.KEYS,
        fn.feature_hash(names).alias("feature_hash"),
        fn.stable_id(F.col("l_orderkey"), F.col("l_linenumber"), prefix="decision-").alias("run_id"),
    )


@query
def baseline_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.featured(spark, sf_dir).select(
        *views.KEYS, fn.baseline_fare().alias("predicted_fare")
    ).withColumn("prediction_label", fn.score_label(F.col("predicted_fare")))


@query
def request_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.requests(spark, sf_dir)
    return rows.filter(~req.is_excluded("path")).select(
        "event_id",
        req.endpoint("path").alias("endpoint"),
        req.client_ip("forwarded", "peer").alias("client_ip"),
        req.error_type("status").alias("error_type"),
        req.log_level("status").alias("log_level"),
    )


# ---- filters and samples


@query
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and fare sums of the 80/20 split, of a capped sample and of a fixed-size sample."""
    rows = written(views.trips(spark, sf_dir).select(*views.KEYS, "fare_amount"), "fares")
    train, test = prepare.split_by_key(rows, views.KEYS)
    capped = prepare.cap_by_key(rows, views.KEYS, cap=5000)
    fixed = prepare.fixed_sample(rows, views.KEYS, 100)

    def summary(name: str, part: DataFrame) -> DataFrame:
        return part.agg(
            F.count(F.lit(1)).alias("n"), F.round(F.sum("fare_amount"), 2).alias("fares")
        ).select(F.lit(name).alias("part"), "n", "fares")

    return (
        summary("train", train)
        .unionByName(summary("test", test))
        .unionByName(summary("capped", capped))
        .unionByName(summary("fixed", fixed))
    )


@query
def sample_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model-days with enough predictions, and how many of the watched features they could use."""
    rows = views.preds(spark, sf_dir)
    numeric, categorical, skipped = TRIP_SPEC.common_features(
        [*TRIP_SPEC.features, "k"], [*views.featured(spark, sf_dir).drop("payment_type").columns, "other"]
    )
    return (
        rows.groupBy("model_name", F.to_date("ts").alias("day"))
        .agg(F.count(F.lit(1)).alias("samples"))
        .filter("samples >= 100")
        .withColumns(
            {
                "common": F.lit(len(numeric) + len(categorical)),
                "skipped": F.lit(len(skipped)),
            }
        )
    )


# ---- validation


@query
def validate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.dirty(spark, sf_dir).select(*TRIP_SPEC.columns)
    return validate.validation_report(rows, views.SPEC).withColumn("found", F.round("found", 6))


@query
def validate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = validate.validate_rows(views.dirty(spark, sf_dir), views.SPEC)
    codes = F.transform("errors", lambda e: F.concat(e["feature"], F.lit(":"), e["type"]))
    return checked.select(
        *views.KEYS,
        F.size("errors").alias("error_count"),
        F.array_join(F.array_sort(codes), ",").alias("codes"),
    )


@query
def quarantine_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.dirty(spark, sf_dir).select(*TRIP_SPEC.columns)
    checked = written(validate.validate_rows(rows, views.SPEC), "checked")
    kept = validate.accepted(checked).agg(F.count(F.lit(1)).alias("failures"))
    failed = validate.failure_counts(validate.quarantined(checked))
    values = validate.invalid_values(checked, views.SPEC).select(
        F.concat(F.lit("invalid:"), F.col("value")).alias("type"),
        F.col("column").alias("feature"),
        F.col("rows").alias("failures"),
    )
    return failed.unionByName(
        kept.select(F.lit("accepted").alias("type"), F.lit("").alias("feature"), "failures")
    ).unionByName(values)


JSON_RULES = [
    Rule("k", "int", minimum=0, maximum=79),
    Rule("value", "float", minimum=0.5, maximum=400.0),
    Rule("event_type", "str", allowed=("click", "view", "purchase", "signup")),
]


@query
def validate_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw JSON records, some with text, fractions, nulls, gaps, extra keys or no JSON."""
    events = views.events_with_k(spark, sf_dir)
    k, marker = F.col("k"), F.col("event_id") % 8
    number = (
        F.when(marker == 1, F.concat(F.lit('"'), k.cast("string"), F.lit('"')))
        .when(marker == 2, F.lit('"many"'))
        .when(marker == 3, F.concat(k.cast("string"), F.lit(".5")))
        .when(marker == 4, F.lit("null"))
        .otherwise(k.cast("string"))
    )
    record = F.concat(
        F.lit('{"k": '),
        number,
        F.when(marker == 5, F.lit(', "note": 1')).otherwise(F.lit("")),
        F.when(marker == 6, F.lit("")).otherwise(
            F.concat(F.lit(', "value": '), F.col("value").cast("decimal(12,2)").cast("string"))
        ),
        F.lit(', "event_type": "'),
        F.col("event_type"),
        F.when(marker == 7, F.lit('"')).otherwise(F.lit('"}')),
    )
    checked = events.select("event_id", record.alias("record"))
    checked = validate.validate_json(checked, "record", JSON_RULES)
    codes = F.transform("errors", lambda e: F.concat(e["feature"], F.lit(":"), e["type"]))
    return checked.select(
        "event_id",
        F.size("errors").alias("error_count"),
        F.array_join(F.array_sort(codes), ",").alias("codes"),
    )


# ---- profiles


@query
def profile_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.table_shape(views.dirty(spark, sf_dir).select(*TRIP_SPEC.columns))


@query
def profile_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [*TRIP_SPEC.numeric, TRIP_SPEC.target]
    rows = written(views.dirty(spark, sf_dir).select(*columns), "features")
    return profile.numeric_profile(rows, columns).select(
        "feature", *rounded("mean", "std", "min", "max", "median")
    )


@query
def profile_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.categorical_profile(
        views.dirty(spark, sf_dir), [*TRIP_SPEC.categorical, *TRIP_SPEC.binary]
    )


@query
def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(views.featured(spark, sf_dir).select(*TRIP_SPEC.columns), "features")
    return profile.dataset_stats(rows, TRIP_SPEC).withColumn("value", F.round("value", 6))


# ---- drift


@query
def histogram_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(views.sided(spark, sf_dir, shifted=True).select("side", *NUMERIC), "features")
    return drift.histogram_pair(rows, NUMERIC).select(
        "feature", "bin", "reference_n", "current_n", *rounded("reference_share", "current_share", digits=8)
    )


def _drift(spark: SparkSession, sf_dir: str, numeric: list[str], categorical: list[str], shifted: bool):
    rows = views.sided(spark, sf_dir, shifted).select("side", *numeric, *categorical)
    return drift.feature_drift(written(rows, "features"), numeric, categorical)


@query
def psi_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drift(spark, sf_dir, NUMERIC, [], True).select("feature", *rounded("psi"), "severity")


@query
def psi_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drift(spark, sf_dir, [], CATEGORICAL, True).select("feature", *rounded("psi"), "severity")


@query
def kl_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drift(spark, sf_dir, NUMERIC, [], True).select(
        "feature", *rounded("kl_divergence", "js_divergence")
    )


@query
def moments_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.sided(spark, sf_dir).select("side", *NUMERIC)
    return drift.paired_moments(drift.feature_moments(rows, NUMERIC, [], []), []).select(
        "feature", "reference_count", "current_count", *rounded(*MOMENTS)
    )


@query
def prediction_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later trips' baseline score against the earlier trips' fare."""
    score = F.when(F.col("side") == "reference", F.col("fare_amount")).otherwise(fn.baseline_fare())
    rows = views.sided(spark, sf_dir).select("side", score.alias("prediction"))
    return drift.feature_drift(written(rows, "features"), ["prediction"]).select(
        "feature", *rounded("psi"), "severity", *rounded(*MOMENTS)
    )


WINDOW_NUMERIC = ["predicted_fare", "latency_ms", "k", "prediction"]
WINDOW_CATEGORICAL = ["model_version", "k_class"]


def _model_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of every model and day from the second week on, against the model's first week.

    Fares rise and classes shift over the days, so that both outcomes occur.
    """
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-08").cast("date"))
    late = F.greatest(day, F.lit(0))
    rows = views.preds(spark, sf_dir).select(
        "model_name",
        F.to_date("ts").alias("day"),
        (F.col("predicted_fare") * (1 + late / 40.0)).alias("predicted_fare"),
        (F.col("latency_ms") + late * 0.5).alias("latency_ms"),
        "k",
        (F.col("predicted_fare") * (1 + late / 60.0)).alias("prediction"),
        "model_version",
        ((F.col("k") + late * 3) % 100 - (F.col("k") + late * 3) % 25).cast("int").alias("k_class"),
    )
    rows = written(rows, "model-days")
    first_week = F.col("day") < F.lit("2024-01-08").cast("date")
    found = drift_windows.shared_reference_drift(
        rows.filter(first_week),
        rows.filter(~first_week),
        WINDOW_NUMERIC,
        WINDOW_CATEGORICAL,
        by=["model_name", "day"],
        reference_by=["model_name"],
    )
    ts = F.col("day").cast("timestamp_ntz")
    return drift.drift_verdict(found, by=["model_name", "day"]).select(
        fn.stable_id(F.col("model_name"), F.col("day")).alias("run_id"), ts.alias("ts"), "*"
    )


@query
def monitor_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monitor from end to end: a year of scored trips, logged with packed features, against the trips before."""
    trips = views.sided(spark, sf_dir, shifted=True).filter("l_partkey % 211 <> 0")
    log = trips.select(
        F.concat(F.lit("m"), (F.col("l_suppkey") % 2).cast("string")).alias("model_name"),
        F.col("pickup_ts").alias("ts"),
        fn.baseline_fare().alias("predicted_fare"),
        fn.pack_stats().alias("numeric_feature_stats"),
    )
    before = views.sided(spark, sf_dir).filter("side = 'reference'")
    reference = before.select(*NUMERIC, *CATEGORICAL, F.col("fare_amount").alias("prediction"))
    config = monitor.MonitorConfig(
        numeric=(*NUMERIC, "prediction"),
        categorical=tuple(CATEGORICAL),
        runs_path=scratch_path(spark, "drift-runs"),
        alerts_path=scratch_path(spark, "drift-alerts"),
        hours=24 * 366,
    )
    as_of = "2000-06-30 00:00:00"
    runs = monitor.check_log(reference, log, as_of, config)
    alerts = history.read_history(spark, config.alerts_path)
    end = F.lit(as_of).cast("timestamp_ntz")
    summary = rollups.drift_summary(runs, end, 24).select("model_name", F.col("runs").cast("int").alias("runs"))
    raised = alerts.select("run_id", F.col("severity").alias("alert_severity"))
    named = F.transform("feature_details", lambda d: F.concat(d["feature"], F.lit(":"), d["severity"]))
    return runs.join(raised, "run_id", "left").join(summary, "model_name").select(
        "model_name",
        "reference_sample_count",
        "current_sample_count",
        *rounded("max_psi", "avg_psi", "prediction_psi"),
        "drift_count",
        "drift_detected",
        F.array_join(named, ",").alias("details"),
        "alert_severity",
        "runs",
    )


@query
def window_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature drift of two groups sharing one reference: the later trips by payment type."""
    rows = written(
        views.sided(spark, sf_dir, shifted=True).select(
            "side", "payment_type", *NUMERIC, "pickup_borough", "RatecodeID"
        ),
        "features",
    )
    return drift_windows.shared_reference_drift(
        rows.filter("side = 'reference'"),
        rows.filter("side = 'current'"),
        NUMERIC,
        ["pickup_borough", "RatecodeID"],
        by=["payment_type"],
    ).select(
        "payment_type",
        "feature",
        *rounded(*DRIFT_VALUES),
        "severity",
        *rounded(*MOMENTS),
        "reference_rows",
        "current_rows",
        "reference_odd",
        "current_odd",
    )


@query
def drift_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model_days(spark, sf_dir).select(
        "run_id",
        "model_name",
        "day",
        "reference_sample_count",
        "current_sample_count",
        *rounded("max_psi", "avg_psi", "prediction_psi"),
        F.array_join("features_with_drift", ",").alias("features_with_drift"),
        "drift_count",
        "drift_detected",
        "prediction_drift_detected",
    )


@query
def drift_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = written(
        _model_days(spark, sf_dir).withColumn("metric_id", F.dayofyear("day")), "drift-runs"
    )
    alerts = decide.alerts_with_metric(decide.drift_alerts(runs), runs, "metric_id")
    return decide.open_alerts(alerts).select(
        "alert_id",
        "run_id",
        "created_at",
        "severity",
        "message",
        F.array_join("features_affected", ",").alias("features_affected"),
        "acknowledged",
        "drift_metric_id",
    )


@query
def drift_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = written(_model_days(spark, sf_dir), "drift-runs")
    as_of = F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")  # later runs are no part of it
    summary = rollups.drift_summary(runs, as_of, 24 * 10, views.preds(spark, sf_dir))
    trigger = decide.retrain_trigger(runs).select("model_name", "should_retrain")
    return summary.join(trigger, "model_name", "left").select(
        "model_name",
        "runs",
        "drift_detected_count",
        *rounded("avg_max_psi", "avg_avg_psi"),
        F.col("latest.run_id").alias("latest_run_id"),
        F.col("latest.drift_count").alias("latest_drift_count"),
        F.array_join("latest.features_with_drift", ",").alias("latest_features"),
        F.col("latest.current_sample_count").alias("latest_samples"),
        F.coalesce("should_retrain", F.lit(False)).alias("should_retrain"),
    )


# ---- evaluation and decisions


@query
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.featured(spark, sf_dir).withColumn("prediction", fn.baseline_fare())
    return evaluate.regression_metrics(rows, "fare_amount", "prediction", by=["payment_type"]).select(
        "payment_type", "samples", *rounded("rmse", "mae", "r2", "mape")
    )


@query
def latency_by_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.latency_by(views.preds(spark, sf_dir), ["model_name", "model_version"]).select(
        "model_name", "model_version", "samples", *rounded("avg_latency_ms", "p95_latency_ms")
    )


@query
def narrowed_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of the log per model with a buffer of a few rows, so that brackets are narrowed in several rounds."""
    found = quantiles.narrowed_quantiles(
        views.preds(spark, sf_dir), ["latency_ms", "predicted_fare"], [0.05, 0.5, 0.95], ["model_name"], open_rows=20
    )
    return found.select("model_name", "feature", "probability", *rounded("value"))


@query
def traffic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = views.requests(spark, sf_dir).select(F.col("event_id").alias("request_id"), "status")
    # a request that failed has no prediction
    logged = views.preds(spark, sf_dir).filter("request_id % 9 <> 0")
    rows = requests.join(logged, "request_id", "left")
    return evaluate.traffic_summary(rows, by=["model_name"]).select(
        "model_name",
        "total",
        "successes",
        "failures",
        *rounded("avg_fare", "min_fare", "max_fare", "avg_latency_ms"),
    )


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.replay_promotions(views.versions(spark, sf_dir))


@query
def promotion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir).select(
        "model_name",
        "challenger_version",
        "champion_version",
        "validation_passed",
        "metric_improvement",
        "latency_acceptable",
        "promoted",
        *rounded("primary_metric_improvement", "latency_ratio"),
        F.size("rejection_reasons").alias("reasons"),
        "promotion_reason",
    )


@query
def champion_challenger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scores of the same trips: the baseline tariff against a fitted-looking challenger."""
    rows = views.featured(spark, sf_dir).select(
        "payment_type",
        "fare_amount",
        fn.baseline_fare().alias("champion"),
        (F.col("fare_amount") + (F.col("l_partkey") % 21 - 10) * 2.0).alias("challenger"),
    )
    metrics = evaluate.compare_scores(
        rows, "fare_amount", "champion", "challenger", by=["payment_type"]
    )
    return metrics.select("payment_type", *rounded(*metrics.columns[1:]))


@query
def production_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = written(_decisions(spark, sf_dir), "decisions")
    newest = decide.latest_version(
        decisions.select("model_name", F.col("challenger_version").alias("model_version"))
    )
    return decide.production_alias(decisions).join(newest, "model_name")


@query
def champion_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who was champion at each recorded decision, read back from the decisions alone."""
    recorded = _decisions(spark, sf_dir).select(
        "model_name", "decision_id", "decided_at", "challenger_version", "promoted"
    )
    return decide.champion_before(recorded)


@query
def recent_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten newest decisions with the drift and retraining run they belong to."""
    decisions = written(
        _decisions(spark, sf_dir).withColumn(
            "trigger_type", F.when(F.col("challenger_version") % 2 == 0, "drift").otherwise("scheduled")
        ),
        "decisions",
    )
    drift_runs = decisions.filter("trigger_type = 'drift'").select(
        fn.stable_id(F.col("model_name"), F.col("decided_at").cast("date")).alias("run_id"),
        (F.col("challenger_version") * 0.1).alias("max_psi"),
        F.col("challenger_version").alias("drift_count"),
    )
    error = F.when(F.col("challenger_version") == 4, "out of memory")
    status = decide.run_status(
        F.col("trigger_type"), F.lit(False), F.col("challenger_version") != 2, error
    )
    runs = decisions.select(
        F.col("decision_id").alias("promotion_decision_id"),
        fn.stable_id(F.col("model_name"), F.col("decided_at").cast("date")).alias("drift_run_id"),
        status.alias("status"),
        decide.run_outcome(status).alias("outcome"),
    )
    outcomes = decisions.select("decision_id", "promoted", "primary_metric_improvement")
    linked = decide.lineage(runs, drift_runs, outcomes)
    newest = decide.recent_decisions(decisions)
    return newest.join(
        linked.select(
            F.col("promotion_decision_id").alias("decision_id"),
            "status",
            "outcome",
            "drift_max_psi",
            "drift_count",
        ),
        "decision_id",
    ).withColumns(
        {
            "primary_metric_improvement": F.round("primary_metric_improvement", 6),
            "drift_max_psi": F.round("drift_max_psi", 6),
        }
    ).orderBy(F.col("decided_at").desc(), "decision_id")


# ---- rollups


def _endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.requests(spark, sf_dir)
    return rows.filter(~req.is_excluded("path")).withColumns(
        {"endpoint": req.endpoint("path"), "error_type": req.error_type("status")}
    )


@query
def counter_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request and error counters in one frame."""
    rows = _endpoints(spark, sf_dir)
    requests = rollups.counter(rows, ["method", "endpoint", "status"])
    errors = rollups.counter(rows.filter("error_type is not null"), ["endpoint", "error_type"])
    return requests.select(
        F.lit("requests").alias("metric"), "method", "endpoint", F.col("status").alias("label"), "total"
    ).unionByName(
        errors.select(
            F.lit("errors").alias("metric"),
            F.lit("").alias("method"),
            "endpoint",
            F.col("error_type").alias("label"),
            "total",
        )
    )


@query
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = rollups.histogram(
        _endpoints(spark, sf_dir), "latency_seconds", ["method", "endpoint"], REQUEST_LATENCY_BOUNDS
    )
    return rolled.withColumns({"sum": F.round("sum", 6), "avg": F.round("avg", 6)})


@query
def prediction_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency histogram of the prediction log, in seconds."""
    rows = views.preds(spark, sf_dir).withColumn("latency_seconds", F.col("latency_ms") / 1000.0)
    rolled = rollups.histogram(
        rows, "latency_seconds", ["model_name", "model_version"], PREDICTION_LATENCY_BOUNDS
    )
    return rolled.withColumns({"sum": F.round("sum", 6), "avg": F.round("avg", 6)})


@query
def metric_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions by label, drift checks and events, promotions, retrainings, model reloads with the model each leaves
    current, and validation failures: one pass over each log for all its counters."""
    predicted = rollups.counters(
        views.preds(spark, sf_dir),
        {
            "predictions": (
                [F.col("model_name"), F.col("model_version"), fn.score_label(F.col("predicted_fare"))],
                None,
            )
        },
    )
    runs = rollups.counters(
        _model_days(spark, sf_dir),
        {
            "drift_checks": ([F.col("model_name")], None),
            "drift_events": ([F.lit("feature"), alert_severity(F.col("max_psi"))], F.col("drift_detected")),
        },
    )
    version = F.col("challenger_version")
    trigger = F.when(version % 2 == 0, "drift").otherwise("scheduled")
    status = decide.run_status(trigger, F.lit(False), version != 2, F.when(version == 4, "out of memory"))
    decisions = written(_decisions(spark, sf_dir), "decisions")
    decided = rollups.counters(
        decisions,
        {
            "promotions": ([F.col("champion_version"), version], F.col("promoted")),
            "retraining_runs": ([trigger, decide.run_outcome(status)], None),
            # a service loads a model when it becomes the champion
            "model_reloads": ([F.col("model_name"), F.lit("success")], F.col("promoted")),
        },
    )
    current = rollups.gauge_last(
        decisions.filter("promoted"), ["model_name"], "challenger_version", ["decided_at", "challenger_version"]
    ).select(
        F.lit("current_model").alias("metric"), F.array("model_name").alias("labels"), F.col("value").cast("long").alias("total")
    )
    checked = validate.validate_rows(views.dirty(spark, sf_dir), views.SPEC)
    failed = rollups.counters(
        checked.select(F.explode("errors.type").alias("failure_type")),
        {"validation_failures": ([F.lit("/predict"), F.col("failure_type")], None)},
    )
    parts = [predicted, runs, decided, current, failed]
    return reduce(DataFrame.unionByName, parts).withColumn("labels", F.array_join("labels", "|"))


@query
def gauge_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last latency of every model version, and a gauge replayed from set/inc/dec events."""
    rows = views.preds(spark, sf_dir)
    last = rollups.gauge_last(rows, ["model_name", "model_version"], "latency_ms", ["ts", "request_id"])
    operation = F.when(F.col("k") == 0, "set").when(F.col("k") % 2 == 0, "inc").otherwise("dec")
    replayed = rollups.gauge_replay(
        rows.withColumn("operation", operation),
        ["model_name", "model_version"],
        "operation",
        "latency_ms",
        ["ts", "request_id"],
    )
    return last.join(
        replayed.withColumnRenamed("value", "replayed"), ["model_name", "model_version"]
    ).withColumn("replayed", F.round("replayed", 6))


# ---- models


@query
def encode_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and non-zero entries of the feature vectors, per payment type."""
    ready = prepare.prepare(views.featured(spark, sf_dir), views.SPEC)
    encoded = train.encode(written(ready, "features"), views.SPEC)
    size = F.size(vector_to_array("features"))
    filled = F.size(F.filter(vector_to_array("features"), lambda v: v != 0))
    return encoded.groupBy(F.col("payment_type").cast("int").alias("payment_type")).agg(
        F.count(F.lit(1)).alias("rows"), F.max(size).alias("length"), F.round(F.avg(filled), 6).alias("filled")
    )


def _fitting_and_testing(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The prepared trips split by key, each part written once: training and scoring read them many times, and every
    read of a split that is not written hashes all keys again."""
    ready = written(prepare.prepare(views.featured(spark, sf_dir), views.SPEC, keep=views.KEYS), "features")
    split = prepare.split_by_key(ready, views.KEYS)
    parts = [written(part, label) for part, label in zip(split, ("fitting", "testing"))]
    discard(ready)
    return parts


@query
def train_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on the prepared trips, save, load and score: what holds of any right model, one fact per row."""
    fitting, testing = _fitting_and_testing(spark, sf_dir)
    model, metrics = train.run_training(fitting, testing, views.SPEC)
    root = scratch_path(spark, "models")
    train.save_version(model, root, "fare", 1)
    scored = written(train.score_or_baseline(spark, testing, root, "fare", 1, views.SPEC), "scored")
    reloaded = scored.withColumnRenamed("predicted_fare", "reloaded").drop("prediction")
    again = train.score(model, reloaded, views.SPEC)
    fallback = train.score_or_baseline(spark, testing, root, "fare", 2, views.SPEC)
    broken = fitting.withColumn("trip_distance", F.lit(500.0))
    refused = validate.validation_summary(validate.validation_report(broken, views.SPEC))

    def fact(name: str, frame: DataFrame, value: Column) -> DataFrame:
        return frame.agg(value.cast("double").alias("value")).select(F.lit(name).alias("fact"), "value")

    rows = scored.groupBy("payment_type").agg(F.count("*").cast("double").alias("value"))
    # the fares of the fixture hang on nothing, so only the rows it was fitted to can be closer than their mean
    fitted = evaluate.regression_metrics(
        train.score(model, fitting, views.SPEC), "fare_amount", "prediction", extra=[F.stddev_pop("fare_amount").alias("spread")]
    )
    fare = F.col("predicted_fare")
    evaluator = RegressionEvaluator(labelCol="fare_amount", predictionCol="prediction", metricName="rmse")
    apart = F.abs(F.col("rmse") / evaluator.evaluate(scored) - 1)
    facts = [
        fact("rmse as the evaluator has it", metrics, F.max((apart < 1e-9).cast("int"))),
        rows.select(F.concat(F.lit("rows of payment type "), "payment_type").alias("fact"), "value"),
        fact("train rows", metrics, F.max("train_samples")),
        fact("test rows", metrics, F.max("test_samples")),
        fact("closer than the mean", fitted, F.min((F.col("rmse") < F.col("spread")).cast("int"))),
        fact("fares under the floor", scored, F.count_if(fare < 2.5)),
        fact("fares not in cents", scored, F.count_if(fare != F.round(fare, 2))),
        fact("reloaded scores that differ", again, F.count_if(fare != F.col("reloaded"))),
        fact("fallback fares", fallback, F.round(F.sum(fare), 2)),
        fact("good table passes", validate.validation_summary(validate.validation_report(fitting, views.SPEC)), F.max(F.col("success").cast("int"))),
        fact("broken table passes", refused, F.max(F.col("success").cast("int"))),
        fact("errors of the broken table", refused, F.max("errors")),
    ]
    return reduce(DataFrame.unionByName, facts)


@query
def retrain_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retraining from trigger to records: a calm model, broken data, and a first model that is promoted."""
    fitting, testing = _fitting_and_testing(spark, sf_dir)
    drift_runs = spark.createDataFrame(
        [("r1", "fare", True, 4, 0.4), ("r0", "calm", False, 1, 0.1)],
        "run_id string, model_name string, drift_detected boolean, drift_count int, max_psi double",
    ).withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    paths = [scratch_path(spark, n) for n in ("models", "decisions", "runs")]

    def run(model: str, at: str, test: DataFrame, trigger: str = "drift") -> None:
        config = retrain.RetrainConfig(model, *paths, spec=views.SPEC)
        retrain.run_retraining(spark, drift_runs, fitting, test, config, None, 1, at, trigger_type=trigger)

    run("calm", "2024-01-02 00:00:00", testing)
    try:
        run("fare", "2024-01-03 00:00:00", testing.withColumn("fare_amount", F.lit(0.0)), "manual")
    except ValueError:
        pass  # recorded as failed
    run("fare", "2024-01-04 00:00:00", testing)
    runs, decisions = (history.read_history(spark, p) for p in paths[:0:-1])
    linked = decide.lineage(
        runs.drop("promoted", "drift_max_psi", "drift_count"), drift_runs, decisions
    ).join(rollups.counter(runs, ["trigger_type", "outcome"]).withColumnRenamed("total", "like_it"), ["trigger_type", "outcome"])
    chosen = decisions.select(
        F.col("decision_id").alias("promotion_decision_id"), "promotion_reason", "latency_ratio",
        (F.col("challenger_rmse") == F.col("primary_metric_improvement")).alias("gain_is_rmse"),
    )
    return linked.join(chosen, "promotion_decision_id", "left").select(
        "model_name", "trigger_type", "status", "outcome", "drift_run_id", "drift_count", "drift_max_psi", "promoted",
        "model_version", "promotion_reason", "latency_ratio", "gain_is_rmse", "like_it",
        F.col("error_message").contains("fare_amount").alias("names_the_column"),
        F.col("rmse").isNotNull().alias("measured"),
    )


@query
def retrain_champion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first model and three challengers in turn, with a log of shadow latencies: one is too slow, one is promoted,
    one predicts worse than the champion. Champions come from the decisions recorded before."""
    fitting, testing = _fitting_and_testing(spark, sf_dir)
    poor = fitting.withColumn("fare_amount", 200 - F.col("fare_amount") / 100)  # valid fares that teach nothing
    slow = F.when(F.col("model_version") == 2, 2.0).otherwise(1.0)
    shadow = views.preds(spark, sf_dir).withColumns(
        {"model_name": F.lit("fare"), "latency_ms": F.col("latency_ms") * slow}
    )
    no_drift = spark.createDataFrame(
        [], "run_id string, model_name string, drift_detected boolean, drift_count int, max_psi double, ts timestamp_ntz"
    )
    models, decided, runs = (scratch_path(spark, n) for n in ("models", "decisions", "runs"))
    config = retrain.RetrainConfig("fare", models, decided, runs, spec=views.SPEC)
    for version, rows in enumerate((poor, fitting, fitting, poor), 1):
        champion = None
        if version > 1:  # one row per model
            champion = decide.production_alias(history.read_history(spark, decided)).first()["production_version"]
        retrain.run_retraining(
            spark, no_drift, rows, testing, config, champion, version, f"2024-01-0{version} 00:00:00", shadow, "scheduled"
        )
    gain = F.col("champion_rmse") - F.col("challenger_rmse")
    apart = F.abs(F.col("primary_metric_improvement") - F.coalesce(gain, F.col("challenger_rmse")))
    return history.read_history(spark, decided).select(
        "challenger_version", "champion_version", "trigger_type", "validation_passed", "metric_improvement",
        "latency_acceptable", "promoted", *rounded("latency_ratio", "champion_avg_latency_ms", "challenger_avg_latency_ms"),
        *rounded("champion_p95_latency_ms", "challenger_p95_latency_ms"),
        F.array_join(F.transform("rejection_reasons", lambda r: F.substring_index(r, " ", 2)), ";").alias("reasons"),
        (apart < 1e-9).alias("gain_is_rmse"),
    )


@query
def table_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column sets, success flags, features in common, skipped writes and version choice, one fact per row."""
    rows = written(views.featured(spark, sf_dir).select(*TRIP_SPEC.columns), "features")
    path = scratch_path(spark, "once")
    files.write_once(rows, path)
    files.write_once(rows.limit(0), path)  # the table is there: nothing is written
    fewer = rows.drop("pickup_month", "payment_type").withColumn("extra", F.lit(1))
    numeric, categorical, skipped = TRIP_SPEC.common_features(fewer.columns, rows.columns)
    shape = profile.table_shape(files.read_table(spark, path, kind="parquet")).agg(F.max("rows")).first()[0]
    report = written(validate.validation_report(fewer, views.SPEC), "report")
    summary = validate.validation_summary(report).first()
    versions = views.versions(spark, sf_dir)
    facts = {
        "rows written once": shape,
        "common features": len(numeric) + len(categorical),
        "skipped features": len(skipped),
        "extra columns": len(validate.column_differences(fewer, views.SPEC)["extra"]),
        "missing columns": report.filter("rule = 'missing_column' AND failed").count(),
        "success": int(summary["success"]),
        "errors": summary["errors"],
        "warnings": summary["warnings"],
        "latest version": decide.resolve_version(versions, "m1"),
        "explicit version": decide.resolve_version(versions, "m1", 3),
    }
    return spark.createDataFrame([(k, float(v)) for k, v in facts.items()], "fact string, value double")


# ---- streams


def _event_files(spark: SparkSession, sf_dir: str) -> str:
    """Events as a folder that grows in four steps; each step repeats a day of the one before, and the
    second is delivered again at the end."""
    events = views.table(spark, sf_dir, "events")
    path = scratch_path(spark, "event-files")
    days = ("2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22", "2025-01-01")
    bounds = [F.lit(day).cast("timestamp_ntz") for day in days]
    steps = list(zip(bounds, bounds[1:]))
    repeat = F.expr("interval 1 day")
    for i, (start, end) in enumerate([*steps, steps[1]]):
        from_ts = start - repeat if 0 < i < len(steps) else start
        # the first and last step also take what lies outside the month
        inside = F.col("ts") >= from_ts if i else F.lit(True)
        until = F.col("ts") < end if i != len(steps) - 1 else F.lit(True)
        events.filter(inside & until).write.mode("append").parquet(path)
    return path


def _event_table(sf_dir: str) -> str:
    """The events table as a pattern, which a file stream accepts for a single file and a folder alike."""
    return f"{sf_dir}/events.parque[t]"


def _event_stream(spark: SparkSession, path: str, sf_dir: str, files_per_trigger: int | None = 2) -> DataFrame:
    schema = views.table(spark, sf_dir, "events").schema
    runtime.keep_state_off_heap(spark)
    stream = runtime.read_files(spark, path, schema, files_per_trigger)
    return stream.withColumns(
        {"k": F.get_json_object("props", "$.k").cast("int"), "ts": runtime.event_time("ts")}
    )


@query
def stream_score_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _event_files(spark, sf_dir)
    requests = _event_stream(spark, path, sf_dir).select(
        F.col("event_id").alias("request_id"),
        "ts",
        F.to_json(
            F.struct(
                (F.col("k") * 1.1 + 0.5).alias("trip_distance"),
                (F.col("value") / 2.5).alias("trip_duration_minutes"),
                (F.col("user_id") % 7 + 1).cast("int").alias("passenger_count"),
            )
        ).alias("numeric_feature_stats"),
    )
    log, rejects, checkpoint = (scratch_path(spark, n) for n in ("log", "rejects", "checkpoint"))
    stream_score.score_log(requests, log, rejects, checkpoint, watermark="10 days")
    kept = spark.read.parquet(log).select(
        "request_id", "predicted_fare", F.lit("accepted").alias("outcome")
    )
    refused = spark.read.parquet(rejects).select(
        "request_id",
        "predicted_fare",
        F.array_join(F.array_sort(F.col("errors.feature")), ",").alias("outcome"),
    )
    return kept.unionByName(refused)


@query
def stream_window_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed 24-hour windows, moved hourly, of the prediction values per event type."""
    stream = _event_stream(spark, _event_table(sf_dir), sf_dir)
    moments = stream_windows.trailing_moments(stream, "ts", "value", ["event_type"])
    path, checkpoint = scratch_path(spark, "windows"), scratch_path(spark, "checkpoint")
    stream_windows.write_closed(moments, path, checkpoint)
    return spark.read.parquet(path).select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"),
        F.col("window_end").cast("timestamp_ntz").alias("window_end"),
        "event_type",
        "n",
        *rounded("mean", "std", "lo", "hi", digits=9),
    )


@query
def stream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed hourly request counts and latency histograms per method and status."""
    events = _event_stream(spark, _event_table(sf_dir), sf_dir)
    rolled = stream_windows.request_rollup(
        views.as_requests(events), "ts", "latency_seconds", ["method", "status"], REQUEST_LATENCY_BOUNDS
    )
    path, checkpoint = scratch_path(spark, "rollup"), scratch_path(spark, "checkpoint")
    stream_windows.write_closed(rolled, path, checkpoint)
    unfolded = rollups.unfold(
        spark.read.parquet(path).withColumn("start", F.col("window_start").cast("timestamp_ntz")),
        ["start", "method", "status"],
        REQUEST_LATENCY_BOUNDS,
    )
    return unfolded.withColumns({"sum": F.round("sum", 6), "avg": F.round("avg", 6)})


def _late_sums(spark: SparkSession, sf_dir: str) -> tuple[str, list[str]]:
    """Hourly request sums kept over five deliveries, each the only one of its batch, under a watermark of 12 hours: every
    delivery repeats a day of the one before, half of which is late, and the last one is late as a whole."""
    events, path = views.table(spark, sf_dir, "events"), scratch_path(spark, "sums")
    source, checkpoint = scratch_path(spark, "deliveries"), scratch_path(spark, "checkpoint")
    latency = F.col("latency_seconds")
    sums = {"count": F.count(latency), "sum": F.sum(latency), "slow": F.count_if(latency > 0.25)}
    for since, until in LATE_DELIVERIES:
        sent = events if since is None else events.filter(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
        sent = sent if until is None else sent.filter(F.col("ts") < F.lit(until).cast("timestamp_ntz"))
        sent.write.mode("append").parquet(source)
        # all files that are new go into one batch
        stream = views.as_requests(_event_stream(spark, source, sf_dir, files_per_trigger=None))
        stream_windows.keep_sums(stream, "ts", ["method", "status"], sums, path, checkpoint, watermark="12 hours")
    return path, list(sums)


LATE_DELIVERIES = (
    (None, "2024-01-08"),
    ("2024-01-07", "2024-01-15"),
    ("2024-01-14", "2024-01-22"),
    ("2024-01-21", None),
    ("2024-01-08", "2024-01-15"),
)


@query
def stream_open_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly request sums of all windows, closed and open, of a stream whose deliveries come partly too late."""
    path, sums = _late_sums(spark, sf_dir)
    found = stream_windows.sums_so_far(spark, path, ["method", "status"], sums, watermark="12 hours")
    return found.select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"),
        F.col("window_end").cast("timestamp_ntz").alias("window_end"),
        "method", "status", "count", F.round("sum", 6).alias("sum"), "slow", "closed",
    )


@query
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each delivery, and those dropped since their windows had closed."""
    path, _ = _late_sums(spark, sf_dir)
    return stream_windows.arrivals(spark, path).select(
        F.col("batch").cast("int").alias("batch"), "rows", "late_rows", "untimed_rows",
        F.col("newest").cast("timestamp_ntz").alias("newest"),
    )


@query
def stream_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All daily verdicts of the continuous check over a growing log, against the first week."""
    return _stream_drift(spark, sf_dir, files_per_trigger=2)


def _stream_drift(spark: SparkSession, sf_dir: str, files_per_trigger: int) -> DataFrame:
    events = _event_stream(spark, _event_files(spark, sf_dir), sf_dir, files_per_trigger)
    stream = stream_score.first_requests(views.as_predictions(events), watermark="10 days")
    reference = views.preds(spark, sf_dir).filter("ts < timestamp_ntz '2024-01-08 00:00:00'")
    config = monitor.MonitorConfig(
        numeric=("latency_ms", "k", "prediction"),
        categorical=("model_version",),
        runs_path=scratch_path(spark, "drift-runs"),
        alerts_path=scratch_path(spark, "drift-alerts"),
        min_samples=1,
        delay_hours=24 * 10,
    )
    stream_drift_check.watch(
        stream.withColumnRenamed("predicted_fare", "prediction"),
        reference.withColumnRenamed("predicted_fare", "prediction"),
        scratch_path(spark, "log"),
        config,
        scratch_path(spark, "checkpoint"),
    )
    return spark.read.parquet(config.runs_path).select(
        "model_name",
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        "reference_sample_count",
        "current_sample_count",
        *rounded("max_psi", "avg_psi", "prediction_psi"),
        F.array_join("features_with_drift", ",").alias("features_with_drift"),
        F.size("feature_details").alias("features"),
        "drift_count",
        "drift_detected",
        "prediction_drift_detected",
    )
