"""The drift check end to end: window, drift, verdict, history, alerts."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from mlwatch.functions.trips import stable_id, unpack_stats
from mlwatch.operators.decide import drift_alerts
from mlwatch.operators.drift import drift_verdict
from mlwatch.operators.drift_windows import ReferenceSummary, shared_reference_drift, summarise_reference
from mlwatch.sources.history import append_unique, as_timestamp, read_history, trailing_window
from mlwatch.sources.shared import discard, scratch_scope, written
from mlwatch.spec import DRIFT_BINS, MIN_SAMPLES, WINDOW_HOURS


@dataclass(frozen=True)
class MonitorConfig:
    """What is watched and where its history goes."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    runs_path: str
    alerts_path: str
    hours: int = WINDOW_HOURS
    every_hours: int = WINDOW_HOURS
    delay_hours: int = 0
    bins: int = DRIFT_BINS
    min_samples: int = MIN_SAMPLES


def check_window(
    reference: DataFrame,
    log: DataFrame,
    as_of: str | datetime,
    config: MonitorConfig,
) -> DataFrame:
    """Verdict per model for the trailing window of the log that ends at ``as_of``.

    Features absent from either table are left out. The run id comes from model and window end, so a check
    that is repeated gives the same row.
    """
    end: Column = as_timestamp(as_of, log.schema["ts"].dataType.simpleString())
    window = trailing_window(log, "ts", as_of, config.hours).withColumn("window_end", end)
    return judge_windows(summarise(reference, log, config), window, config)


def watched(config: MonitorConfig, *tables: DataFrame) -> tuple[list[str], list[str]]:
    """The numeric and categorical features that all the tables have."""
    shared = set.intersection(*(set(t.columns) for t in tables))
    return [c for c in config.numeric if c in shared], [c for c in config.categorical if c in shared]


def summarise(reference: DataFrame, log: DataFrame, config: MonitorConfig) -> ReferenceSummary:
    """The reference as every check needs it, read once."""
    return summarise_reference(reference, *watched(config, reference, log))


def features_of(summary: ReferenceSummary, config: MonitorConfig) -> tuple[list[str], list[str]]:
    """The numeric and categorical features that a summary holds."""
    known = {r[0] for r in summary.moments.select("feature").distinct().collect()}  # the features watched
    return [c for c in config.numeric if c in known], [c for c in config.categorical if c in known]


def judge_windows(
    summary: ReferenceSummary, rows: DataFrame, config: MonitorConfig, counted: bool = False
) -> DataFrame:
    """Verdict per model and ``window_end`` of rows, or of ``counted`` cells, of each window."""
    drift = shared_reference_drift(
        None,
        rows,
        *features_of(summary, config),
        by=["model_name", "window_end"],
        bins=config.bins,
        summary=summary,
        counted=counted,
    )
    end = F.col("window_end")
    return (
        drift_verdict(drift, by=["model_name", "window_end"], min_samples=config.min_samples)
        .withColumn("window_start", end - F.make_dt_interval(F.lit(0), F.lit(config.hours)))
        .withColumn("ts", end)
        .withColumn("run_id", stable_id(F.col("model_name"), F.col("ts")))
    )


def check_log(
    reference: DataFrame,
    log: DataFrame,
    as_of: str | datetime,
    config: MonitorConfig,
    stats: str = "numeric_feature_stats",
) -> DataFrame:
    """The check of a prediction log whose features are packed: window, unpack, judge, record; returns the runs.

    The log's ``predicted_fare`` is watched as the prediction against the reference's. What is watched of both tables is
    written once, since several passes read it: neither what they are derived from nor the packed text is read again.
    """
    unpacked = unpack_stats(trailing_window(log, "ts", as_of, config.hours), stats)
    rows = unpacked.withColumnRenamed("predicted_fare", "prediction")
    names = [name for group in watched(config, reference, rows) for name in group]
    window = written(rows.select("model_name", "ts", *names), "drift-window")
    try:
        models = written(window.select("model_name").distinct(), "drift-models")  # one row per model
        with scratch_scope():
            before = written(reference.select(*names), "drift-reference")
            record_check(check_window(before, window, as_of, config), config)
    finally:
        discard(window)
    end = as_timestamp(as_of, log.schema["ts"].dataType.simpleString())
    stored = read_history(log.sparkSession, config.runs_path).filter(F.col("date") == F.to_date(end))
    return stored.filter(F.col("ts") == end).join(models, "model_name", "left_semi").select(*stored.columns)


def record_check(verdict: DataFrame, config: MonitorConfig) -> None:
    """Append the runs and the alerts they raise."""
    runs = written(verdict, "drift-runs")
    append_unique(runs, config.runs_path, "run_id", "ts", dates_fixed_by_key=True)
    append_unique(
        drift_alerts(runs), config.alerts_path, "alert_id", "created_at", dates_fixed_by_key=True
    )
