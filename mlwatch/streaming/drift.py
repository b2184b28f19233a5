"""Continuous drift check: every micro-batch extends the log, and every window that is due is judged once."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from mlwatch.operators.drift_windows import ReferenceSummary, counted_cells
from mlwatch.plans.monitor import MonitorConfig, features_of, judge_windows, record_check, summarise
from mlwatch.sources.history import exists
from mlwatch.sources.shared import scratch_scope, written
from mlwatch.streaming.runtime import run_to_end, write_batch

HOUR = 3_600_000_000


def pane_hours(config: MonitorConfig) -> int:
    """Length of the panes that every window is made of."""
    return math.gcd(config.hours, config.every_hours)


def panes_of(rows: DataFrame, numeric: list[str], categorical: list[str], config: MonitorConfig) -> DataFrame:
    """Counted cells per model and pane of time: every row is counted once, however many windows it falls into.

    ``pane`` is the end of the pane in microseconds and holds what is newer than the pane before it; rows of that
    very moment are counted apart (``on_edge``), as they are also the first of the windows that start there.
    """
    size = pane_hours(config) * HOUR
    at = F.unix_micros("ts")
    pane = (F.ceil(at / size) * size).cast("long")
    placed = rows.withColumns({"pane": pane, "on_edge": at == pane})
    return counted_cells(placed, numeric, categorical, ["model_name", "pane", "on_edge"])


def windows_of(panes: DataFrame, after: int, until: int, config: MonitorConfig) -> DataFrame:
    """Counted cells of the windows that end in (after, until], summed from their panes.

    Windows end at whole multiples of ``every_hours`` since 1970 and hold what is at most ``hours`` older than
    their end, both bounds included. Times are microseconds.
    """
    slide, length = config.every_hours * HOUR, config.hours * HOUR
    pane = F.col("pane")
    # a window that starts with this pane's end holds the rows of that moment only
    reach = F.when(F.col("on_edge"), pane + length).otherwise(pane + length - 1)
    first = F.greatest(F.ceil(pane / slide), F.lit(after // slide + 1)).cast("long")
    last = F.least(F.floor(reach / slide), F.lit(until // slide)).cast("long")
    instant = lambda micros: F.to_date(F.timestamp_micros(F.lit(micros)))
    near = panes.filter(pane.between(after + slide - length, until)).filter(
        F.col("date").between(instant(after + slide - length), instant(until))
    )
    ends = near.filter(first <= last).withColumn("step", F.explode(F.sequence(first, last)))
    keys = ["model_name", "window_end", "feature", "x", "category", "odd"]
    return (
        ends.withColumn("window_end", F.timestamp_micros(F.col("step") * slide))
        .groupBy(*keys)
        .agg(F.sum("n").alias("n"))
    )


class Watch:
    """The check of one log: which windows it has judged is read from its own table of checks."""

    def __init__(self, summary: ReferenceSummary, log_path: str, config: MonitorConfig):
        self.summary, self.log_path, self.config = summary, log_path, config
        self.checks_path, self.panes_path = f"{config.runs_path}-checks", f"{config.runs_path}-panes"
        self.features = features_of(summary, config)

    def _state(self, spark: SparkSession, before: int) -> tuple[int | None, int | None, int | None]:
        """Oldest and newest event and end of the last window judged, as the batches before ``before`` left them."""
        if not exists(spark, self.checks_path):
            return None, None, None
        schema = "batch long, oldest long, newest long, judged long"
        rows = spark.read.schema(schema).parquet(self.checks_path).filter(F.col("batch") < before)
        return tuple(rows.agg(F.min("oldest"), F.max("newest"), F.max("judged")).first())

    def count(self, batch: DataFrame, batch_id: int) -> None:
        """Log a micro-batch and count its panes; a retried batch replaces both."""
        write_batch(batch, self.log_path, batch_id, "ts")
        schema = batch.schema.add("date", "date").add("batch", "long")
        logged = batch.sparkSession.read.schema(schema).parquet(self.log_path).filter(F.col("batch") == batch_id)
        panes = panes_of(logged, *self.features, self.config)
        write_batch(panes.withColumn("ts", F.timestamp_micros("pane")), self.panes_path, batch_id, "ts")

    def _panes(self, spark: SparkSession) -> DataFrame:
        schema = (
            "model_name string, pane long, on_edge boolean, feature string, x double, category string, odd boolean, "
            "n long, ts timestamp, date date, batch long"
        )
        return spark.read.schema(schema).parquet(self.panes_path)

    def judge(self, spark: SparkSession, batch_id: int, ended: bool = False) -> None:
        """Judge every window due after a batch, or, where the input has ended, all that are left."""
        slide = self.config.every_hours * HOUR
        oldest, newest, judged = self._state(spark, batch_id)
        if not ended:
            first, latest = self._span(spark, batch_id)
            if latest is None:
                return
            oldest, newest = min(first, oldest or first), max(latest, newest or latest)
        if newest is None:
            return
        # until a window is judged, events older than those of the first batch may still come
        after = (oldest - 1) // slide * slide if judged is None else judged
        ripe = newest if ended else newest - self.config.delay_hours * HOUR
        until = max(after, ripe // slide * slide)
        if until > after:
            panes = self._panes(spark).filter(F.col("batch") <= batch_id)
            cells = written(windows_of(panes, after, until, self.config), "drift-window-cells")
            record_check(judge_windows(self.summary, cells, self.config, counted=True), self.config)
            judged = until
        kept = {"batch": batch_id, "oldest": oldest, "newest": newest, "judged": judged}
        state = spark.range(1).select(*[F.lit(value).cast("long").alias(name) for name, value in kept.items()])
        state.write.mode("append").parquet(self.checks_path)

    def _span(self, spark: SparkSession, batch_id: int) -> tuple[int | None, int | None]:
        """Oldest and newest event of a logged batch."""
        schema = "ts timestamp, date date, batch long"
        logged = spark.read.schema(schema).parquet(self.log_path).filter(F.col("batch") == batch_id)
        return tuple(logged.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first())


def watch(
    stream: DataFrame,
    reference: DataFrame,
    log_path: str,
    config: MonitorConfig,
    checkpoint: str,
) -> None:
    """Append each micro-batch to the log and judge every window that has come due; at the end of the input,
    also those that ``delay_hours`` held back.

    A window is due when an event newer than its end by ``delay_hours`` has been seen: with a delay over the
    input's disorder, verdicts don't depend on how rows fall into batches, nor on which of them come first. The reference is summarised once, and the
    rows of a pane of time are counted once: windows that overlap share their panes.
    Run and alert ids follow from model and window, so a retried batch stores nothing twice, and what a check
    writes on the way is removed with it.
    """
    spark = stream.sparkSession
    check = Watch(summarise(reference, stream, config), log_path, config)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope():
            check.count(batch, batch_id)
            check.judge(batch.sparkSession, batch_id)

    run_to_end(stream.writeStream.foreachBatch(on_batch), checkpoint)
    with scratch_scope():
        check.judge(spark, 1 << 62, ended=True)
