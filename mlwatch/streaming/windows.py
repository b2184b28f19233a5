"""Trailing-window moments and request rollups over event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mlwatch.functions.numbers import number
from mlwatch.operators.rollups import histogram_aggregates, label
from mlwatch.sources.history import exists
from mlwatch.sources.shared import discard, written
from mlwatch.streaming.runtime import run_to_end, write_batch


def trailing_moments(
    stream: DataFrame,
    ts: str,
    value: str,
    keys: list[str],
    watermark: str = "1 hour",
    length: str = "24 hours",
    slide: str = "1 hour",
) -> DataFrame:
    """Count, mean, deviation and range per key in a window of ``length`` moved by ``slide``.

    Rows are first summed per ``slide`` (values that are no finite number are left out); only those sums are copied into the windows they belong to,
    where copying the rows themselves would multiply them by length / slide. A window comes out once the
    watermark has passed its end.
    """
    v = number(value)
    steps = (
        stream.withWatermark(ts, watermark)
        .groupBy(F.window(ts, slide), *keys)
        .agg(
            F.count(v).alias("n"),
            F.avg(v).alias("mean"),
            (F.var_pop(v) * F.count(v)).alias("spread"),
            F.min(v).alias("lo"),
            F.max(v).alias("hi"),
        )
        .withColumn("step_time", F.window_time("window"))
        .drop("window")
    )
    # one entry per step of a window; sums of squares about each step's own mean don't cancel
    parts = F.filter("parts", lambda p: p["n"] > 0)
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("spread"))

    def joined(a: Column, b: Column) -> Column:
        n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
        return F.struct(
            n.alias("n"),
            (a["mean"] + apart * b["n"] / n).alias("mean"),
            (a["spread"] + b["spread"] + apart * apart * a["n"] * b["n"] / n).alias("spread"),
        )

    some = F.col("all.n") > 0
    return (
        steps.groupBy(F.window("step_time", length, slide), *keys)
        .agg(
            F.collect_list(F.struct("n", "mean", "spread")).alias("parts"),
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
        )
        .withColumn("all", F.aggregate(parts, zero, joined))
        .withColumns(
            {
                "n": F.col("all.n"),
                "mean": F.when(some, F.col("all.mean")),
                "std": F.when(some, F.sqrt(F.col("all.spread") / F.col("all.n"))),
            }
        )
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            *keys,
            "n",
            "mean",
            "std",
            "lo",
            "hi",
        )
    )


def request_rollup(
    stream: DataFrame,
    ts: str,
    latency: str,
    labels: list[str],
    bounds: tuple[float, ...],
    watermark: str = "1 hour",
    length: str = "1 hour",
) -> DataFrame:
    """Request counts and cumulative latency counts per window and label combination."""
    return (
        stream.withWatermark(ts, watermark)
        .groupBy(F.window(ts, length), *[label(n) for n in labels])
        .agg(*histogram_aggregates(latency, bounds))
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            *labels,
            "count",
            "sum",
            "avg",
            "cumulative",
        )
    )


def write_closed(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append closed windows as Parquet until the input is used up."""
    run_to_end(stream.writeStream.outputMode("append").format("parquet").option("path", path), checkpoint)


def arrivals_path(path: str) -> str:
    """Where :func:`keep_sums` records what each batch brought."""
    return f"{path.rstrip('/')}-arrivals"


def keep_sums(
    stream: DataFrame,
    ts: str,
    keys: list[str],
    sums: dict[str, Column],
    path: str,
    checkpoint: str,
    watermark: str = "1 hour",
    length: str = "1 hour",
) -> None:
    """Sums per window and keys that can be read while their windows are open, with the rows that came too late counted.

    A micro-batch is aggregated once and adds one row per window and keys it touches (by date and batch, a retried batch
    replaces its own), so open windows hold no memory between batches; :func:`sums_so_far` adds the rows up. ``sums``
    names aggregates that can be added up: sums and counts. Their names must not be those of keys.

    A row is late, and left out of the sums, if the watermark had passed the end of its window before its batch: the
    newest time of all batches before, less ``watermark``. Rows without a time belong to no window. Both are counted per
    batch beside the table (:func:`arrivals`).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = None
        if batch_id:  # every batch writes its record, after its sums; the record holds the newest time of all so far
            before = spark.read.parquet(f"{arrivals_path(path)}/batch={batch_id - 1}").first()["newest"]
        closed = F.lit(before).cast("timestamp") - F.expr(f"interval {watermark}")
        timed = F.col(ts).isNotNull()
        span = F.window(F.coalesce(ts, F.timestamp_seconds(F.lit(0))), length)
        parts = written(
            batch.withColumn("__span", span)
            .groupBy(
                F.when(timed, F.col("__span.start")).alias("window_start"),
                F.when(timed, F.col("__span.end")).alias("window_end"),
                F.when(timed, F.coalesce(F.col("__span.end") <= closed, F.lit(False))).alias("__late"),
                *[label(k) for k in keys],
            )
            .agg(
                F.count(F.lit(1)).alias("__rows"),
                F.max(ts).alias("__newest"),
                *[column.alias(name) for name, column in sums.items()],
            ),
            "window-sums",
        )
        kept = parts.filter("not __late").drop("__late", "__rows", "__newest")
        write_batch(kept, path, batch_id, "window_start")
        rows = F.col("__rows")
        parts.agg(
            F.coalesce(F.sum(rows), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(rows.cast("bigint") * F.col("__late").cast("int")), F.lit(0)).alias("late_rows"),
            F.coalesce(F.sum(F.when(F.col("__late").isNull(), rows)), F.lit(0)).alias("untimed_rows"),
            # greatest leaves nulls out
            F.greatest(F.max("__newest"), F.lit(before).cast("timestamp")).alias("newest"),
        ).coalesce(1).write.mode("overwrite").parquet(f"{arrivals_path(path)}/batch={batch_id}")
        discard(parts)

    run_to_end(stream.writeStream.foreachBatch(write), checkpoint)


def arrivals(spark: SparkSession, path: str) -> DataFrame:
    """One row per batch of :func:`keep_sums`: its rows, those late or without a time, and the newest time so far."""
    return spark.read.parquet(arrivals_path(path))


def sums_so_far(
    spark: SparkSession, path: str, keys: list[str], sums: list[str], watermark: str = "1 hour"
) -> DataFrame:
    """Every window of :func:`keep_sums` as of now, and whether it is ``closed``: rows for it would be late.

    A filter on ``date`` of the result, that of the window's start, reads those dates only.
    """
    newest = arrivals(spark, path).agg(F.max("newest")).first()[0]
    closed = F.lit(newest).cast("timestamp") - F.expr(f"interval {watermark}")
    if not exists(spark, path):
        raise ValueError(f"no sums in {path}")
    return (
        spark.read.parquet(path)
        .groupBy("date", "window_start", "window_end", *keys)
        .agg(*[F.sum(name).alias(name) for name in sums])
        .withColumn("closed", F.coalesce(F.col("window_end") <= closed, F.lit(False)))
    )
