"""Streams against batch results; late, repeated and retried input."""

import os
import re
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from mlwatch.functions.trips import baseline_fare
from mlwatch.plans import monitor, views
from mlwatch.sources.history import present_keys
from mlwatch.sources.shared import scratch_path, shared_dir
from mlwatch.streaming import drift as stream_drift, runtime, score, windows

SCHEMA = "request_id long, at string, numeric_feature_stats string"


def request(i, at, distance=3.0):
    return (i, f"2024-01-{at}", f'{{"trip_distance": {distance}, "trip_duration_minutes": 10.0}}')


def feed(spark, *steps):
    path = scratch_path(spark, "feed")
    for step in steps:
        spark.createDataFrame(step, SCHEMA).select(
            "request_id", F.col("at").cast("timestamp").alias("ts"), "numeric_feature_stats"
        ).coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    return runtime.read_files(spark, path, schema, files_per_trigger=1)


def test_score_log(spark):
    stream = feed(
        spark,
        [request(1, "01 10:00:00"), request(2, "01 10:05:00", 500.0), request(1, "01 10:20:00")],
        [request(1, "01 10:30:00"), request(3, "01 14:00:00")],  # 1 again; the watermark moves to 13:00
        [request(6, "01 14:10:00")],  # lateness is judged by the watermark of the batch before
        [request(4, "01 11:00:00"), request(5, "01 13:30:00")],  # 4 is late
    )
    log, bad, point = (scratch_path(spark, n) for n in ("log", "bad", "point"))
    score.score_log(stream, log, bad, point)
    kept = spark.read.parquet(log)
    assert sorted(r.request_id for r in kept.collect()) == [1, 3, 5, 6]
    assert {r.predicted_fare for r in kept.collect()} == {15.5}
    rejected = spark.read.parquet(bad).collect()
    assert [(r.request_id, r.errors[0].type) for r in rejected] == [(2, "value_above_maximum")]


@pytest.mark.parametrize("salts", [1, 4])
def test_many_copies_of_one_request(spark, salts):
    copies = [request(1, f"01 10:{m:02d}:{x:02d}") for m in range(20) for x in range(10)]
    path = scratch_path(spark, "feed")
    for part in (copies[:100] + [request(2, "01 10:01:00")], copies[100:] + [request(3, "01 10:30:00")]):
        spark.createDataFrame(part, SCHEMA).select(
            "request_id", F.col("at").cast("timestamp").alias("ts"), "numeric_feature_stats"
        ).repartition(4).write.mode("append").parquet(path)
    stream = runtime.read_files(spark, path, spark.read.parquet(path).schema, files_per_trigger=4)
    out = scratch_path(spark, "out")
    runtime.run_to_end(
        score.first_requests(stream, salts=salts).writeStream.format("parquet").option("path", out),
        scratch_path(spark, "point"),
    )
    assert sorted(r.request_id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_retried_batch_replaces_itself(spark):
    path = scratch_path(spark, "log")
    batch = spark.createDataFrame([(1, datetime(2024, 1, 1))], "id int, ts timestamp")
    for _ in range(2):
        runtime.write_batch(batch, path, 0, "ts")
    assert spark.read.parquet(path).count() == 1


def test_trailing_windows_equal_batch(spark):
    rows = [(i, f"{1 + i // 20:02d} {i % 20:02d}:15:00", float(i)) for i in range(80)]
    stream = feed(spark, *[[request(i, at, v) for i, at, v in rows[k : k + 20]] for k in (0, 20, 40, 60)])
    valued = stream.withColumn("v", F.get_json_object("numeric_feature_stats", "$.trip_distance").cast("double"))
    path = scratch_path(spark, "windows")
    windows.write_closed(
        windows.trailing_moments(valued, "ts", "v", []), path, scratch_path(spark, "point")
    )
    found = {(r.window_start, r.n, round(r.mean, 9), round(r["std"], 9)) for r in spark.read.parquet(path).collect()}
    batch = spark.createDataFrame([(f"2024-01-{at}", v) for _, at, v in rows], "at string, v double").select(
        F.col("at").cast("timestamp").alias("ts"), "v"
    )
    watermark = datetime(2024, 1, 4, 18, 15)
    expected = {
        (r.w.start, r.n, round(r.m, 9), round(r.s, 9))
        for r in batch.groupBy(F.window("ts", "24 hours", "1 hour").alias("w"))
        .agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
        .collect()
        if r.w.end <= watermark
    }
    assert found == expected and len(found) > 20


def test_panes_count_a_row_once_and_make_up_every_window(spark):
    """24 h windows every hour: a row is in one pane, and windows hold both of their bounds."""
    rows = [("m", f"2024-01-0{1 + i // 8} {i % 8 * 3:02d}:{'00' if i % 2 else '17'}:00", float(i % 4)) for i in range(24)]
    log = spark.createDataFrame(rows, "model_name string, at string, v double").withColumn("ts", F.col("at").cast("timestamp"))
    config = monitor.MonitorConfig(("v",), (), "", "", hours=24, every_hours=1)
    panes = stream_drift.panes_of(log, ["v"], [], config)
    assert panes.filter("feature = ''").agg(F.sum("n")).first()[0] == len(rows)
    dated = panes.withColumn("date", F.to_date(F.timestamp_micros("pane")))
    start, end = (int(datetime(2024, 1, d, tzinfo=timezone.utc).timestamp()) * 1_000_000 for d in (1, 5))
    windows_found = stream_drift.windows_of(dated, start, end, config).filter("feature = ''")
    found = {r.window_end.isoformat(): r.n for r in windows_found.collect()}
    expected = {}
    for hour in range(1, 4 * 24 + 1):
        until = datetime(2024, 1, 1) + timedelta(hours=hour)
        n = sum(until - timedelta(hours=24) <= datetime.fromisoformat(at) <= until for _, at, _ in rows)
        expected |= {until.isoformat(): n} if n else {}
    assert found == expected


@pytest.mark.parametrize("files", [1, 2, 4])
def test_every_due_window_is_judged_however_files_fall_into_batches(spark, sf, files):
    events = views.events_with_k(spark, sf).withColumn("ts", runtime.event_time("ts"))
    path = scratch_path(spark, "feed")
    for first, last in (("2024-01-01", "2024-01-12"), ("2024-01-20", "2024-02-01"), ("2024-01-12", "2024-01-20")):
        events.filter((F.col("ts") >= first) & (F.col("ts") < last)).coalesce(1).write.mode("append").parquet(path)
    log = views.as_predictions(events)
    reference = log.filter("ts < '2024-01-08'").select("latency_ms", "k", "model_version")
    config = monitor.MonitorConfig(
        ("latency_ms", "k"), ("model_version",), scratch_path(spark, "runs"), scratch_path(spark, "alerts"),
        hours=72, every_hours=48, delay_hours=24 * 40, min_samples=5,
    )
    stream = views.as_predictions(runtime.read_files(spark, path, events.schema, files))
    scratch = lambda: {f for f in os.listdir(shared_dir(spark) + "/mlwatch") if f.startswith(("drift-cuts", "drift-points"))}
    before = scratch()
    stream_drift.watch(stream, reference, scratch_path(spark, "log"), config, scratch_path(spark, "point"))
    assert scratch() == before  # what checks write on the way is removed
    runs = spark.read.parquet(config.runs_path).collect()
    found = {(r.run_id, str(r.ts), round(r.max_psi, 9), r.current_sample_count) for r in runs}
    assert len(found) == len(runs)
    expected, day = set(), datetime(2024, 1, 1)
    while day < datetime(2024, 2, 1):
        if (day - datetime(1970, 1, 1)).days % 2 == 0 and day > datetime(2024, 1, 1):
            last = log.agg(F.max("ts")).first()[0]
            expected |= {
                (r.run_id, str(r.ts), round(r.max_psi, 9), r.current_sample_count)
                for r in monitor.check_window(reference, log, day, config).collect()
                if day <= last
            }
        day += timedelta(days=1)
    assert found == expected and len(found) >= 20
    assert all(len(r.feature_details) == 3 for r in runs)
    detected = [r for r in runs if r.drift_detected]
    assert not detected or spark.read.parquet(config.alerts_path).count() == len(detected)



def test_windows_older_than_the_first_batch_are_judged(spark, sf):
    """Files of one delivery come in any order: the oldest events need not be in the first batch."""
    events = views.events_with_k(spark, sf).withColumn("ts", runtime.event_time("ts"))
    path = scratch_path(spark, "feed")
    for first, last in (("2024-01-05", "2024-01-08"), ("2024-01-01", "2024-01-03"), ("2024-01-03", "2024-01-05")):
        events.filter((F.col("ts") >= first) & (F.col("ts") < last)).coalesce(1).write.mode("append").parquet(path)
    config = monitor.MonitorConfig(
        ("k",), (), scratch_path(spark, "runs"), scratch_path(spark, "alerts"), delay_hours=24 * 10, min_samples=1
    )
    log = views.as_predictions(events)
    stream = views.as_predictions(runtime.read_files(spark, path, events.schema, 1))
    stream_drift.watch(stream, log.select("k"), scratch_path(spark, "log"), config, scratch_path(spark, "point"))
    found = {r.ts.day for r in spark.read.parquet(config.runs_path).select("ts").distinct().collect()}
    assert found == {2, 3, 4, 5, 6, 7}


def test_a_repeat_behind_the_watermark_is_logged_once(spark):
    stream = feed(spark, [request(1, "01 10:00:00")], [request(2, "03 10:00:00")], [request(1, "03 12:00:00")])
    log, bad, point = (scratch_path(spark, n) for n in ("log", "bad", "point"))
    score.score_log(stream, log, bad, point)
    assert sorted(r.request_id for r in spark.read.parquet(log).collect()) == [1, 2]
    seen = spark.read.parquet(score.seen_path(log))
    assert sorted(r.request_id for r in seen.filter("batch = 0").collect()) == [1]
    fresh = seen.filter("request_id = 1").select("request_id", "key_bucket").distinct()
    touched = fresh.first().key_bucket
    plan = present_keys(fresh, seen, "request_id")._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"PartitionFilters: \[[^\]]*key_bucket#\d+ = {touched}\)", plan)


def test_deviation_far_from_zero(spark):
    rows = [request(i, f"01 {i // 3:02d}:{i % 3 * 20:02d}:00", 1e9 + i % 10) for i in range(60)] + [request(99, "04 00:00:00")]
    valued = feed(spark, rows, [request(100, "06 00:00:00")]).withColumn(
        "v", F.get_json_object("numeric_feature_stats", "$.trip_distance").cast("double")
    )
    path = scratch_path(spark, "windows")
    windows.write_closed(windows.trailing_moments(valued, "ts", "v", []), path, scratch_path(spark, "point"))
    whole = spark.read.parquet(path).filter("n = 60").first()
    assert (whole["std"], whole["mean"]) == (pytest.approx(2.8722813, rel=1e-6), pytest.approx(1e9 + 4.5))


def test_sums_of_open_windows_and_late_rows(spark):
    path, point, source = (scratch_path(spark, n) for n in ("sums", "point", "source"))
    steps = [
        [("a", "01 10:10:00"), ("a", "01 10:20:00"), ("b", "01 11:05:00")],
        [("a", "01 10:59:00"), (None, "01 12:30:00"), ("a", None)],  # nothing was closed before this batch
        [("a", "01 10:05:00"), ("b", "01 11:59:00")],  # closed up to 11:30: the first is late
        [],
        [("b", "01 11:01:00")],
    ]
    for step in steps:
        rows = spark.createDataFrame([(k, at and f"2024-01-{at}") for k, at in step], "k string, at string")
        rows.select("k", F.col("at").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(source)
        stream = runtime.read_files(spark, source, spark.read.parquet(source).schema)
        windows.keep_sums(stream, "ts", ["k"], {"n": F.count("*")}, path, point)
    found = windows.sums_so_far(spark, path, ["k"], ["n"]).orderBy("window_start", "k").collect()
    assert [(r.k, r.window_start.hour, r.n, r.closed) for r in found] == [
        ("a", 10, 3, True), ("b", 11, 3, False), ("", 12, 1, False),
    ]
    brought = windows.arrivals(spark, path).orderBy("batch").collect()
    assert [(r.rows, r.late_rows, r.untimed_rows) for r in brought if r.rows] == [(3, 0, 0), (3, 0, 1), (2, 1, 0), (1, 0, 0)]
    assert brought[-1].newest.hour == 12
    # a batch that is written again replaces its rows
    assert spark.read.parquet(path).select("batch").distinct().count() == 4


def test_scoring_holds_no_state_and_knows_repeats_of_all_batches(spark):
    """Repeats of logged requests are left out for good; those of refused ones until the watermark has passed them."""
    bad = 500.0
    stream = feed(
        spark,
        [request(1, "01 10:00:00"), request(2, "01 10:00:00", bad), request(2, "01 10:10:00")],
        [request(1, "01 10:30:00", bad), request(2, "01 10:40:00", bad), request(3, "01 11:30:00")],
        [request(4, "01 16:00:00"), request(2, "01 10:50:00")],  # the watermark is at 9:10: 2 is still known
        [request(5, "01 16:10:00")],  # from here on it is at 15:00
        [request(1, "01 16:30:00", bad), request(1, "01 16:40:00"), request(2, "01 16:50:00"), request(6, "01 15:00:00")],
    )
    log, refused, point = (scratch_path(spark, n) for n in ("log", "refused", "point"))
    score.score_log(stream, log, refused, point)
    assert sorted((r.request_id, r.batch) for r in spark.read.parquet(log).collect()) == [(1, 0), (2, 4), (3, 1), (4, 2), (5, 3)]
    assert [(r.request_id, r.batch) for r in spark.read.parquet(refused).collect()] == [(2, 0)]
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{point}/state")
    assert not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
