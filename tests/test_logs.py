"""Request columns, counters, histograms, gauges, evaluation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mlwatch.functions import requests as req, trips as fn
from mlwatch.operators import evaluate, rollups
from mlwatch.sources.shared import scratch_path


@pytest.mark.parametrize(
    "path, expected",
    [
        ("/predict", "/predict"),
        ("/user/12", "/user/{id}"),
        ("/user/12/orders", "/user/{id}/orders"),
        ("/user/1/2/x", "/user/{id}/2/x"),
        ("/v1/user/12a", "/v1/user/12a"),
        ("/doc/3F2504E0-4f89-11d3-9a0c-0305e82c3301/view", "/doc/{id}/view"),
    ],
)
def test_endpoint(spark, path, expected):
    assert spark.createDataFrame([(path,)], "p string").select(req.endpoint("p")).first()[0] == expected


def test_client_ip_and_errors(spark):
    df = spark.createDataFrame(
        [(" 1.1.1.1\t, 2.2.2.2", "p", 200, None), ("", "p", 404, None), (None, None, 500, "KeyError")],
        "f string, p string, s int, e string",
    )
    rows = df.select(req.client_ip("f", "p"), req.error_type("s", "e"), req.log_level("s")).collect()
    assert [tuple(r) for r in rows] == [
        ("1.1.1.1", None, "debug"), ("p", "http_404", "warning"), ("unknown", "KeyError", "error")
    ]


def test_counter(spark):
    df = spark.createDataFrame([("POST", 1), ("GET", 2), (None, 3)], "method string, n int")
    assert {tuple(r) for r in rollups.counter(df, ["method"]).collect()} == {("POST", 1), ("GET", 1), ("", 1)}
    assert {tuple(r) for r in rollups.counter(df, ["method"], "n").collect()} == {("POST", 1), ("GET", 2), ("", 3)}


def test_histogram(spark):
    df = spark.createDataFrame([(v,) for v in (0.05, 0.3, 2.0, 10.0)], "v double")
    rows = rollups.histogram(df, "v", [], (0.1, 0.5, 1.0, 5.0)).orderBy("bound").collect()
    assert [r.at_most for r in rows] == [1, 2, 2, 3] and {r["count"] for r in rows} == {4}
    df = spark.createDataFrame([(v,) for v in (0.1, 0.5, 1.0)], "v double")
    row = rollups.histogram(df, "v", [], (1.0,)).first()
    assert (row["count"], row["sum"], row.at_most) == (3, pytest.approx(1.6), 3)


def test_gauge(spark):
    events = [
        ("a", 1, "inc", 5.0), ("a", 2, "set", 10.0), ("a", 3, "inc", 2.0), ("a", 4, "dec", 0.5),
        ("b", 1, "inc", 1.0), ("b", 2, "dec", 4.0), ("c", 1, "set", 1.0), ("c", 2, "set", 7.0),
    ]
    df = spark.createDataFrame(events, "g string, t int, op string, v double")
    replayed = {r.g: r.value for r in rollups.gauge_replay(df, ["g"], "op", "v", ["t"]).collect()}
    assert replayed == {"a": 11.5, "b": -3.0, "c": 7.0}
    assert {r.g: r.value for r in rollups.gauge_last(df, ["g"], "v", ["t"]).collect()} == {"a": 0.5, "b": 4.0, "c": 7.0}


def test_summary_of_an_empty_period_is_zero(spark):
    runs = spark.createDataFrame(
        [("m", "r", "2024-01-01", True, 0.3, 0.2, 3)],
        "model_name string, run_id string, at string, drift_detected boolean, max_psi double, avg_psi double, drift_count int",
    ).withColumn("ts", F.col("at").cast("timestamp_ntz"))
    models = spark.createDataFrame([("m",), ("n",)], "model_name string")
    as_of = F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")
    rows = {r.model_name: r for r in rollups.drift_summary(runs, as_of, 24, models).collect()}
    assert (rows["m"].runs, rows["m"].latest.run_id) == (1, "r")
    assert (rows["n"].runs, rows["n"].drift_detected_count, rows["n"].latest) == (0, 0, None)


def test_metrics_equal_numpy(spark):
    rng = np.random.default_rng(5)
    actual = np.concatenate([rng.normal(10, 4, 200), [0.0]])
    predicted = actual + rng.normal(0, 1, 201)
    df = spark.createDataFrame(list(zip(actual.tolist(), predicted.tolist())), "y double, p double")
    row = evaluate.regression_metrics(df, "y", "p").first()
    error, positive = actual - predicted, actual > 0
    assert row.rmse == pytest.approx(np.sqrt((error**2).mean()))
    assert row.mae == pytest.approx(np.abs(error).mean())
    assert row.r2 == pytest.approx(1 - (error**2).sum() / ((actual - actual.mean()) ** 2).sum())
    assert row.mape == pytest.approx(np.abs(error[positive] / actual[positive]).mean() * 100)
    both = evaluate.compare_scores(df, "y", "p", "y").first()
    assert (both.champion_rmse, both.challenger_rmse, both.challenger_r2) == (pytest.approx(row.rmse), 0.0, 1.0)


def test_constant_label_has_a_floor_under_r2(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, p double")
    assert evaluate.regression_metrics(df, "y", "p").first().r2 == 1.0


def test_latency(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(1, 101)], "version string, latency_ms double")
    row = evaluate.latency_by(df, ["version"]).first()
    assert (row.samples, row.avg_latency_ms) == (100, 50.5)
    assert row.p95_latency_ms == pytest.approx(np.percentile(range(1, 101), 95))
    rough = evaluate.latency_by(df, ["version"], approximate=True).first()
    assert rough.p95_latency_ms == pytest.approx(95, abs=1)


def test_baseline_and_bins(spark):
    df = spark.createDataFrame(
        [(0.2, 1.0, 0, 5), (3.0, 15.0, 1, 6), (3.01, 60.0, 0, 20), (None, None, 0, None)],
        "trip_distance double, trip_duration_minutes double, is_rush_hour int, pickup_hour int",
    )
    rows = df.select(
        fn.baseline_fare(), fn.distance_bin("trip_distance"), fn.duration_bin("trip_duration_minutes"), fn.hour_bin("pickup_hour")
    ).collect()
    assert [tuple(r) for r in rows] == [
        (4.0, "0-1", "0-5", "night"), (20.5, "1-3", "5-15", "morning"),
        (pytest.approx(40.53, abs=0.006), "3-5", "30-60", "night"), (18.0, "0-1", "0-5", "night"),
    ]


def test_time_flags(spark):
    df = spark.createDataFrame(
        [("2024-01-06 07:00:00",), ("2024-01-07 10:00:00",), ("2024-01-08 19:59:59",), (None,)], "at string"
    ).select(F.col("at").cast("timestamp_ntz").alias("t"))
    rows = df.select(fn.day_of_week("t"), fn.is_weekend("t"), fn.is_rush_hour("t")).collect()
    assert [tuple(r) for r in rows] == [(7, 1, 1), (1, 1, 0), (2, 0, 1), (None, 0, 0)]


def test_hash_is_stable_and_sensitive(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, None)], "x int, y string")
    one, two, three = [r[0] for r in df.select(fn.feature_hash(["y", "x"])).collect()]
    assert one == two != three and len(one) == 16


def test_counters_of_one_log_take_one_pass(spark):
    rows = [("POST", 200, 1), ("GET", 200, 1), ("GET", 500, 2), (None, 404, None)]
    log = spark.createDataFrame(rows, "method string, status int, n int")
    path = scratch_path(spark, "requests")
    log.write.parquet(path)
    log = spark.read.parquet(path)
    found = rollups.counters(
        log,
        {
            "requests": ([F.col("method"), F.col("status")], None),
            "errors": ([F.col("status")], F.col("status") >= 400),
            "twos": ([F.col("n")], F.col("n") == 2),
            "all": ([], None),
        },
    )
    assert {(r.metric, tuple(r.labels)): r.total for r in found.collect()} == {
        ("requests", ("POST", "200")): 1, ("requests", ("GET", "200")): 1, ("requests", ("GET", "500")): 1,
        ("requests", ("", "404")): 1, ("errors", ("500",)): 1, ("errors", ("404",)): 1, ("twos", ("2",)): 1, ("all", ()): 4,
    }
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
    assert rollups.counters(log.limit(0), {"all": ([], None)}).count() == 0
