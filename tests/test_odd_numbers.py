"""Infinite, missing and one-sided input."""

import math

import pytest
from pyspark.sql import functions as F

from mlwatch.functions.trips import baseline_fare
from mlwatch.operators import decide, evaluate, prepare, rollups
from mlwatch.operators.drift import feature_drift
from mlwatch.operators.drift_windows import shared_reference_drift
from mlwatch.spec import FeatureSpec, Rule

INF, NAN = float("inf"), float("nan")


def test_one_infinite_value_leaves_the_drift_as_it_is(spark):
    clean = [("reference", "g", float(i % 50)) for i in range(200)] + [("current", "g", float(i % 50 + 40)) for i in range(200)]
    schema, psi = "side string, g string, x double", []
    for odd in ([], [("current", "g", INF), ("reference", "g", -INF), ("current", "g", NAN)]):
        rows = spark.createDataFrame(clean + odd, schema)
        row = feature_drift(rows, ["x"]).first()
        shared = shared_reference_drift(rows.filter("side = 'reference'"), rows.filter("side = 'current'"), ["x"], by=["g"]).first()
        for found in (row, shared):
            psi.append(found.psi)
            assert found.severity == "high"
            assert (found.reference_odd, found.current_odd) == ((1, 2) if odd else (0, 0))
            assert (found.reference_count, found.current_count, found.current_mean) == (200, 200, 64.5)
    assert psi == [pytest.approx(psi[0], rel=1e-9)] * 4 and psi[0] > 1


@pytest.mark.parametrize("rmse, latency, reasons", [(NAN, 1.0, 1), (None, 1.0, 1), (INF, 1.0, 1), (1.0, None, 1), (1.0, NAN, 1), (None, None, 2), (1.0, 1.0, 0)])
def test_what_is_not_measured_is_not_promoted(spark, rmse, latency, reasons):
    schema = "champion_version int, champion_rmse double, champion_avg_latency_ms double, challenger_version int, challenger_rmse double, challenger_avg_latency_ms double, challenger_validation_passed boolean"
    row = decide.promotion_gate(spark.createDataFrame([(1, 5.0, 1.0, 2, rmse, latency, True)], schema)).first()
    assert row.promoted == (reasons == 0) and len(row.rejection_reasons) == reasons
    first = decide.promotion_gate(spark.createDataFrame([(None, None, None, 1, rmse, latency, True)], schema)).first()
    assert first.promoted == (rmse == 1.0)


def test_rules_with_one_bound(spark):
    spec = FeatureSpec(("a", "b"), (), (), "c", (Rule("a", "float", minimum=1.0), Rule("b", "float", maximum=5.0), Rule("c", "float")))
    rows = spark.createDataFrame([(1.0, 5.0, 0.0), (0.5, 1.0, 0.0), (2.0, 6.0, 0.0), (9.0, -9.0, 0.0), (None, 1.0, 0.0), (3.0, 3.0, None)], "a double, b double, c double")
    assert [tuple(r) for r in rows.filter(prepare.within_rules(spec)).collect()] == [(1.0, 5.0, 0.0), (9.0, -9.0, 0.0)]


def test_metrics_of_rows_that_have_both_values(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (100.0, None), (-100.0, NAN), (None, 3.0)], "y double, p double")
    row = evaluate.regression_metrics(rows, "y", "p").first()
    assert (row.rmse, row.mae, row.r2) == (1.0, 1.0, pytest.approx(1 - 2 / 0.5))
    both = evaluate.compare_scores(rows.withColumn("q", F.col("p")), "y", "p", "q").first()
    assert both.champion_r2 == both.challenger_r2 == row.r2


def test_runs_after_the_period_do_not_count(spark):
    schema = "run_id string, model_name string, ts timestamp_ntz, drift_detected boolean, max_psi double, avg_psi double, drift_count int, features_with_drift array<string>, current_sample_count long"
    rows = spark.createDataFrame([(str(d), "m", None, True, 0.1 * d, 0.1, d, ["a"], 100 + d) for d in (1, 2, 3)], schema)
    rows = rows.withColumn("ts", F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(cast(run_id as int))"))
    row = rollups.drift_summary(rows, F.lit("2024-01-03 00:00:00").cast("timestamp_ntz"), 48).first()
    assert (row.runs, row.latest.run_id, row.latest.features_with_drift, row.latest.current_sample_count) == (2, "2", ["a"], 102)


def test_fare_of_a_nan_distance_is_the_minimum(spark):
    rows = spark.createDataFrame([(NAN, 10.0, 0)], "trip_distance double, trip_duration_minutes double, is_rush_hour int")
    assert not math.isnan(rows.select(baseline_fare().alias("f")).first().f) and rows.select(baseline_fare().alias("f")).first().f == 2.5
