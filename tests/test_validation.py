"""Table, row and JSON validation on the representative cases."""

import pytest
from pyspark.sql import functions as F

from mlwatch.operators import validate
from mlwatch.spec import Rule, TRIP_SPEC

GOOD = dict(
    trip_distance=3.5, passenger_count=2, pickup_hour=14, pickup_day_of_week=3, pickup_month=6,
    trip_duration_minutes=15.0, is_weekend=0, is_rush_hour=0, RatecodeID=1, payment_type=1,
    pickup_borough="Manhattan", dropoff_borough="Brooklyn", fare_amount=18.5,
)
SCHEMA = ", ".join(
    f"{c} {'string' if 'borough' in c else 'double' if isinstance(GOOD[c], float) else 'int'}"
    for c in TRIP_SPEC.columns
)


def frame(spark, *changes):
    return spark.createDataFrame(
        [tuple({**GOOD, **c}[name] for name in TRIP_SPEC.columns) for c in changes], SCHEMA
    )


def failed(df, **kwargs):
    report = validate.validation_report(df, TRIP_SPEC, **kwargs).filter("failed")
    return {(r["column"], r.rule, r.bad_rows) for r in report.collect()}


def test_few_valid_rows_are_a_warning_only(spark):
    df = frame(spark, {}, {}, {})
    assert failed(df) == {(None, "low_row_count", 3)}
    summary = validate.validation_summary(validate.validation_report(df)).first()
    assert (summary.success, summary.errors, summary.warnings, summary.rows, summary.columns) == (True, 0, 1, 3, 13)
    assert failed(df, include_target=False) == set()


def test_table_rules(spark):
    df = frame(
        spark,
        {"trip_distance": 200.0, "pickup_borough": "Gotham"},
        {"passenger_count": None, "fare_amount": 1.0},
        {"trip_duration_minutes": float("nan"), "passenger_count": 7},
    ).drop("RatecodeID")
    assert failed(df) == {
        ("RatecodeID", "missing_column", 1),
        ("trip_distance", "value_above_maximum", 1),
        ("pickup_borough", "invalid_category", 1),
        ("passenger_count", "null_values", 1),
        ("passenger_count", "value_above_maximum", 1),
        ("fare_amount", "value_below_minimum", 1),
        ("trip_duration_minutes", "null_values", 1),
        (None, "low_row_count", 3),
    }
    with pytest.raises(ValueError, match="trip_distance: value_above_maximum"):
        validate.raise_on_errors(validate.validation_report(df))
    assert validate.column_differences(df, TRIP_SPEC) == {"missing": ["RatecodeID"], "extra": []}
    assert [tuple(r) for r in validate.invalid_values(df).collect()] == [("pickup_borough", "Gotham", 1)]


def test_all_null_column_fails_only_its_null_rule(spark):
    df = frame(spark, {"trip_distance": None}, {"trip_distance": None})
    assert {f for f in failed(df) if f[0]} == {("trip_distance", "null_values", 2)}


def test_empty_table(spark):
    assert failed(frame(spark, {}).filter("false")) == {(None, "low_row_count", 1)}


@pytest.mark.parametrize(
    "change, expected",
    [
        ({}, set()),
        ({"trip_distance": 150.0}, {("value_above_maximum", "trip_distance")}),
        ({"pickup_borough": "Gotham"}, {("invalid_category", "pickup_borough")}),
        ({"passenger_count": 0}, {("value_below_minimum", "passenger_count")}),
        ({"RatecodeID": 10}, {("value_above_maximum", "RatecodeID")}),
        ({"is_weekend": None}, {("null_value", "is_weekend")}),
        ({"fare_amount": -1.0}, set()),
    ],
)
def test_rows(spark, change, expected):
    row = validate.validate_rows(frame(spark, change)).first()
    assert {tuple(e) for e in row.errors} == expected


def test_row_types(spark):
    df = frame(spark, {}).withColumns(
        {
            "passenger_count": F.lit(2.0),
            "pickup_hour": F.lit(2.5),
            "payment_type": F.lit("1"),
            "dropoff_borough": F.lit(4),
        }
    ).drop("is_rush_hour")
    assert {tuple(e) for e in validate.validate_rows(df).first().errors} == {
        ("type_error", "pickup_hour"),
        ("type_error", "payment_type"),
        ("type_error", "dropoff_borough"),
        ("missing_features", "is_rush_hour"),
    }


def test_quarantine(spark):
    checked = validate.validate_rows(
        frame(spark, {}, {"trip_distance": 150.0}, {"trip_distance": 0.0, "passenger_count": 9})
    )
    assert validate.accepted(checked).count() == 1
    assert validate.quarantined(checked).count() == 2
    assert {tuple(r) for r in validate.failure_counts(checked).collect()} == {
        ("value_above_maximum", "trip_distance", 1),
        ("value_below_minimum", "trip_distance", 1),
        ("value_above_maximum", "passenger_count", 1),
    }


RULES = [Rule("n", "int", minimum=1, maximum=6), Rule("x", "float", nullable=True), Rule("s", "str", allowed=("a",))]


@pytest.mark.parametrize(
    "record, strict, coerce, expected",
    [
        ('{"n": 2, "x": 1.5, "s": "a"}', True, True, set()),
        ('{"n": 2.0, "x": 1, "s": "a"}', True, False, set()),
        ('{"n": 2.5, "x": 1, "s": "a"}', True, True, {("type_error", "n")}),
        ('{"n": "2", "x": "1.5", "s": "a"}', True, True, set()),
        ('{"n": "2", "x": 1, "s": "a"}', True, False, {("type_error", "n")}),
        ('{"n": true, "x": null, "s": "a"}', True, True, set()),
        ('{"n": null, "x": 1, "s": "b"}', True, True, {("null_value", "n"), ("invalid_category", "s")}),
        ('{"n": 9, "s": 3}', True, True, {("value_above_maximum", "n"), ("missing_features", "x"), ("type_error", "s")}),
        ('{"n": 2, "x": 1, "s": "a", "z": 1}', True, True, {("extra_features", "z")}),
        ('{"n": 2, "x": 1, "s": "a", "z": 1}', False, True, set()),
        ("not json", True, True, {("invalid_json", "")}),
        ("[1, 2]", True, True, {("invalid_json", "")}),
        (None, True, True, {("invalid_json", "")}),
    ],
)
def test_json(spark, record, strict, coerce, expected):
    df = spark.createDataFrame([(record,)], "r string")
    checked = validate.validate_json(df, "r", RULES, strict, coerce)
    assert checked.columns == ["r", "errors"]
    assert {tuple(e) for e in checked.first().errors} == expected
