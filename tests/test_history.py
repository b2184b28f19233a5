"""History tables and files."""

import pytest
from pyspark.sql import functions as F

from mlwatch.operators import prepare
from mlwatch.sources import files, history
from mlwatch.sources.shared import scratch_path, shared_dir, written


def log(spark, *rows):
    return spark.createDataFrame(rows, "id string, at string, v int").select(
        "id", F.col("at").cast("timestamp_ntz").alias("ts"), "v"
    )


@pytest.mark.parametrize("by_date", [False, True])
def test_append_unique_keeps_the_first_row_of_a_key(spark, by_date):
    path = scratch_path(spark, "test-log")
    first = log(spark, ("a", "2024-01-01 10:00:00", 1), ("a", "2024-01-01 09:00:00", 2), ("b", "2024-01-02 00:00:00", 3))
    again = log(spark, ("a", "2024-01-01 09:00:00", 9), ("c", "2024-01-02 01:00:00", 4))
    for part in (first, again, again):
        history.append_unique(part, path, "id", "ts", dates_fixed_by_key=by_date)
    history.append_unique(first.filter("false"), path, "id", "ts", dates_fixed_by_key=by_date)
    found = history.read_history(spark, path)
    assert {(r.id, r.v) for r in found.collect()} == {("a", 2), ("b", 3), ("c", 4)}
    assert found.count() == 3


def test_an_append_reads_the_buckets_of_its_own_keys(spark):
    """Dates are not fixed by the key: the keys of all dates are compared, but of the touched buckets only."""
    path = scratch_path(spark, "test-log")
    days = [(f"k{i}", f"2024-01-{1 + i % 9:02d} 12:00:00", i) for i in range(200)]
    history.append_unique(log(spark, *days), path, "id", "ts")
    fresh = log(spark, ("k7", "2024-03-01 00:00:00", 0)).withColumn("key_bucket", history.key_bucket("id"))
    bucket = fresh.first().key_bucket
    present = history.present_keys(fresh, spark.read.parquet(path), "id")
    plan = present._jdf.queryExecution().executedPlan().toString()
    filters = next(part for part in plan.split("PartitionFilters: ")[1:] if "key_bucket" in part).splitlines()[0]
    assert f"= {bucket})" in filters and "date" not in filters.split("]")[0]
    schema = next(part for part in plan.split("ReadSchema: ")[1:] if "id" in part).splitlines()[0]
    assert "v:" not in schema and [r.id for r in present.collect()] == ["k7"]
    history.append_unique(log(spark, ("k7", "2024-03-01 00:00:00", 0), ("new", "2024-03-01 00:00:00", 1)), path, "id", "ts")
    found = history.read_history(spark, path)
    assert found.count() == 201 and "key_bucket" not in found.columns


def test_append_to_a_table_without_buckets(spark):
    path = scratch_path(spark, "test-log")
    old = log(spark, ("a", "2024-01-01 10:00:00", 1), ("b", "2024-01-02 10:00:00", 2)).withColumn("date", F.to_date("ts"))
    old.write.partitionBy("date").parquet(path)
    present = history.present_keys(
        log(spark, ("b", "2024-02-02 10:00:00", 9)).withColumn("key_bucket", history.key_bucket("id")),
        spark.read.schema(old.schema.add("key_bucket", "integer")).parquet(path), "id",
    )
    assert [r.id for r in present.collect()] == ["b"]


def test_window_prunes_partitions(spark):
    path = scratch_path(spark, "test-log")
    days = [("k%d" % d, "2024-01-%02d 12:00:00" % d, d) for d in range(1, 11)]
    history.append_unique(log(spark, *days), path, "id", "ts")
    window = history.trailing_window(spark.read.parquet(path), "ts", "2024-01-05 12:00:00", 24)
    assert {r.v for r in window.collect()} == {4, 5}
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "PushedFilters: [IsNotNull(ts)" in plan


def test_upgrade(spark):
    old = spark.createDataFrame([(1, "x", None), (2, "y", 3.0)], "id int, prediction string, fare double")
    new = history.upgrade_table(old, ["prediction", "probability"], {"fare": 0.0, "extra": 1.0})
    assert [tuple(r) for r in new.orderBy("id").collect()] == [(1, 0.0, 1.0), (2, 3.0, 1.0)]
    history.assert_not_null(new, ["fare"])
    with pytest.raises(ValueError, match="fare"):
        history.assert_not_null(old, ["fare"])


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, 2)], "id int, n int")
    b = spark.createDataFrame([(2, 2.5, "x")], "id int, n double, extra string")
    found = files.union_normalised([a, b], {"n": "double"}).orderBy("id").collect()
    assert [tuple(r) for r in found] == [(1, 2.0, None), (2, 2.5, "x")]


def test_write_once(spark):
    path = scratch_path(spark, "once")
    files.write_once(spark.range(3), path)
    files.write_once(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3


def test_snapshot_is_bounded_and_repeatable(spark):
    df = spark.range(500).withColumn("v", F.col("id") * 0.5)
    paths = [scratch_path(spark, "snapshot") for _ in range(2)]
    files.write_snapshot(df, paths[0], ["id"], rows=50)
    files.write_snapshot(df.repartition(7), paths[1], ["id"], rows=50)
    parts = [files.read_table(spark, p, df.schema).collect() for p in paths]
    assert len(parts[0]) == 50 and set(parts[0]) == set(parts[1])
    assert files.read_table(spark, paths[0]).dtypes == [("id", "int"), ("v", "double")]


def test_split_and_cap(spark):
    df = spark.range(10_000)
    train, test = prepare.split_by_key(df, ["id"])
    assert train.count() + test.count() == 10_000 and 7800 < train.count() < 8200
    assert train.join(test, "id").count() == 0
    assert prepare.cap_by_key(df, ["id"], 20_000).count() == 10_000
    capped = prepare.cap_by_key(df, ["id"], 1000)
    assert 850 < capped.count() < 1150
    assert set(capped.collect()) == set(prepare.cap_by_key(df.repartition(9), ["id"], 1000).collect())


def test_lookup_keeps_the_row_count(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    zones = spark.createDataFrame([(1, "north"), (3, "south"), (1, "over"), (None, "void")], "id int, zone string")
    found = prepare.lookup(df, zones, "k", "id", "zone", "z", missing="Unknown")
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == ["(1, 'north')", "(2, 'Unknown')", "(None, 'Unknown')"]
    assert "broadcast" not in found._jdf.queryExecution().analyzed().toString().lower()


def test_prepare_casts_what_does_not_fit_to_null(spark):
    from tests.test_validation import frame

    odd = frame(spark, {}, {}, {}).withColumns(
        {
            "passenger_count": F.when(F.monotonically_increasing_id() < 0, 1.0).otherwise(2.9),
            "fare_amount": F.lit("12.5"),
            "RatecodeID": F.lit("x"),
        }
    )
    typed = prepare.cast_to_rules(odd)
    row = typed.first()
    assert (row.passenger_count, row.fare_amount, row.RatecodeID) == (2, 12.5, None)
    assert prepare.prepare(odd).count() == 0
    assert prepare.prepare(odd.withColumn("RatecodeID", F.lit(1.0))).count() == 3


def test_missing_target(spark):
    with pytest.raises(ValueError, match="fare_amount"):
        prepare.feature_target_split(spark.range(1))


def test_shared_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == (configured or shared_dir(spark)).rstrip("/")
    assert written(spark.range(0), "empty").count() == 0
