"""Samples and splits are the same under every partitioning, also where keys repeat."""

import pytest

from mlwatch.operators import prepare
from mlwatch.sources import files
from mlwatch.sources.shared import scratch_path


def rows(spark):
    some = [(i // 3, i % 2, float(i % 7), None if i % 5 == 0 else str(i % 4), {"a": i % 3, "b": i}) for i in range(300)]
    return spark.createDataFrame(some, "k1 long, k2 int, x double, y string, m map<string,int>")


def plain(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("size", [1, 7, 100, 299, 300, 1000])
def test_fixed_samples_do_not_depend_on_partitioning(spark, size):
    df = rows(spark)
    expected = plain(prepare.fixed_sample(df, ["k1", "k2"], size))
    assert len(expected) == min(size, 300)
    for other in (df.repartition(1), df.repartition(5), df.orderBy("x"), df.coalesce(2).orderBy("y", "x")):
        assert plain(prepare.fixed_sample(other, ["k1", "k2"], size)) == expected


def test_snapshots_do_not_depend_on_partitioning(spark):
    df = rows(spark).drop("m")
    found = []
    for other in (df, df.repartition(6), df.orderBy("x"), df.coalesce(1)):
        path = scratch_path(spark, "snapshot")
        files.write_snapshot(other, path, ["k1", "k2"], rows=50)
        found.append(plain(files.read_table(spark, path, df.schema)))
    assert found[0] == found[1] == found[2] == found[3] and len(found[0]) == 50


def test_fixed_sample_of_no_rows(spark):
    assert prepare.fixed_sample(rows(spark).limit(0), ["k1"], 5).count() == 0
