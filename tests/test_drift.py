"""Drift against numpy, on edge cases, and windowed drift against one-group drift."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mlwatch.operators.drift import drift_verdict, feature_drift, histogram_pair, sided
from mlwatch.operators.drift_windows import counted_cells, shared_reference_drift, summarise_reference, values_below

EPS = 1e-6


def numpy_shares(reference, current, bins=20):
    reference, current = reference[~np.isnan(reference)], current[~np.isnan(current)]
    if not len(reference) or not len(current):
        return None
    lo, hi = min(reference.min(), current.min()), max(reference.max(), current.max())
    if lo == hi:
        return None
    edges = np.linspace(lo, hi, bins + 1)
    p = np.histogram(reference, bins=edges)[0] / len(reference)
    q = np.histogram(current, bins=edges)[0] / len(current)
    return np.clip(p, EPS, 1), np.clip(q, EPS, 1)


def numpy_drift(reference, current):
    shares = numpy_shares(np.asarray(reference, float), np.asarray(current, float))
    if shares is None:
        return 0.0, 0.0, 0.0
    p, q = shares
    m = (p + q) / 2
    return (
        float(((q - p) * np.log(q / p)).sum()),
        float((p * np.log(p / q)).sum()),
        float(0.5 * (p * np.log(p / m)).sum() + 0.5 * (q * np.log(q / m)).sum()),
    )


def category_psi(reference, current):
    if not len(reference) or not len(current):
        return 0.0
    p, q = (pd.Series(s, dtype=object).value_counts(normalize=True) for s in (reference, current))
    total = 0.0
    for name in set(p.index) | set(q.index):
        a, b = max(p.get(name, EPS), EPS), max(q.get(name, EPS), EPS)
        total += (b - a) * math.log(b / a)
    return total


def rows(spark, reference, current, kind="double"):
    frame = [("reference", v) for v in reference] + [("current", v) for v in current]
    return spark.createDataFrame(frame, f"side string, v {kind}")


NAN = float("nan")
CASES = {
    "shifted": (
        np.random.default_rng(1).normal(0, 1, 400).tolist(),
        np.random.default_rng(2).normal(1, 2, 300).tolist(),
    ),
    "with_nan_and_null": ([1.0, NAN, 2.0, None, 5.0], [2.0, 3.0, NAN, None]),
    "one_row": ([1.0], [2.0]),
    "constant": ([3.0, 3.0], [3.0]),
    "all_null": ([None, None], [1.0, 2.0]),
    "all_nan": ([1.0, 2.0], [NAN, NAN]),
    "on_edges": ([float(i) / 20 for i in range(21)], [float(i) / 10 for i in range(11)]),
    "awkward_edges": ([0.1 * i for i in range(71)], [0.7 * i for i in range(11)]),
    "one_bin": ([0.0, 100.0], [100.0] * 50),
    "integers": ([float(i % 7) for i in range(200)], [float(i % 5) for i in range(100)]),
}


@pytest.mark.parametrize("name", CASES)
def test_numeric_drift_equals_numpy(spark, name):
    reference, current = CASES[name]
    row = feature_drift(rows(spark, reference, current), ["v"]).first()
    clean = [np.array([np.nan if v is None else v for v in s], float) for s in (reference, current)]
    psi, kl, js = numpy_drift(*clean)
    assert (row.psi, row.kl_divergence, row.js_divergence) == pytest.approx((psi, kl, js), abs=1e-12)
    for side, values in zip(("reference", "current"), clean):
        known = values[~np.isnan(values)]
        assert row[f"{side}_rows"] == len(values)
        if len(known):
            assert row[f"{side}_mean"] == pytest.approx(known.mean())
            assert row[f"{side}_std"] == pytest.approx(known.std())
        else:
            assert row[f"{side}_mean"] is None


def test_missing_side_gives_no_drift(spark):
    row = feature_drift(rows(spark, [1.0, 2.0], []), ["v"]).first()
    assert (row.psi, row.current_rows, row.severity) == (0.0, 0, "none")


@pytest.mark.parametrize(
    "reference, current",
    [
        (["a", "a", "b"], ["a", "c", "c"]),
        (["a", None, "b"], ["b", None, None]),
        (["a"], ["a"]),
        ([None, None], ["a", "b"]),
        (["a", "b"], []),
    ],
)
def test_category_drift(spark, reference, current):
    row = feature_drift(rows(spark, reference, current, "string"), [], ["v"]).first()
    assert row.psi == pytest.approx(category_psi(reference, current), abs=1e-12)
    assert row.kl_divergence is None


def test_symmetry_and_bounds(spark):
    reference, current = CASES["shifted"]
    there = feature_drift(rows(spark, reference, current), ["v"]).first()
    back = feature_drift(rows(spark, current, reference), ["v"]).first()
    same = feature_drift(rows(spark, reference, reference), ["v"]).first()
    assert there.psi == pytest.approx(back.psi)
    assert there.js_divergence == pytest.approx(back.js_divergence)
    assert 0 <= there.js_divergence <= math.log(2)
    assert (same.psi, same.kl_divergence, same.js_divergence) == pytest.approx((0, 0, 0), abs=1e-12)


def test_histogram_counts_every_value_once(spark):
    reference, current = CASES["awkward_edges"]
    found = histogram_pair(rows(spark, reference, current), ["v"], bins=10).toPandas()
    edges = np.linspace(0, max(reference + current), 11)
    expected = np.histogram(reference, bins=edges)[0]
    by_bin = found.set_index("bin")["reference_n"].to_dict()
    assert [by_bin.get(i, 0) for i in range(10)] == list(expected)
    assert found["current_n"].sum() == len(current)


def grouped(spark):
    rng = np.random.default_rng(7)
    reference, current = [], []
    for model in ("a", "b", None):
        shift = {"a": 0.0, "b": 3.0, None: 1.0}[model]
        for _ in range(300):
            reference.append((model, float(rng.normal(shift, 1)), str(rng.integers(0, 4))))
        reference += [(model, shift, "hot")] * 150  # a third of the rows share one value
        reference.append((model, NAN, None))
        for day in range(4):
            for _ in range(60 + day):
                category = str(rng.integers(0, 5)) if day else None
                current.append((model, day, float(rng.normal(shift + day, 1 + day)), category))
    reference += [("unused", 1.0, "x")]
    current.append(("unseen", 0, 1.0, "x"))
    return (
        spark.createDataFrame(reference, "model string, v double, c string"),
        spark.createDataFrame(current, "model string, day int, v double, c string"),
    )


def test_shared_reference_equals_one_group_at_a_time(spark):
    reference, current = grouped(spark)
    found = shared_reference_drift(
        reference, current, ["v"], ["c"], by=["model", "day"], reference_by=["model"]
    ).toPandas()
    ref, cur = reference.toPandas(), current.toPandas()
    assert len(found) == 2 * 13
    for row in found.itertuples():
        model = row.model if isinstance(row.model, str) else None
        r = ref[ref.model.isnull()] if model is None else ref[ref.model == model]
        c = cur[(cur.model.isnull() if model is None else cur.model == model) & (cur.day == row.day)]
        if row.feature == "v":
            expected = numpy_drift(r.v.to_numpy(), c.v.to_numpy())
            got = (row.psi, row.kl_divergence, row.js_divergence)
        else:
            expected, got = category_psi(list(r.c), list(c.c)), row.psi
        assert got == pytest.approx(expected, abs=1e-9)
        assert (row.reference_rows, row.current_rows) == (len(r), len(c))


def test_shared_reference_without_keys_equals_plain_drift(spark):
    reference, current = grouped(spark)
    one = shared_reference_drift(reference, current, ["v"], ["c"]).orderBy("feature").collect()
    two = feature_drift(sided(reference, current, ["v", "c"]), ["v"], ["c"]).orderBy("feature").collect()
    assert [r.psi for r in one] == pytest.approx([r.psi for r in two])


def test_shuffled_joins_give_the_same_result(spark):
    """Beyond the broadcast threshold: the joins go by shuffle, the values stay."""
    reference, current = grouped(spark)

    def results():
        plain = feature_drift(sided(reference, current, ["model", "v", "c"]), ["v"], ["c"], ["model"])
        shared = shared_reference_drift(
            reference, current, ["v"], ["c"], by=["model", "day"], reference_by=["model"]
        )
        return [
            sorted((str(r.model), r.feature, round(r.psi, 9), r.current_rows) for r in frame.collect())
            for frame in (plain, shared)
        ]

    expected = results()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert results() == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


@pytest.fixture
def ranges(spark, request):
    """A session that keeps so many ranges apart, however small they are."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    for key, value in old.items():
        spark.conf.set(key, value)


@pytest.mark.parametrize("ranges", [1, 2, 7, 64], indirect=True)
def test_values_below(spark, ranges):
    rng = np.random.default_rng(3)
    rows, asked, expected = [], [], {}
    for key in ("f", "g", None):
        values = np.unique(rng.integers(0, 500, 200)).astype(float)
        counts = rng.integers(1, 50, len(values))
        points = [float(p) for p in rng.integers(-5, 510, 60)]
        rows += [(key, float(x), int(n)) for x, n in zip(values, counts)]
        asked += [(key, p) for p in points]
        expected |= {(key, p): int(counts[values < p].sum()) for p in points}
    found = values_below(
        spark.createDataFrame(rows, "f string, x double, n long"), spark.createDataFrame(asked, "f string, x double"), ["f"]
    )
    assert {(r.f, r.x): r.below for r in found.collect()} == expected


def test_values_below_are_dealt_out_by_ranges(spark):
    """Ranges come from the shuffle: nothing gathers cuts of a feature and compares every row with them."""
    values = spark.createDataFrame([("f", float(i), 1) for i in range(50)], "f string, x double, n long")
    found = values_below(values, values.select("f", "x"), ["f"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "filter(" not in plan and "collect_list" not in plan


def test_counted_cells_of_parts_give_the_drift_of_the_whole(spark):
    """Drift of groups whose cells were counted in parts equals the drift found from their rows."""
    rng = np.random.default_rng(8)
    odd = [float("nan"), float("inf"), None]
    current = [
        (f"w{i % 3}", i % 5, odd[i % 3] if i % 17 == 0 else float(rng.integers(0, 30)) + 1e9, None if i % 13 == 0 else str(i % 4))
        for i in range(600)
    ] + [("lone", 0, None, None)]
    reference = [(float(rng.integers(0, 40)) + 1e9, str(i % 5)) for i in range(300)]
    rows = spark.createDataFrame(current, "w string, part int, a double, c string")
    ref = spark.createDataFrame(reference, "a double, c string")
    summary = summarise_reference(ref, ["a"], ["c"])
    cells = counted_cells(rows, ["a"], ["c"], ["w", "part"])
    whole = cells.groupBy("w", "feature", "x", "category", "odd").agg(F.sum("n").alias("n"))
    found = shared_reference_drift(None, whole, ["a"], ["c"], ["w"], summary=summary, counted=True)
    expected = shared_reference_drift(ref, rows, ["a"], ["c"], ["w"])
    table = lambda df: {
        (r["w"], r["feature"]): [round(v, 6) if isinstance(v, float) else v for v in r] for r in df.select(sorted(df.columns)).collect()
    }
    found, expected = table(found), table(expected)
    assert found == expected and len(found) == 8


def test_verdict(spark):
    drift = spark.createDataFrame(
        [
            ("m", 0, "a", 0.3, 500, 200),
            ("m", 1, "b", 0.2, 500, 200),
            ("m", 2, "c", 0.1, 500, 200),
            ("m", 3, "prediction", 0.9, 500, 200),
            ("few", 0, "a", 0.9, 500, 99),
            ("calm", 0, "a", 0.19, 500, 100),
            ("calm", 1, "prediction", 0.16, 500, 100),
        ],
        "model string, position int, feature string, psi double, reference_rows long, current_rows long",
    )
    found = {r.model: r for r in drift_verdict(drift, ["model"]).collect()}
    assert set(found) == {"m", "calm"}
    m = found["m"]
    assert m.features_with_drift == ["a", "b", "prediction"]
    assert (m.drift_count, m.drift_detected, m.max_psi) == (3, True, 0.3)
    assert m.avg_psi == pytest.approx(0.2)
    calm = found["calm"]
    assert (calm.drift_detected, calm.prediction_drift_detected, calm.features_with_drift) == (False, True, [])
