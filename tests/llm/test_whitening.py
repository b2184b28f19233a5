import math
from fractions import Fraction

import numpy as np
import pytest

from mlwatch.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, x string, id int, n int, component int"


def some_rows(d=8, shift=0.0):
    rng = np.random.default_rng(9)
    mix = rng.standard_normal((d, d))
    rows = [(i, (rng.standard_normal(d) @ mix + shift).tolist()) for i in range(120)]
    good = rows[0][1]
    return rows + [
        (3, rows[3][1]), (500, rows[3][1]), (501, None), (502, []), (504, [None, *good[1:]]),
        (505, [float("nan"), *good[1:]]), (506, [float("inf"), *good[1:]]), (None, good),
    ]


def usable(v):
    return bool(v) and all(c is not None and math.isfinite(c) for c in v)


def plain(rows, k):
    """Rows of (id, component, n, deviation, whitened, explained) from exact rational covariances."""
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if usable(v)]
    fit = [list(v) for v in {tuple(v) for _, v in kept}]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    apart = [[Fraction(n * a - s, n) for a, s in zip(v, sums)] for v in fit]
    d = len(sums)
    cov = np.array([[float(sum(v[i] * v[j] for v in apart) / n) for j in range(d)] for i in range(d)])
    e, vectors = np.linalg.eigh(cov)
    e, vectors = e[::-1], vectors[:, ::-1]
    out = []
    for i, v in kept:
        exact = [n * a - s for a, s in zip(v, sums)]
        white = np.array([a / n for a in exact]) @ vectors[:, :k] / np.sqrt(e[:k])
        out += [(i, c + 1, n, sum(a * a for a in exact), white[c], e[c] / np.trace(cov)) for c in range(min(k, d))]
    return out


@pytest.mark.parametrize("shift", [0.0, 5e6])
def test_whitening_equals_exact_covariances(spark, shift):
    rows = some_rows(shift=shift)
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA).repartition(3)
    found = whitening.whiten(df, components=5).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    found, expected = sorted(map(tuple, found), key=order), sorted(plain(rows, 5), key=order)
    assert [r[:4] for r in found] == [r[:4] for r in expected]
    for component in range(1, 6):
        a = np.array([r[4] for r in found if r[1] == component])
        b = np.array([r[4] for r in expected if r[1] == component])
        assert np.abs(a * np.sign(a @ b) - b).max() < 1e-8
    assert [r[5] for r in found] == pytest.approx([r[5] for r in expected], rel=1e-9)
    assert max(r[6] for r in found) < 1e-9


def test_polarised_variances_are_exact(spark, monkeypatch):
    """Squares of any size: values near the limit leave 64 bits."""
    rng = np.random.default_rng(2)
    x = rng.integers(-(1 << 39), 1 << 39, (50, 4))
    fit = spark.createDataFrame([(v,) for v in x.tolist()], "x array<long>")
    centres = whitening.counts_and_sums(fit)
    assert centres == {4: (50, x.sum(axis=0).tolist())}
    found = whitening.covariances(fit, centres)[4]
    mean = [Fraction(s, 50) for s in centres[4][1]]
    for i in range(4):
        for j in range(4):
            assert found[i, j] == float(sum((int(v[i]) - mean[i]) * (int(v[j]) - mean[j]) for v in x) / 50)


def test_components_without_variance(spark):
    flat = [(i, [float(i % 5), 2.0 * (i % 5), 1.0]) for i in range(20)]
    found = whitening.whiten(spark.createDataFrame([(*r, "x", 1, 2, 3) for r in flat], SCHEMA)).collect()
    assert {(r.component, r.whitened is None) for r in found} == {(1, False), (2, True), (3, True)}
    assert max(r.identity_error for r in found) < 1e-9
    one = spark.createDataFrame([(1, [1.0, 2.0], "x", 1, 2, 3)] * 2, SCHEMA)
    rows = whitening.whiten(one).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained) for r in rows] == [(1, 0, None, None)] * 4


def test_lengths_have_fits_of_their_own(spark):
    rows = some_rows(4) + [(1000 + i, v) for i, v in some_rows(3) if i is not None]
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)
    found = whitening.whiten(df).collect()
    assert {(r.n) for r in found} == {120} and {r.component for r in found if r.vec_id and r.vec_id >= 1000} == {1, 2, 3}


def test_empty_tables(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
