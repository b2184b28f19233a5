"""Whitening of embeddings with covariances found by polarisation.

For two centred columns a and b, var(a + b) = var(a) + var(b) + 2 cov(a, b). So one aggregate of squares is enough:
of every dimension, and of the sum of every pair of dimensions. Values are whole numbers and are centred at the whole
part of their mean before squaring; the fraction left over is taken off exactly. The differences of those variances
give every covariance without rounding; their matrix is assembled and its eigenvectors are the components.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mlwatch.llm.matrices import SAFE, by_length, exact_sums
from mlwatch.llm.rows import table
from mlwatch.sources.shared import written

COMPONENTS = 16
SCALE = 64
OFFSET = 1_000_000
# Largest size of a scaled entry: sums of squares of up to 10^12 rows then fit 38 digits.
LIMIT = 1 << 40
# Rows that are centred, projected or squared at once.
STEP = 4096

SUMS = "length int, part int, total decimal(38,0)"


def whole_vectors(rows: DataFrame, id_col: str, vector: str, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(id, x): every entry c as the long floor(scale * c) + offset.

    Null and empty vectors and those with null or non-finite entries take no part, nor do entries of more than
    ``LIMIT`` after scaling, whose squares could not be summed exactly.
    """
    v = F.col(vector).cast("array<double>")
    fits = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) <= LIMIT))
    good = F.col(vector).isNotNull() & (F.size(v) > 0) & fits
    return rows.filter(good).select(
        F.col(id_col).alias("id"), F.transform(v, lambda c: F.floor(c * scale) + F.lit(offset)).alias("x")
    )


def _summed(fit: DataFrame, sums_of) -> dict[int, dict[int, int]]:
    """{length: {part: exact total}} of what ``sums_of`` (length, matrix) finds; each task sends one row per part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = defaultdict(int)
        for batch in batches:
            for length, _, x in by_length(batch.column(0)):
                for start in range(0, len(x), STEP):
                    for part, total in enumerate(sums_of(length, x[start : start + STEP])):
                        found[length, part] += total
        keys = sorted(found)
        columns = [
            pa.array([k[0] for k in keys], pa.int32()),
            pa.array([k[1] for k in keys], pa.int32()),
            pa.array([Decimal(found[k]) for k in keys], pa.decimal128(38, 0)),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["length", "part", "total"])

    out: dict[int, dict[int, int]] = defaultdict(dict)
    # one row per dimension or pair of dimensions
    for r in fit.select("x").mapInArrow(run, SUMS).groupBy("length", "part").agg(F.sum("total").alias("total")).collect():
        out[r.length][r.part] = int(r.total)
    return out


def counts_and_sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """{length: (n, S)} of the fit list, exact."""

    def sums(length: int, x: np.ndarray) -> list[int]:
        return [len(x), *exact_sums(x, int(np.abs(x).max()))]

    return {d: (parts[0], [parts[i + 1] for i in range(d)]) for d, parts in _summed(fit, sums).items()}


def covariances(fit: DataFrame, centres: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """{length: V}: the covariance matrix (divisor n), each entry the nearest double to its exact value."""
    means = {d: np.array([s // n for s in sums], np.int64) for d, (n, sums) in centres.items()}

    def squares(length: int, x: np.ndarray) -> list[int]:
        y = x - means[length]
        most, out = int(np.abs(y).max()), []
        for i in range(length):
            # dimension i alone, then its sums with every later one
            z = np.concatenate([y[:, i : i + 1], y[:, i : i + 1] + y[:, i + 1 :]], axis=1)
            if 4 * most * most * len(z) >= SAFE:
                z = z.astype(object)
            out += (z * z).sum(axis=0).tolist()
        return out

    found = {}
    for d, parts in _summed(fit, squares).items():
        n, sums = centres[d]
        left = [s - n * (s // n) for s in sums]  # n times what the whole part of the mean leaves
        # n^3 times the variance of each dimension and of each sum of two, at [i][j - i]
        spread, at = [], 0
        for i in range(d):
            rests = [left[i], *(left[i] + left[j] for j in range(i + 1, d))]
            spread.append([n * n * parts[at + k] - n * rest * rest for k, rest in enumerate(rests)])
            at += d - i
        v = np.zeros((d, d))
        for i in range(d):
            v[i, i] = spread[i][0] / n**3
            for j in range(i + 1, d):
                v[i, j] = v[j, i] = (spread[i][j - i] - spread[i][0] - spread[j][0]) / (2 * n**3)
        found[d] = v
    return found


def principal(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit eigenvectors as columns, eigenvalues, share of the trace) by falling eigenvalue.

    An eigenvalue that is zero but for rounding is given as zero.
    """
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    noise = max(0.0, float(values[0])) * len(v) * np.finfo(np.float64).eps
    values = np.where(values > noise, values, 0.0)
    trace = float(np.trace(v))
    return np.ascontiguousarray(vectors), values, values / trace if trace > 0 else np.full(len(values), np.nan)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x - S/n in double precision, n*x - S as exact whole numbers)."""
    mean = sums // n
    y, left = x - mean.astype(np.int64), sums - n * mean
    if n * (int(np.abs(y).max(initial=0)) + 1) >= SAFE:
        scaled = y.astype(object) * n - left
    else:
        scaled = y * np.int64(n) - left.astype(np.int64)
    return y - (left / n).astype(np.float64), scaled


def deviations(scaled: np.ndarray) -> list[int | None]:
    """Sums of squares of each row, exact; null where one doesn't fit a long."""
    most = int(np.abs(scaled).max(initial=0))
    if most * most * scaled.shape[1] >= SAFE:
        scaled = scaled.astype(object)
    sums = (scaled * scaled).sum(axis=1).tolist()
    return [s if s < 1 << 63 else None for s in sums]


def _identity_errors(fit: DataFrame, models: dict) -> dict[int, float]:
    """{length: largest entry of the whitened fit list's covariance minus the identity}, found by a pass over it."""
    held = fit.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for length, _, x in by_length(batch.column(0)):
                n, sums, vectors, values, _ = held.value[length]
                some = values > 0
                for start in range(0, len(x), STEP):
                    plain, _ = centred(x[start : start + STEP], n, sums)
                    w = plain @ vectors[:, some] / np.sqrt(values[some])
                    parts = np.append(w.sum(axis=0), (w.T @ w).ravel())
                    found[length] = found.get(length, 0) + parts
        keys = [(d, i) for d in found for i in range(len(found[d]))]
        columns = [
            pa.array([d for d, _ in keys], pa.int32()),
            pa.array([i for _, i in keys], pa.int32()),
            pa.array([float(found[d][i]) for d, i in keys], pa.float64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["length", "part", "total"])

    sums = fit.select("x").mapInArrow(run, "length int, part int, total double")
    totals = {(r[0], r[1]): r[2] for r in sums.groupBy("length", "part").agg(F.sum("total")).collect()}
    out = {}
    for d, (n, _, _, values, _) in models.items():
        k = int((values > 0).sum())
        mean = np.array([totals.get((d, i), 0.0) for i in range(k)]) / n
        products = np.array([totals.get((d, k + i), 0.0) for i in range(k * k)]).reshape(k, k) / n
        out[d] = float(np.abs(products - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))
    return out


def whiten(
    rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector: str = "embedding",
    scale: int = SCALE, offset: int = OFFSET,
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each usable row and component.

    The covariance is that of the distinct vectors; vectors of different lengths have fits of their own. Repeated
    rows and null ids give rows like any other, no usable vectors give none, extra columns are ignored. A component
    without variance (one distinct vector, dimensions that depend on others) has ``whitened`` null, and ``explained`` is
    null where there is no variance at all; ``identity_error`` is taken over the components that have some. What
    meets the driver is one number per pair of dimensions.
    """
    vectors = whole_vectors(rows, id_col, vector, scale, offset)
    fit = written(vectors.select("x").distinct(), "whitening-fit")
    centres = counts_and_sums(fit)
    models = {}
    for d, v in covariances(fit, centres).items():
        n, sums = centres[d]
        models[d] = (n, np.array(sums, object), *principal(v, components))
    errors = _identity_errors(fit, models)
    held = rows.sparkSession.sparkContext.broadcast({d: (*m, errors[d]) for d, m in models.items()})
    kind = dict(vectors.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, at, x in by_length(batch.column(1)):
                n, sums, vectors, values, explained, error = held.value[length]
                k = len(values)
                for start in range(0, len(x), STEP):
                    ids = batch.column(0).take(pa.array(np.repeat(at[start : start + STEP], k)))
                    plain, scaled = centred(x[start : start + STEP], n, sums)
                    rows = len(plain)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        white = plain @ vectors / np.sqrt(values)
                    white = np.where(values > 0, white, np.nan).ravel()
                    share = np.tile(explained, rows)
                    apart = [v for v in deviations(scaled) for _ in range(k)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids,
                            pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                            pa.array(np.full(rows * k, n, np.int64)),
                            pa.array(apart, pa.int64()),
                            pa.array(white, mask=np.isnan(white)),
                            pa.array(share, mask=np.isnan(share)),
                            pa.array(np.full(rows * k, error)),
                        ],
                        [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                    )

    schema = (
        f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    return vectors.mapInArrow(run, schema)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
