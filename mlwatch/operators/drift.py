"""Distribution drift between a reference and a current sample, for many features and groups at once.

Two passes over the rows. The first finds, per group and side, the range, count and moments of every
feature in one columnar aggregate; its result has one row per group and feature, and is written to the
shared folder so that its size is known. The second gives every value its bin (or category) and counts
them with map-side partial aggregation, so what is shuffled is groups x features x bins, not rows.
PSI, KL and JS all come from that one histogram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mlwatch.functions.numbers import is_odd, null_safe, number, share
from mlwatch.functions.severity import psi_severity
from mlwatch.sources.shared import written
from mlwatch.spec import (
    DRIFT_BINS,
    EPSILON,
    MIN_DRIFT_FEATURES,
    MIN_SAMPLES,
    PREDICTION_PSI_THRESHOLD,
    PSI_THRESHOLD,
)

REFERENCE, CURRENT = "reference", "current"
PREDICTION = "prediction"
# What a stored run keeps of each feature.
DETAILS = ("position", "feature", "psi", "severity", "reference_mean", "current_mean", "reference_odd", "current_odd")


def sided(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """One table of both samples, marked by ``side``; only ``columns`` are kept."""
    return reference.select(*columns, F.lit(REFERENCE).alias("side")).unionByName(
        current.select(*columns, F.lit(CURRENT).alias("side"))
    )


def feature_moments(
    rows: DataFrame, numeric: list[str], categorical: list[str], by: list[str]
) -> DataFrame:
    """Per group, side and feature: rows, finite count, range, mean, population deviation, and the values
    that are no finite number (``odd``), which are in none of the others."""
    aggregates = []
    for name in numeric:
        value = number(name)
        aggregates.append(
            F.struct(
                F.min(value).alias("lo"),
                F.max(value).alias("hi"),
                F.count(value).alias("n"),
                F.avg(value).alias("mean"),
                F.stddev_pop(value).alias("std"),
                F.count_if(is_odd(name)).alias("odd"),
            ).alias(name)
        )
    aggregates += [F.count(name).alias(name) for name in categorical]
    wide = rows.groupBy(*by, "side").agg(F.count(F.lit(1)).alias("rows"), *aggregates)

    nothing = F.lit(None).cast("double")
    entries = []
    for position, name in enumerate([*numeric, *categorical]):
        is_numeric = name in numeric
        stats = (
            [F.col(f"`{name}`.{part}").alias(part) for part in ("lo", "hi", "n", "mean", "std", "odd")]
            if is_numeric
            else [
                nothing.alias("lo"),
                nothing.alias("hi"),
                F.col(name).alias("n"),
                nothing.alias("mean"),
                nothing.alias("std"),
                F.lit(0).cast("long").alias("odd"),
            ]
        )
        entries.append(
            F.struct(
                F.lit(position).alias("position"),
                F.lit(name).alias("feature"),
                F.lit(is_numeric).alias("is_numeric"),
                *stats,
            )
        )
    return wide.select(*by, "side", "rows", F.explode(F.array(*entries)).alias("f")).select(
        *by, "side", "rows", "f.*"
    )


def paired_moments(moments: DataFrame, by: list[str]) -> DataFrame:
    """Both sides of :func:`feature_moments` on one row, with the union range."""

    def of(side: str, column: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(column)))

    return moments.groupBy(*by, "position", "feature", "is_numeric").agg(
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        *[
            F.coalesce(of(side, column), F.lit(0)).alias(f"{side}_{name}")
            for side in (REFERENCE, CURRENT)
            for column, name in (("rows", "rows"), ("n", "count"), ("odd", "odd"))
        ],
        *[
            of(side, column).alias(f"{side}_{column}")
            for column in ("mean", "std")
            for side in (REFERENCE, CURRENT)
        ],
    )


def has_bin() -> Column:
    return F.col("value").isNotNull() & (F.col("hi") > F.col("lo"))


def with_bins(cells: DataFrame, bins: int) -> DataFrame:
    """Replace ``value``, ``lo`` and ``hi`` by the index of the equal-width ``bin`` of the value.

    Bins are half-open but the last is closed. A missing value or a range without width has no bin
    (filter with :func:`has_bin` before: a filter on ``bin`` itself would repeat the whole expression).
    The quotient can be off by one next to an edge, so it is corrected against the edges themselves.
    """
    value, lo = F.col("value"), F.col("lo")
    step, guess = F.col("step"), F.col("guess")
    # least() skips nulls, so a missing value is ruled out before it
    quotient = F.least(F.floor((value - lo) / F.nullif(step, F.lit(0.0))), F.lit(bins - 1))
    return (
        cells.withColumn("step", (F.col("hi") - lo) / F.lit(float(bins)))
        .withColumn("guess", F.when(has_bin(), quotient).cast("int"))
        .withColumn(
            "bin",
            F.when(value < lo + guess * step, guess - 1)
            .when((guess < bins - 1) & (value >= lo + (guess + 1) * step), guess + 1)
            .otherwise(guess),
        )
        .drop("value", "lo", "hi", "step", "guess")
    )


def group_ranges(paired: DataFrame, numeric: list[str], by: list[str]) -> DataFrame:
    """One row per group and side with the ``lo``/``hi`` of every numeric feature as a struct column."""
    ranges = [
        F.max(F.when(F.col("feature") == name, F.struct("lo", "hi"))).alias(f"{name}__range")
        for name in numeric
    ]
    sides = F.explode(F.array(F.lit(REFERENCE), F.lit(CURRENT))).alias("side")
    return paired.groupBy(*by).agg(*ranges).select("*", sides)


def binned_counts(
    rows: DataFrame,
    ranges: DataFrame | None,
    numeric: list[str],
    categorical: list[str],
    by: list[str],
    bins: int,
) -> DataFrame:
    """Counts per group, feature and bin or category for both sides; nulls and NaN are left out.

    ``ranges`` comes from :func:`group_ranges` and is needed for numeric features only.
    """
    keys = [*by, "side"]
    if numeric:
        bounds = ranges.withColumnsRenamed({k: f"__{k}" for k in keys})
        if not by:
            bounds = F.broadcast(bounds)  # two rows, one per side
        rows = rows.join(
            bounds, null_safe([rows[k] for k in keys], [bounds[f"__{k}"] for k in keys])
        )
    nothing = F.lit(None).cast("double")
    cells = [
        F.struct(
            F.lit(name).alias("feature"),
            number(name).alias("value"),
            F.col(f"{name}__range.lo").alias("lo"),
            F.col(f"{name}__range.hi").alias("hi"),
            F.lit(None).cast("string").alias("category"),
        )
        for name in numeric
    ] + [
        F.struct(
            F.lit(name).alias("feature"),
            nothing.alias("value"),
            nothing.alias("lo"),
            nothing.alias("hi"),
            F.col(name).cast("string").alias("category"),
        )
        for name in categorical
    ]
    tall = rows.select(*keys, F.explode(F.array(*cells)).alias("cell")).select(*keys, "cell.*")
    return (
        with_bins(tall.filter(has_bin() | F.col("category").isNotNull()), bins)
        .groupBy(*by, "feature", "bin", "category")
        .agg(
            F.count_if(F.col("side") == REFERENCE).alias("reference_n"),
            F.count_if(F.col("side") == CURRENT).alias("current_n"),
        )
    )


def divergence_terms(reference_share: Column, current_share: Column, eps: float = EPSILON) -> dict:
    """The PSI, KL and JS summand of one bin; shares are raised to ``eps`` and not rescaled."""
    p = F.greatest(reference_share, F.lit(eps))
    q = F.greatest(current_share, F.lit(eps))
    middle = (p + q) / 2.0
    return {
        "psi": (q - p) * F.ln(q / p),
        "kl": p * F.ln(p / q),
        "js": 0.5 * (p * F.ln(p / middle) + q * F.ln(q / middle)),
    }


def drift_rows(paired: DataFrame, sums: DataFrame, by: list[str]) -> DataFrame:
    """Final feature table from the moments and the summed terms."""
    keys = [*by, "feature"]
    right = sums.select(
        *[F.col(k).alias(f"__{k}") for k in keys],
        *[F.col(m).alias(f"__{m}") for m in ("psi", "kl", "js")],
    )
    on = null_safe([paired[k] for k in keys], [right[f"__{k}"] for k in keys])
    numeric = F.col("is_numeric")
    both = F.when(
        numeric, (F.col("reference_count") > 0) & (F.col("current_count") > 0)
    ).otherwise((F.col("reference_rows") > 0) & (F.col("current_rows") > 0))

    def measured(name: str) -> Column:
        return F.when(both, F.coalesce(F.col(f"__{name}"), F.lit(0.0))).otherwise(F.lit(0.0))

    return paired.join(right, on, "left").select(
        *by,
        "position",
        "feature",
        "is_numeric",
        measured("psi").alias("psi"),
        F.when(numeric, measured("kl")).alias("kl_divergence"),
        F.when(numeric, measured("js")).alias("js_divergence"),
        psi_severity(measured("psi")).alias("severity"),
        "reference_mean",
        "current_mean",
        "reference_std",
        "current_std",
        "reference_rows",
        "current_rows",
        "reference_count",
        "current_count",
        "reference_odd",
        "current_odd",
    )


def measured_pairs(
    rows: DataFrame,
    numeric: list[str],
    categorical: list[str] | None = None,
    by: list[str] | None = None,
) -> DataFrame:
    """First pass, written: one row per group and feature with both sides' moments and the range."""
    by, categorical = by or [], categorical or []
    moments = feature_moments(rows, numeric, categorical, by)
    return written(paired_moments(moments, by), "drift-moments")


def histogram_pair(
    rows: DataFrame,
    numeric: list[str],
    by: list[str] | None = None,
    bins: int = DRIFT_BINS,
) -> DataFrame:
    """Equal-width histogram of both sides over their union range: counts and shares per bin."""
    by = by or []
    paired = measured_pairs(rows, numeric, [], by)
    counts = binned_counts(rows, group_ranges(paired, numeric, by), numeric, [], by, bins)
    keys = [*by, "feature"]
    totals = paired.select(
        *[F.col(k).alias(f"__{k}") for k in keys], "reference_count", "current_count"
    )
    on = null_safe([counts[k] for k in keys], [totals[f"__{k}"] for k in keys])
    return counts.join(totals, on).select(
        *keys,
        "bin",
        "reference_n",
        "current_n",
        share(F.col("reference_n"), F.col("reference_count")).alias("reference_share"),
        share(F.col("current_n"), F.col("current_count")).alias("current_share"),
    )


def feature_drift(
    rows: DataFrame,
    numeric: list[str],
    categorical: list[str] | None = None,
    by: list[str] | None = None,
    bins: int = DRIFT_BINS,
) -> DataFrame:
    """One row per group and feature: PSI, KL, JS (numeric only), severity, and both sides' moments.

    ``rows`` holds both samples, told apart by ``side``. A feature named ``prediction`` is the score on
    the current side and the target on the reference side. An empty or constant feature has drift 0.
    """
    by, categorical = by or [], categorical or []
    rows = rows.select(*by, "side", *numeric, *categorical)
    paired = measured_pairs(rows, numeric, categorical, by)
    ranges = group_ranges(paired, numeric, by) if numeric else None
    counts = binned_counts(rows, ranges, numeric, categorical, by, bins)
    return drift_rows(paired, _summed_terms(counts, paired, by), by)


def _summed_terms(counts: DataFrame, paired: DataFrame, by: list[str]) -> DataFrame:
    keys = [*by, "feature"]
    totals = paired.select(
        *[F.col(k).alias(f"__{k}") for k in keys], "reference_count", "current_count"
    )
    on = null_safe([counts[k] for k in keys], [totals[f"__{k}"] for k in keys])
    terms = divergence_terms(
        share(F.col("reference_n"), F.col("reference_count")),
        share(F.col("current_n"), F.col("current_count")),
    )
    return (
        counts.join(totals, on)
        .groupBy(*keys)
        .agg(*[F.sum(term).alias(name) for name, term in terms.items()])
    )


def drift_verdict(
    drift: DataFrame,
    by: list[str] | None = None,
    threshold: float = PSI_THRESHOLD,
    min_features: int = MIN_DRIFT_FEATURES,
    prediction_threshold: float = PREDICTION_PSI_THRESHOLD,
    min_samples: int = MIN_SAMPLES,
) -> DataFrame:
    """One row per group judging :func:`feature_drift`; groups under ``min_samples`` give no row.

    The prediction counts as a drifted feature but not in ``max_psi``/``avg_psi``; its own flag uses
    ``prediction_threshold``.
    """
    by = by or []
    is_prediction = F.col("feature") == PREDICTION
    over = F.when(F.col("psi") >= threshold, F.struct("position", "feature"))
    judged = drift.groupBy(*by).agg(
        F.max("reference_rows").alias("reference_sample_count"),
        F.max("current_rows").alias("current_sample_count"),
        F.coalesce(F.max(F.when(~is_prediction, F.col("psi"))), F.lit(0.0)).alias("max_psi"),
        F.coalesce(F.avg(F.when(~is_prediction, F.col("psi"))), F.lit(0.0)).alias("avg_psi"),
        # one entry per feature of the spec at most
        F.array_sort(F.collect_list(over)).getField("feature").alias("features_with_drift"),
        F.max(F.when(is_prediction, F.col("psi"))).alias("prediction_psi"),
        F.array_sort(F.collect_list(F.struct(*[c for c in DETAILS if c in drift.columns]))).alias("feature_details"),
    )
    count = F.size("features_with_drift")
    return judged.filter(F.col("current_sample_count") >= min_samples).select(
        "*",
        count.alias("drift_count"),
        (count >= min_features).alias("drift_detected"),
        F.coalesce(F.col("prediction_psi") >= prediction_threshold, F.lit(False)).alias(
            "prediction_drift_detected"
        ),
        F.lit(threshold).alias("psi_threshold"),
        F.lit(min_features).alias("min_drift_features"),
    )
