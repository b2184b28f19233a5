"""Drift of many current groups (models, days, windows) against a reference they share.

Each group has its own bin edges, as its range is the union of its own and the reference's. Counting the
reference again for every group would pair all its rows with all groups. Instead the reference is
reduced to distinct values with counts, the groups to their distinct edges, and one sorted pass over both,
partitioned by ranges of values, finds how many reference values lie below each edge. Categories need no pairing
either: what the categories absent from a group add is the reference's own sum less the share of those present.

A current sample can itself come as counted cells (:func:`counted_cells`): those of panes of time, counted once
each, add up to any window made of whole panes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from mlwatch.functions.numbers import is_odd, null_safe, number, share
from mlwatch.operators.drift import (
    CURRENT,
    REFERENCE,
    drift_rows,
    divergence_terms,
    feature_drift,
    feature_moments,
    has_bin,
    sided,
    with_bins,
)
from mlwatch.sources.shared import written
from mlwatch.spec import DRIFT_BINS


@dataclass(frozen=True)
class ReferenceSummary:
    """What drift needs of a reference, each part written once: moments, distinct numbers and categories with
    their counts."""

    moments: DataFrame
    values: DataFrame | None
    categories: DataFrame | None


def summarise_reference(
    reference: DataFrame, numeric: list[str], categorical: list[str], reference_by: list[str] | None = None
) -> ReferenceSummary:
    """Reduce a reference that many checks share."""
    by = reference_by or []
    sided_rows = reference.withColumn("side", F.lit(REFERENCE))
    moments = written(feature_moments(sided_rows, numeric, categorical, by), "reference-moments")
    cells = [F.struct(F.lit(c).alias("feature"), number(c).alias("x")) for c in numeric]
    values = categories = None
    if numeric:
        tall = reference.select(*by, F.explode(F.array(*cells)).alias("cell")).select(*by, "cell.*")
        counted = tall.filter("x is not null").groupBy(*by, "feature", "x").agg(F.count(F.lit(1)).alias("n"))
        values = written(counted, "reference-values")
    if categorical:
        categories = written(
            _category_counts(reference, categorical, by, "reference_n"), "reference-categories"
        )
    return ReferenceSummary(moments, values, categories)


def _side(moments: DataFrame, side: str, keys: list[str]) -> DataFrame:
    names = {"lo": "lo", "hi": "hi", "n": "count", "mean": "mean", "std": "std", "rows": "rows", "odd": "odd"}
    return moments.select(
        *keys,
        "position",
        "feature",
        "is_numeric",
        *[F.col(c).alias(f"{side}_{n}") for c, n in names.items()],
    )


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join that keeps the left keys only."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = null_safe([left[k] for k in keys], [renamed[f"__{k}"] for k in keys])
    return left.join(renamed, on, how).drop(*[f"__{k}" for k in keys])


def counted_cells(rows: DataFrame, numeric: list[str], categorical: list[str], by: list[str]) -> DataFrame:
    """(``by``, feature, x, category, odd, n): how often each value of each feature occurs per group.

    Finite numbers have ``x``, categories ``category``, values that are no finite number only ``odd``; nulls are left out, and
    the feature with an empty name counts rows. Cells of parts of a sample add up to those of the whole: sum ``n``.
    """
    nothing, text = F.lit(None).cast("double"), F.lit(None).cast("string")

    def cell(feature: str, x: Column, category: Column, odd: Column) -> Column:
        return F.struct(F.lit(feature).alias("feature"), x.alias("x"), category.alias("category"), odd.alias("odd"))

    cells = [
        cell("", nothing, text, F.lit(False)),
        *[cell(c, number(c), text, F.coalesce(is_odd(c), F.lit(False))) for c in numeric],
        *[cell(c, nothing, F.col(c).cast("string"), F.lit(False)) for c in categorical],
    ]
    some = (F.col("feature") == "") | F.col("x").isNotNull() | F.col("category").isNotNull() | F.col("odd")
    tall = rows.select(*by, F.explode(F.array(*cells)).alias("cell")).select(*by, "cell.*").filter(some)
    return tall.groupBy(*by, "feature", "x", "category", "odd").agg(F.count(F.lit(1)).alias("n"))


def cell_moments(cells: DataFrame, numeric: list[str], categorical: list[str], by: list[str]) -> DataFrame:
    """:func:`mlwatch.operators.drift.feature_moments` of a sample given as counted cells."""
    x, n = F.col("x"), F.col("n")
    sums = cells.groupBy(*by, "feature").agg(
        F.min("x").alias("lo"),
        F.max("x").alias("hi"),
        F.coalesce(F.sum(F.when(x.isNotNull() | F.col("category").isNotNull(), n)), F.lit(0)).alias("count"),
        (F.sum(x * n) / F.sum(F.when(x.isNotNull(), n))).alias("mean"),
        F.coalesce(F.sum(F.when(F.col("odd"), n)), F.lit(0)).alias("odd_n"),
        F.sum("n").alias("all_n"),
    )
    apart = F.col("x") - F.col("mean")
    spread = (
        _join(cells.filter("x is not null"), sums.select(*by, "feature", "mean"), [*by, "feature"])
        .groupBy(*by, "feature")
        .agg(F.sqrt(F.sum(apart * apart * F.col("n")) / F.sum("n")).alias("std"))
    )
    features = [
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"), F.lit(c in numeric).alias("is_numeric"))
        for i, c in enumerate([*numeric, *categorical])
    ]
    every = (
        sums.filter("feature = ''")
        .select(*by, F.col("all_n").alias("rows"), F.explode(F.array(*features)).alias("f"))
        .select(*by, "rows", "f.*")
    )
    keys = [*by, "feature"]
    found = _join(_join(every, sums, keys, "left"), spread, keys, "left")
    return found.select(
        *by, "rows", "position", "feature", "is_numeric", "lo", "hi", F.coalesce("count", F.lit(0)).alias("n"),
        "mean", "std", F.coalesce("odd_n", F.lit(0)).alias("odd"),
    )


def shared_reference_pairs(
    summary: ReferenceSummary, cur: DataFrame, by: list[str], reference_by: list[str]
) -> DataFrame:
    """Both sides' moments per current group and feature, with the union range; written once."""
    ref = _side(summary.moments, REFERENCE, reference_by).drop("position", "is_numeric")
    paired = _join(_side(cur, CURRENT, by), ref, [*reference_by, "feature"], "left")
    zero = ["reference_rows", "reference_count", "reference_odd"]
    return written(
        paired.withColumns(
            {
                "lo": F.least("reference_lo", "current_lo"),
                "hi": F.greatest("reference_hi", "current_hi"),
            }
        ).fillna(0, subset=zero),
        "drift-window-moments",
    )


def values_below(values: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """For every distinct point ``x``, the summed ``n`` of the values under it (``keys``, x, below).

    ``values`` holds distinct ``x`` per key with their count ``n``. Values and points are dealt out together by
    ranges of (``keys``, x), as for a sort; each range is summed in order, and what the ranges before it hold of the
    same key is added. A row is compared with its range alone, and the ranges grow in number with the rows.
    """
    both = values.select(*keys, "x", "n", F.lit(0).alias("is_point")).unionByName(
        points.select(*keys, "x").distinct().select(
            *keys, "x", F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("is_point")
        )
    )
    # rows with the same keys and x share a range; its number follows their order
    placed = written(
        both.repartitionByRange(*keys, "x").withColumn("piece", F.spark_partition_id()), "drift-points"
    )
    totals = placed.groupBy(*keys, "piece").agg(F.sum("n").alias("piece_n"))
    earlier = Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "piece", F.coalesce(F.sum("piece_n").over(earlier), F.lit(0)).alias("offset")
    )
    in_order = (
        Window.partitionBy(*keys, "piece")
        .orderBy("x", F.col("is_point").desc())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    counted = placed.withColumn("within", F.sum("n").over(in_order)).filter("is_point = 1")
    return _join(counted, offsets, [*keys, "piece"]).select(
        *keys, "x", (F.col("offset") + F.col("within")).alias("below")
    )


def reference_counts(
    values: DataFrame,
    paired: DataFrame,
    by: list[str],
    reference_by: list[str],
    bins: int,
) -> DataFrame:
    """Reference values per group, feature and bin of that group's range."""
    keys = [*reference_by, "feature"]
    ranges = paired.filter(F.col("is_numeric") & (F.col("hi") > F.col("lo")))
    step = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    edges = written(
        ranges.select(*keys, "lo", "hi")
        .distinct()
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
        .withColumn("x", F.col("lo") + F.col("bin") * step),
        "drift-edges",
    )
    below = values_below(values, edges, keys)
    at_edges = _join(edges, below, [*keys, "x"])
    histogram = at_edges.groupBy(*keys, "lo", "hi").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("bin", "below"))), lambda e: e["below"]
        ).alias("below")  # one entry per bin
    )
    per_group = _join(ranges, histogram, [*keys, "lo", "hi"])
    next_below = F.coalesce(
        F.get("below", F.col("bin") + 1), F.col("reference_count")
    )
    every_bin = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    return per_group.select(*by, "feature", "reference_count", "below", every_bin).select(
        *by, "feature", "bin", (next_below - F.get("below", F.col("bin"))).alias("reference_n")
    )


def current_counts(
    current: DataFrame, paired: DataFrame, numeric: list[str], by: list[str], bins: int
) -> DataFrame:
    """Current values per group, feature and bin."""
    ranges = paired.groupBy(*by).agg(
        *[
            F.max(F.when(F.col("feature") == c, F.struct("lo", "hi"))).alias(f"{c}__range")
            for c in numeric
        ]
    )
    cells = [
        F.struct(
            F.lit(c).alias("feature"),
            number(c).alias("value"),
            F.col(f"{c}__range.lo").alias("lo"),
            F.col(f"{c}__range.hi").alias("hi"),
        )
        for c in numeric
    ]
    tall = (
        _join(current.select(*by, *numeric), ranges, by)
        .select(*by, F.explode(F.array(*cells)).alias("cell"))
        .select(*by, "cell.*")
    )
    return (
        with_bins(tall.filter(has_bin()), bins)
        .groupBy(*by, "feature", "bin")
        .agg(F.count(F.lit(1)).alias("current_n"))
    )


def cell_counts(cells: DataFrame, paired: DataFrame, by: list[str], bins: int) -> DataFrame:
    """:func:`current_counts` of a sample given as counted cells."""
    keys = [*by, "feature"]
    ranges = paired.filter("is_numeric").select(*keys, "lo", "hi")
    values = cells.filter("x is not null").select(*keys, F.col("x").alias("value"), "n")
    binned = with_bins(_join(values, ranges, keys).filter(has_bin()), bins)
    return binned.groupBy(*keys, "bin").agg(F.sum("n").alias("current_n"))


def _category_counts(df: DataFrame, categorical: list[str], by: list[str], name: str) -> DataFrame:
    cells = [
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("category"))
        for c in categorical
    ]
    return (
        df.select(*by, F.explode(F.array(*cells)).alias("cell"))
        .select(*by, "cell.*")
        .filter("category is not null")
        .groupBy(*by, "feature", "category")
        .agg(F.count(F.lit(1)).alias(name))
    )


def _category_psi(
    reference_n: DataFrame,
    current_n: DataFrame,
    paired: DataFrame,
    by: list[str],
    reference_by: list[str],
) -> DataFrame:
    totals = paired.select(*by, "feature", "current_count")
    ref_totals = (
        paired.filter(~F.col("is_numeric"))
        .groupBy(*reference_by, "feature")
        .agg(F.max("reference_count").alias("reference_count"))
    )
    ref_shares = written(
        _join(reference_n, ref_totals, [*reference_by, "feature"]).select(
            *reference_by,
            "feature",
            "category",
            share(F.col("reference_n"), F.col("reference_count")).alias("p"),
        ),
        "drift-categories",
    )
    absent = divergence_terms(F.col("p"), F.lit(0.0))["psi"]
    alone = ref_shares.groupBy(*reference_by, "feature").agg(F.sum(absent).alias("alone"))
    seen = _join(current_n, totals, [*by, "feature"])
    matched = _join(seen, ref_shares, [*reference_by, "feature", "category"], "left")
    q = share(F.col("current_n"), F.col("current_count"))
    present = divergence_terms(F.coalesce(F.col("p"), F.lit(0.0)), q)["psi"]
    per_group = matched.groupBy(*by, "feature").agg(
        F.sum(present).alias("present"),
        F.coalesce(F.sum(F.when(F.col("p").isNotNull(), absent)), F.lit(0.0)).alias("replaced"),
    )
    groups = paired.filter(~F.col("is_numeric")).select(*by, "feature")
    joined = _join(
        _join(groups, per_group, [*by, "feature"], "left"), alone, [*reference_by, "feature"], "left"
    ).fillna(0.0, subset=["present", "replaced", "alone"])
    nothing = F.lit(None).cast("double")
    return joined.select(
        *by,
        "feature",
        (F.col("present") + F.col("alone") - F.col("replaced")).alias("psi"),
        nothing.alias("kl"),
        nothing.alias("js"),
    )


def shared_reference_drift(
    reference: DataFrame | None,
    current: DataFrame,
    numeric: list[str],
    categorical: list[str] | None = None,
    by: list[str] | None = None,
    reference_by: list[str] | None = None,
    bins: int = DRIFT_BINS,
    summary: ReferenceSummary | None = None,
    counted: bool = False,
) -> DataFrame:
    """Feature drift of every current group; ``reference_by`` (a part of ``by``) keys the references.

    A ``summary`` of the reference, made once, saves reading it again. With ``counted`` the current sample comes as
    counted cells instead of rows. Same columns and values as :func:`mlwatch.operators.drift.feature_drift`.
    """
    by, reference_by, categorical = by or [], reference_by or [], categorical or []
    if not counted and by == reference_by and summary is None:  # nothing is shared: every group has a reference of its own
        rows = sided(reference, current, [*by, *numeric, *categorical])
        return feature_drift(rows, numeric, categorical, by, bins).filter(
            "current_rows > 0" if by else "true"
        )
    summary = summary or summarise_reference(reference, numeric, categorical, reference_by)
    if counted:
        moments = cell_moments(current, numeric, categorical, by)
    else:
        moments = feature_moments(current.withColumn("side", F.lit(CURRENT)), numeric, categorical, by)
    paired = shared_reference_pairs(summary, moments, by, reference_by)
    sums = []
    if numeric:
        ref_n = reference_counts(summary.values, paired, by, reference_by, bins)
        cur_n = cell_counts(current, paired, by, bins) if counted else current_counts(current, paired, numeric, by, bins)
        keys = [*by, "feature"]
        # every bin of a usable range is listed on the reference side
        counts = _join(ref_n, cur_n, [*keys, "bin"], "left").fillna(0, subset=["current_n"])
        counts = _join(counts, paired.select(*keys, "reference_count", "current_count"), keys)
        terms = divergence_terms(
            share(F.col("reference_n"), F.col("reference_count")),
            share(F.col("current_n"), F.col("current_count")),
        )
        sums.append(
            counts.groupBy(*keys).agg(*[F.sum(term).alias(name) for name, term in terms.items()])
        )
    if categorical:
        if counted:
            found = current.filter("category is not null")
            cur_n = found.groupBy(*by, "feature", "category").agg(F.sum("n").alias("current_n"))
        else:
            cur_n = _category_counts(current, categorical, by, "current_n")
        sums.append(_category_psi(summary.categories, cur_n, paired, by, reference_by))
    total = sums[0] if len(sums) == 1 else sums[0].unionByName(sums[1])
    return drift_rows(paired, total, by)
