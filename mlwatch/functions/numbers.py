"""Number handling shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def not_nan(value: Column | str) -> Column:
    """Double value with NaN turned into null, so that range checks behave; infinity is out of any range."""
    column = F.col(value) if isinstance(value, str) else value
    return F.nanvl(column.cast("double"), F.lit(None).cast("double"))


def number(value: Column | str) -> Column:
    """Double value if it is finite, else null: one infinite value would void a range, its bins and moments."""
    column = (F.col(value) if isinstance(value, str) else value).cast("double")
    return F.when(F.abs(column) < float("inf"), column)


def is_odd(value: Column | str) -> Column:
    """There is a value, but no finite number."""
    column = F.col(value) if isinstance(value, str) else value
    return column.isNotNull() & number(column).isNull()


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double; 0 when the whole is 0."""
    return F.coalesce(part / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))


def null_safe(left: list[Column], right: list[Column]) -> list[Column]:
    """Equi-join conditions under which null keys match each other."""
    return [a.eqNullSafe(b) for a, b in zip(left, right)]
