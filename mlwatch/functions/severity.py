"""Severity grades and alert texts for drift."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def psi_severity(psi: Column) -> Column:
    """Grade of one feature."""
    # Severity limits.
    return (
        F.when(psi < 0.1, "none").when(psi < 0.2, "low").when(psi < 0.25, "medium").otherwise("high")
    )


def alert_severity(max_psi: Column) -> Column:
    """Grade of a whole run; the lowest grade is ``low``."""
    return F.when(max_psi >= 0.25, "high").when(max_psi >= 0.2, "medium").otherwise("low")


def alert_message(drifted: Column, max_psi: Column, avg_psi: Column) -> Column:
    # Fixed value: the text of an alert, as its readers know it.
    return F.format_string(
        "Drift detected in %d features: %s. Max PSI: %.3f, Avg PSI: %.3f",
        F.size(drifted),
        F.array_join(drifted, ", "),
        max_psi,
        avg_psi,
    )
