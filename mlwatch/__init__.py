"""mlwatch: Spark jobs that watch the data around a predictive model."""

from mlwatch.spec import FeatureSpec, Rule, TRIP_SPEC

__all__ = ["FeatureSpec", "Rule", "TRIP_SPEC"]
