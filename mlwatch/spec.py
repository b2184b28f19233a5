"""Feature specification: which columns a model uses and what values they may hold."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Rule:
    """Constraint on one column. ``kind`` is ``int``, ``float`` or ``str``."""

    column: str
    kind: str
    nullable: bool = False
    minimum: float | None = None
    maximum: float | None = None
    allowed: tuple = ()


@dataclass(frozen=True)
class FeatureSpec:
    """Column roles, their rules, and the split used when watching for drift."""

    numeric: tuple[str, ...]
    binary: tuple[str, ...]
    categorical: tuple[str, ...]
    target: str
    rules: tuple[Rule, ...]
    drift_numeric: tuple[str, ...] = ()
    drift_categorical: tuple[str, ...] = ()

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.binary, *self.categorical]

    @property
    def columns(self) -> list[str]:
        return [*self.features, self.target]

    def rules_for(self, include_target: bool = True) -> list[Rule]:
        return [r for r in self.rules if include_target or r.column != self.target]

    def allowing(self, values: dict[str, tuple]) -> FeatureSpec:
        """The same spec with other category sets for the named columns."""
        return replace(
            self,
            rules=tuple(
                replace(r, allowed=tuple(values[r.column])) if r.column in values else r
                for r in self.rules
            ),
        )

    def common_features(self, *columns: list[str]) -> tuple[list[str], list[str], list[str]]:
        """Watched (numeric, categorical) features found in every column list, and the skipped names."""
        shared = set.intersection(*(set(c) for c in columns))
        watched = [*self.drift_numeric, *self.drift_categorical]
        return (
            [f for f in self.drift_numeric if f in shared],
            [f for f in self.drift_categorical if f in shared],
            [f for f in watched if f not in shared],
        )

    def as_frame(self, spark: SparkSession) -> DataFrame:
        """The column-role registry as rows (position, column, role)."""
        roles = [
            *((c, "numeric") for c in self.numeric),
            *((c, "binary") for c in self.binary),
            *((c, "categorical") for c in self.categorical),
            (self.target, "target"),
        ]
        return spark.createDataFrame(
            [(i, c, role) for i, (c, role) in enumerate(roles)],
            "position int, column string, role string",
        )


# Column roles, ranges and category sets of the taxi-fare model.
BOROUGHS = ("Manhattan", "Brooklyn", "Queens", "Bronx", "Staten Island", "EWR")

TRIP_SPEC = FeatureSpec(
    numeric=(
        "trip_distance",
        "passenger_count",
        "pickup_hour",
        "pickup_day_of_week",
        "pickup_month",
        "trip_duration_minutes",
    ),
    binary=("is_weekend", "is_rush_hour"),
    categorical=("RatecodeID", "payment_type", "pickup_borough", "dropoff_borough"),
    target="fare_amount",
    rules=(
        Rule("trip_distance", "float", minimum=0.1, maximum=100.0),
        Rule("passenger_count", "int", minimum=1, maximum=6),
        Rule("pickup_hour", "int", minimum=0, maximum=23),
        Rule("pickup_day_of_week", "int", minimum=1, maximum=7),
        Rule("pickup_month", "int", minimum=1, maximum=12),
        Rule("trip_duration_minutes", "float", minimum=1.0, maximum=180.0),
        Rule("is_weekend", "int", minimum=0, maximum=1),
        Rule("is_rush_hour", "int", minimum=0, maximum=1),
        Rule("RatecodeID", "int", minimum=1, maximum=6),
        Rule("payment_type", "int", minimum=1, maximum=4),
        Rule("pickup_borough", "str", allowed=BOROUGHS),
        Rule("dropoff_borough", "str", allowed=BOROUGHS),
        Rule("fare_amount", "float", minimum=2.5, maximum=200.0),
    ),
    drift_numeric=(
        "trip_distance",
        "trip_duration_minutes",
        "passenger_count",
        "pickup_hour",
        "pickup_day_of_week",
        "is_weekend",
        "is_rush_hour",
    ),
    drift_categorical=("pickup_borough", "dropoff_borough", "RatecodeID", "payment_type"),
)

# Drift, promotion and window defaults.
PSI_THRESHOLD = 0.2
PREDICTION_PSI_THRESHOLD = 0.15
MIN_DRIFT_FEATURES = 3
MIN_SAMPLES = 100
DRIFT_BINS = 20
EPSILON = 1e-6
WINDOW_HOURS = 24
MIN_RMSE_GAIN = 0.5
MAX_LATENCY_RATIO = 1.2
MIN_TABLE_ROWS = 100

# Upper bounds of the latency histograms, in seconds.
REQUEST_LATENCY_BOUNDS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)
PREDICTION_LATENCY_BOUNDS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)
