"""Common parts of the fitted preprocessing steps."""

from __future__ import annotations

import json

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridload.functions.scalars import numeric_columns
from gridload.operators.quantiles import COLUMN, PROB, VALUE, quantiles

# fixed values: columns no scaler touches
NOT_SCALED = (
    "stress_hour", "high_demand", "low_cop", "demand_threshold", "cop_threshold",
    "hour", "day_of_week", "day_of_year", "month", "year",
    "is_weekend", "is_winter", "is_summer",
    "heat_demand_total", "cop_average", "cop_ashp",
)
# fixed values: labels no outlier detector looks at
NOT_OUTLIER_FEATURES = ("stress_hour", "high_demand", "low_cop")


class Step(Estimator):
    """An estimator whose settings are plain attributes."""

    def _fit(self, df: DataFrame) -> Fitted:
        raise NotImplementedError


class Fitted(Model):
    """A fitted step; ``state`` holds what it learned, small enough for JSON."""

    def __init__(self, state: dict):
        super().__init__()
        self.state = state

    def save(self, spark: SparkSession, path: str) -> None:
        row = spark.range(1).select(
            F.lit(type(self).__name__).alias("kind"), F.lit(json.dumps(self.state)).alias("state")
        )
        row.write.mode("overwrite").json(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Fitted:
        row = spark.read.schema("kind string, state string").json(path).first()
        if row is None or row["kind"] != cls.__name__:
            raise ValueError(f"{path} does not hold a {cls.__name__}")
        return cls(json.loads(row["state"]))


def chosen(df: DataFrame, columns, exclude=()) -> list[str]:
    return list(columns) if columns else numeric_columns(df, exclude)


def column_stats(df: DataFrame, columns: list[str]) -> dict[str, dict[str, float | None]]:
    """Mean, population deviation, min and max per column: one row to the driver."""
    clean = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    row = df.agg(
        *[fn(v).alias(f"{c}|{name}") for c, v in clean.items() for name, fn in _MOMENTS.items()]
    ).first()
    return {c: {name: row[f"{c}|{name}"] for name in _MOMENTS} for c in columns}


_MOMENTS = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}


def column_quantiles(
    df: DataFrame, columns: list[str], probs: list[float]
) -> dict[str, dict[float, float]]:
    """Exact quantiles per column: columns x probs numbers to the driver."""
    found: dict[str, dict[float, float]] = {c: {} for c in columns}
    for row in quantiles(df, [], columns, probs).collect():
        found[row[COLUMN]][row[PROB]] = row[VALUE]
    return found
