"""Stress-hour labels (high demand while efficiency is low) and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridload.functions.calendar import add_season, flag
from gridload.functions.scalars import normalise_range
from gridload.operators.ordering import (
    DEFAULT_LAYOUT,
    SeriesLayout,
    Stage,
    TrailingQuantiles,
    with_series_windows,
)
from gridload.operators.quantiles import quantile_columns

DEMAND, COP = "heat_demand_total", "cop_average"


def rolling_thresholds(
    demand: str = DEMAND,
    cop: str = COP,
    demand_percentile: float = 90,
    cop_percentile: float = 10,
    window: int = 168,
    prefix: str = "",
) -> TrailingQuantiles:
    return TrailingQuantiles(
        {
            f"{prefix}demand_threshold": (demand, demand_percentile / 100, window),
            f"{prefix}cop_threshold": (cop, cop_percentile / 100, window),
        }
    )


def dynamic_flags(demand: str = DEMAND, cop: str = COP) -> dict[str, Column]:
    """Flags against the rolling thresholds; limits themselves count as stress."""
    high = F.col(demand) >= F.col("demand_threshold")
    low = F.col(cop) <= F.col("cop_threshold")
    return {"stress_hour": flag(high & low), "high_demand": flag(high), "low_cop": flag(low)}


def dynamic_stages(
    demand: str = DEMAND,
    cop: str = COP,
    demand_percentile: float = 90,
    cop_percentile: float = 10,
    window: int = 168,
) -> list[Stage]:
    """The two steps of the rolling label, for use inside a longer window pass."""
    return [
        rolling_thresholds(demand, cop, demand_percentile, cop_percentile, window),
        lambda win: dynamic_flags(demand, cop),
    ]


def label_dynamic(
    df: DataFrame,
    demand: str = DEMAND,
    cop: str = COP,
    demand_percentile: float = 90,
    cop_percentile: float = 10,
    window: int = 168,
    layout: SeriesLayout = DEFAULT_LAYOUT,
) -> DataFrame:
    """Label rows against trailing quantiles of their own series.

    Rows before the first full window are 0. Without both columns every row is 0.
    """
    if not {demand, cop} <= set(df.columns):
        return df.withColumn("stress_hour", F.lit(0))
    stages = dynamic_stages(demand, cop, demand_percentile, cop_percentile, window)
    return with_series_windows(df, window - 1, stages, layout)


def seasonal_thresholds(
    df: DataFrame,
    keys: Sequence[str] = ("series",),
    demand: str = DEMAND,
    cop: str = COP,
    demand_prob: float = 0.9,
    cop_prob: float = 0.2,
) -> DataFrame:
    """(keys, season, demand_p90, cop_p20): exact quantiles per season."""
    return quantile_columns(
        add_season(df),
        [*keys, "season"],
        {"demand_p90": (demand, demand_prob), "cop_p20": (cop, cop_prob)},
    )


def label_seasonal(
    df: DataFrame,
    thresholds: DataFrame | None = None,
    keys: Sequence[str] = ("series",),
    demand: str = DEMAND,
    cop: str = COP,
) -> DataFrame:
    """Label rows strictly beyond their season's thresholds.

    Pass ``thresholds`` fitted on training rows to label other rows. The lookup
    table has four rows per series; Spark picks broadcast or shuffle by its size.
    """
    if thresholds is None:
        thresholds = seasonal_thresholds(df, keys, demand, cop)
    stressed = (F.col(demand) > F.col("demand_p90")) & (F.col(cop) < F.col("cop_p20"))
    return add_season(df).join(thresholds, [*keys, "season"], "left").withColumn(
        "stress_hour", flag(stressed)
    )


def label_selection(
    df: DataFrame,
    demand: str = DEMAND,
    cop: str = COP,
    demand_prob: float = 0.9,
    cop_prob: float = 0.2,
) -> DataFrame:
    """Label rows strictly beyond the quantiles of the selection itself."""
    limits = quantile_columns(
        df, [], {"demand_p90": (demand, demand_prob), "cop_p20": (cop, cop_prob)}
    )
    stressed = (F.col(demand) > F.col("demand_p90")) & (F.col(cop) < F.col("cop_p20"))
    packed = limits.select(F.struct("demand_p90", "cop_p20").alias("limits")).scalar()
    return (
        df.withColumn("_limits", packed)
        .select("*", "_limits.demand_p90", "_limits.cop_p20")
        .withColumn("stress_hour", flag(stressed))
        .drop("_limits")
    )


def stress_rate(df: DataFrame, keys: Sequence[str] = (), label: str = "stress_hour") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.sum(label).cast("bigint").alias("stress_hours"), F.avg(label).alias("stress_rate")
    )


def selection_summary(
    df: DataFrame,
    keys: Sequence[str] = (),
    demand: str = DEMAND,
    cop: str = COP,
    label: str = "stress_hour",
) -> DataFrame:
    """Hours, stress hours and rate, mean and peak demand, mean COP."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_hours"),
        F.sum(label).cast("bigint").alias("stress_hours"),
        F.avg(label).alias("stress_rate"),
        F.avg(demand).alias("avg_demand"),
        F.avg(cop).alias("avg_cop"),
        F.max(demand).alias("peak_demand"),
    )


def stress_matrix(
    df: DataFrame,
    keys: Sequence[str] = (),
    first_day: int = 15,
    label: str = "stress_hour",
    time: str = "ts",
) -> DataFrame:
    """Day x hour grid of 0/1 stress marks: columns ``h00`` to ``h23``.

    Days are numbered 0..6 from ``first_day`` of the month, wrapping each week.
    """
    day = F.pmod(F.dayofmonth(time) - F.lit(first_day), F.lit(7)).cast("int").alias("day")
    marked = df.select(*keys, day, F.hour(time).alias("hour"), F.col(label).alias("mark"))
    return marked.groupBy(*keys, "day").agg(
        *[
            F.max(F.when((F.col("hour") == h) & (F.col("mark") != 0), 1).otherwise(0)).alias(
                f"h{h:02d}"
            )
            for h in range(24)
        ]
    )


def efficiency_zones(
    df: DataFrame,
    keys: Sequence[str] = (),
    demand: str = DEMAND,
    cop: str = COP,
    low_cop_line: float = 0.3,
    high_demand_line: float = 0.7,
) -> DataFrame:
    """Min-max position of each row and on which side of the zone lines it lies."""
    scaled = normalise_range(df, {"demand_norm": demand, "cop_norm": cop}, keys)
    return scaled.withColumns(
        {
            "low_efficiency": flag(F.col("cop_norm") < low_cop_line),
            "high_demand_zone": flag(F.col("demand_norm") > high_demand_line),
        }
    )
