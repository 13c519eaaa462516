"""Descriptive profiles: completeness, missing cells, ranges, describe tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridload.functions.scalars import fixed, numeric_columns
from gridload.operators.quantiles import COLUMN, VALUE, melt, quantile_columns


def class_distribution(df: DataFrame, label: str = "y_true", keys: Sequence[str] = ()) -> DataFrame:
    """Count and percentage per class; imbalance figures only for two classes."""
    counts = (
        df.filter(F.col(label).isNotNull())
        .groupBy(*keys, F.col(label).cast("int").alias("class"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    totals = counts.groupBy(*keys).agg(
        F.sum("count").alias("_total"),
        F.count(F.lit(1)).alias("_classes"),
        F.min("count").alias("_minority"),
        F.max("count").alias("_majority"),
    )
    if keys:
        joined = counts.join(totals, list(keys))
    else:
        joined = counts.withColumn("_t", totals.select(F.struct("*")).scalar()).select(
            "*", "_t.*"
        )
    two = F.col("_classes") == 2
    return joined.select(
        *keys,
        "class",
        "count",
        (F.col("count") / F.col("_total") * 100).alias("percentage"),
        F.when(two, F.col("_majority") / F.col("_minority")).alias("imbalance_ratio"),
        F.when(two, F.col("_minority") / F.col("_total")).alias("minority_class_rate"),
    )


def yearly_completeness(
    df: DataFrame, keys: Sequence[str] = (), time: str = "ts"
) -> DataFrame:
    """Rows per year against the hours of that year (8784 when divisible by 4)."""
    expected = F.when(F.col("year") % 4 == 0, 8784).otherwise(8760)
    return (
        df.groupBy(*keys, F.year(time).alias("year"))
        .agg(F.count(F.lit(1)).alias("hours"))
        .withColumn("expected", expected)
        .withColumn("completeness", F.col("hours") / F.col("expected") * 100)
    )


def _missing(value: Column) -> Column:
    return F.count_if(value.isNull() | F.isnan(value))


def per_column(
    df: DataFrame, columns: Sequence[str], stats: dict[str, Callable[[Column], Column]]
) -> DataFrame:
    """One row per column with the given statistics of its values as doubles.

    All of them come from a single wide aggregate; only its one row is unpivoted.
    """
    named = []
    for i, c in enumerate(columns):
        value = F.col(c).cast("double")
        parts = [fn(value).alias(name) for name, fn in stats.items()]
        named.append(F.struct(F.lit(c).alias(COLUMN), *parts).alias(f"_{i}"))
    wide = df.agg(*named)
    return wide.select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(columns))])))


def demand_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cells, missing cells and share, range, negative cells over region columns."""
    each = per_column(
        df,
        columns,
        {
            "cells": lambda v: F.count(F.lit(1)),
            "missing": _missing,
            "low": F.min,
            "high": F.max,
            "negative": lambda v: F.count_if(v < 0),
        },
    )
    return each.agg(
        F.sum("cells").alias("cells"),
        F.sum("missing").alias("missing"),
        F.min("low").alias("min_value"),
        F.max("high").alias("max_value"),
        F.sum("negative").alias("negative"),
    ).withColumn("missing_pct", F.try_divide(F.col("missing"), F.col("cells")) * 100)


def missing_by_column(df: DataFrame, columns: Sequence[str], top: int = 10) -> DataFrame:
    """Columns with most missing cells; equal counts in name order."""
    return (
        per_column(df, columns, {"missing": _missing})
        .withColumnRenamed(COLUMN, "series")
        .orderBy(F.desc("missing"), "series")
        .limit(top)
    )


def _quantiles_of(df: DataFrame, columns: Sequence[str], wanted: dict[str, float]) -> DataFrame:
    cells = melt(df, [], columns).withColumnRenamed(COLUMN, "name")
    found = quantile_columns(cells, ["name"], {k: (VALUE, p) for k, p in wanted.items()})
    return found.withColumnRenamed("name", COLUMN)


def cop_profile(
    df: DataFrame, columns: Sequence[str], low: float = 1.0, high: float = 6.0
) -> DataFrame:
    """Missing cells, range, implausible cells; mean of means, median of medians,
    mean of standard deviations over the region columns."""
    each = per_column(
        df,
        columns,
        {
            "missing": _missing,
            "low": F.min,
            "high": F.max,
            "unrealistic": lambda v: F.count_if((v < low) | (v > high)),
            "mean": F.avg,
            "std": F.stddev_samp,
        },
    ).join(_quantiles_of(df, columns, {"median": 0.5}), COLUMN, "left")
    # one row per column from here on, so the built-in exact quantile is bounded
    return each.agg(
        F.sum("missing").alias("missing"),
        F.min("low").alias("min_value"),
        F.max("high").alias("max_value"),
        F.sum("unrealistic").alias("unrealistic"),
        F.avg("mean").alias("mean_of_means"),
        F.percentile("median", 0.5).alias("median_of_medians"),
        F.avg("std").alias("mean_of_stds"),
    )


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, min, exact quartiles and max of each numeric column."""
    columns = list(columns) if columns else numeric_columns(df)

    def known(fn: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda v: fn(F.when(~F.isnan(v), v))

    stats = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    each = per_column(df, columns, {name: known(fn) for name, fn in stats.items()})
    quartiles = _quantiles_of(df, columns, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return each.join(quartiles, COLUMN, "left").select(
        COLUMN, "count", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def table_info(df: DataFrame, time: str = "ts") -> DataFrame:
    """One row: shape, numeric columns, first and last time."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.lit(len(numeric_columns(df))).alias("numeric_columns"),
        F.min(time).alias("start"),
        F.max(time).alias("end"),
    )


def type_counts(df: DataFrame) -> DataFrame:
    """Columns per data type. Reads only the schema and one empty aggregate."""
    names = F.array(*[F.lit(f.dataType.simpleString()) for f in df.schema.fields])
    return (
        df.agg(F.count(F.lit(1)).alias("rows"))
        .select(F.explode(names).alias("dtype"), "rows")
        .groupBy("dtype", "rows")
        .agg(F.count(F.lit(1)).alias("columns"))
    )


# fixed values: labels of the dataset report, and the metadata field behind each
CHARACTERISTICS = (
    ("Country", "country"),
    ("Time Period", "years"),
    ("Number of Winters", "winters"),
    ("Number of Features", "num_features"),
    ("Stress Rate (%)", None),
    ("Evaluation Method", "evaluation_method"),
    ("Imbalanced Data Handling", "imbalanced_data_handling"),
    ("Analysis Type", "analysis_type"),
    ("Data Source", "data_source"),
)


def dataset_characteristics(
    df: DataFrame, metadata: dict[str, object], label: str = "stress_hour"
) -> DataFrame:
    """(characteristic, value) report rows; the stress rate comes from the data."""
    rate = fixed(F.coalesce(F.avg(label), F.lit(0.0)) * 100, 2, "%")
    values = {
        name: rate if field is None else F.lit(str(metadata.get(field, "N/A")))
        for name, field in CHARACTERISTICS
    }
    return df.agg(*[v.alias(f"_{i}") for i, v in enumerate(values.values())]).select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(n).alias("characteristic"), F.col(f"_{i}").alias("value"))
                    for i, n in enumerate(values)
                ]
            )
        ).alias("row")
    ).select("row.*")
