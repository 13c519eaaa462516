"""Number parsing, scaling by range or maximum, and report formatting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean(value: Column) -> Column:
    """NaN to null, so comparisons and aggregates treat it as missing."""
    return F.when(~F.isnan(value), value)


def parse_number(text: str | Column) -> Column:
    """Decimal-comma (or point) text to double; anything else becomes null."""
    column = F.col(text) if isinstance(text, str) else text
    return clean(F.replace(column, F.lit(","), F.lit(".")).try_cast("double"))


def parse_time(text: str | Column) -> Column:
    """Timestamp text, read as UTC wall clock."""
    column = F.col(text) if isinstance(text, str) else text
    return column.try_cast("timestamp").cast("timestamp_ntz")


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(value, F.lit(float(high))), F.lit(float(low)))


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def normalise_range(df: DataFrame, columns: dict[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """Min-max scale ``{output: input}`` over each group; a zero range gives null.

    Bounds come from an aggregate with one row per group, joined back on the keys.
    """
    bounds = df.groupBy(*keys).agg(
        *[F.min(c).alias(f"_min_{o}") for o, c in columns.items()],
        *[F.max(c).alias(f"_max_{o}") for o, c in columns.items()],
    )
    if keys:
        joined = df.join(bounds, list(keys), "left")
    else:
        packed = bounds.select(F.struct("*").alias("_bounds")).scalar()
        joined = df.withColumn("_bounds", packed).select("*", "_bounds.*").drop("_bounds")
    scaled = {
        o: F.try_divide(
            F.col(c) - F.col(f"_min_{o}"), F.col(f"_max_{o}") - F.col(f"_min_{o}")
        )
        for o, c in columns.items()
    }
    return joined.withColumns(scaled).select(*df.columns, *columns)


def divide_by_maximum(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Divide by the column maximum; meant for report tables of a few rows."""
    peak = df.agg(F.struct(*[F.max(c).alias(o) for o, c in columns.items()]).alias("m")).scalar()
    return (
        df.withColumn("_peak", peak)
        .withColumns({o: F.try_divide(F.col(c), F.col(f"_peak.{o}")) for o, c in columns.items()})
        .drop("_peak")
    )


def fixed(value: str | Column, digits: int, suffix: str = "") -> Column:
    """Text with a fixed number of decimals, ties going to the even digit."""
    column = F.col(value) if isinstance(value, str) else value
    even = F.bround(column.cast("double"), digits)
    return F.format_string(f"%.{digits}f{suffix.replace('%', '%%')}", even)


def title_case(text: Column) -> Column:
    return F.initcap(text)


def code_prefix(name: Column) -> Column:
    """Text before the first underscore when it is all upper case, else null."""
    head = F.split(name, "_")[0]
    return F.when(F.contains(name, F.lit("_")) & head.rlike("^[A-Z]+$"), head)


def codes_in(df: DataFrame, name: str = "name") -> DataFrame:
    """Distinct, sorted region codes found in a column of quantity names."""
    return (
        df.select(code_prefix(F.col(name)).alias("code"))
        .filter(F.col("code").isNotNull())
        .distinct()
        .orderBy("code")
    )


