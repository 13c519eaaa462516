"""Calendar columns and demand interactions (all plain column expressions)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values
SEASON_MONTHS = {
    "winter": (12, 1, 2),
    "spring": (3, 4, 5),
    "summer": (6, 7, 8),
    "autumn": (9, 10, 11),
}
PEAK_HOURS = (17, 18, 19, 20, 21)
CYCLES = {"hour": ("hour", 24), "day": ("day_of_week", 7), "month": ("month", 12)}


def flag(condition: Column) -> Column:
    """0/1 integer; an unknown condition counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def season_of(month: Column) -> Column:
    lookup = F.create_map(
        *chain.from_iterable(
            (F.lit(m), F.lit(season)) for season, months in SEASON_MONTHS.items() for m in months
        )
    )
    return lookup[month]


def in_season(season: str, month: Column) -> Column:
    return flag(month.isin(*SEASON_MONTHS[season]))


def add_calendar(df: DataFrame, time: str = "ts") -> DataFrame:
    """hour, day_of_week (Monday 0), day_of_year, month, year."""
    ts = F.col(time)
    return df.withColumns(
        {
            "hour": F.hour(ts),
            "day_of_week": F.weekday(ts),
            "day_of_year": F.dayofyear(ts),
            "month": F.month(ts),
            "year": F.year(ts),
        }
    )


def add_calendar_flags(df: DataFrame, seasons: tuple[str, ...] = tuple(SEASON_MONTHS)) -> DataFrame:
    """is_weekend and one 0/1 column per season; needs ``add_calendar`` columns."""
    flags = {"is_weekend": flag(F.col("day_of_week") >= 5)}
    for season in seasons:
        flags[f"is_{season}"] = in_season(season, F.col("month"))
    return df.withColumns(flags)


def add_cycles(df: DataFrame) -> DataFrame:
    """Sine and cosine of the position within day, week and year."""
    waves = {}
    for name, (source, period) in CYCLES.items():
        angle = 2 * F.pi() * F.col(source) / period
        waves[f"{name}_sin"] = F.sin(angle)
        waves[f"{name}_cos"] = F.cos(angle)
    return df.withColumns(waves)


def add_season(df: DataFrame, time: str = "ts") -> DataFrame:
    return df.withColumn("season", season_of(F.month(time)))


def add_interactions(
    df: DataFrame, demand: str = "heat_demand_total", cop: str = "cop_average"
) -> DataFrame:
    """Ratio and product of demand and COP, seasonal demand, peak-hour demand.

    A zero COP gives a null ratio. Groups whose inputs are absent are left out.
    """
    have = set(df.columns)
    added: dict[str, Column] = {}
    if {demand, cop} <= have:
        added["demand_cop_ratio"] = F.try_divide(F.col(demand), F.col(cop))
        added["demand_cop_product"] = F.col(demand) * F.col(cop)
    if {demand, "is_winter", "is_summer"} <= have:
        added["winter_demand"] = F.col(demand) * F.col("is_winter")
        added["summer_demand"] = F.col(demand) * F.col("is_summer")
    if {demand, "hour"} <= have:
        peak = flag(F.col("hour").isin(*PEAK_HOURS))
        added["is_peak_hour"] = peak
        added["peak_demand"] = F.col(demand) * peak
    return df.withColumns(added) if added else df
