"""Row and column selection, region aggregation, and the stand-in COP columns."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridload.functions.calendar import PEAK_HOURS, SEASON_MONTHS
from gridload.functions.scalars import clip, numeric_columns
from gridload.operators.ordering import DEFAULT_LAYOUT, SeriesLayout
from gridload.operators.quantiles import COLUMN, VALUE, quantiles

log = logging.getLogger(__name__)

# fixed values: region codes of the pan-European total
REGION_CODES = (
    "AT", "BE", "BG", "CH", "CZ", "DE", "DK", "EE", "ES", "FI", "FR", "GB", "GR", "HR",
    "HU", "IE", "IT", "LT", "LU", "LV", "NL", "NO", "PL", "PT", "RO", "SE", "SI", "SK",
)
# fixed values: columns kept out of the default feature matrix
NOT_FEATURES = ("stress_hour", "high_demand", "low_cop", "demand_threshold", "cop_threshold")


def year_start(year: int) -> Column:
    return F.lit(f"{year:04d}-01-01 00:00:00").cast("timestamp_ntz")


def in_year_range(time: str, first: int, last: int) -> Column:
    """Inclusive year range as a half-open interval, so file scans can skip data."""
    ts = F.col(time)
    return (ts >= year_start(first)) & (ts < year_start(last + 1))


def keep_years(df: DataFrame, years: Iterable[int] | None, time: str = "ts") -> DataFrame:
    """Rows of the listed years; ``None`` keeps all. Consecutive years merge."""
    if years is None:
        return df
    runs: list[list[int]] = []
    for year in sorted(set(years)):
        if runs and year == runs[-1][1] + 1:
            runs[-1][1] = year
        else:
            runs.append([year, year])
    wanted = reduce(
        lambda a, b: a | b, (in_year_range(time, a, b) for a, b in runs), F.lit(False)
    )
    return df.filter(wanted)


def keep_year_range(df: DataFrame, first: int, last: int, time: str = "ts") -> DataFrame:
    return df.filter(in_year_range(time, first, last))


def keep_columns(df: DataFrame, codes: Sequence[str], always: Sequence[str] = ("ts",)) -> DataFrame:
    """Subset of region columns that exist; none of them: unchanged, with a warning."""
    found = [c for c in codes if c in df.columns]
    if not found:
        log.warning("none of the requested columns exist: %s", list(codes))
        return df
    return df.select(*[c for c in always if c in df.columns], *found)


def row_sum(columns: Sequence[str]) -> Column:
    """Sum across columns; missing cells count as nothing, an empty row is 0."""
    return reduce(
        lambda a, b: a + b, (F.coalesce(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0)
    )


def row_mean(columns: Sequence[str]) -> Column:
    """Mean of the present cells of a row; missing when none is present."""
    present = reduce(
        lambda a, b: a + b, (F.col(c).isNotNull().cast("int") for c in columns), F.lit(0)
    )
    return F.try_divide(row_sum(columns), present)


def add_region_total(df: DataFrame, codes: Sequence[str] = REGION_CODES) -> DataFrame:
    return df.withColumn(
        "heat_demand_total", row_sum([c for c in df.columns if c in set(codes)])
    )


def select_region(
    df: DataFrame, code: str | None = None, codes: Sequence[str] = REGION_CODES
) -> DataFrame:
    """One region's demand as ``heat_demand_total``, or the total over all regions.

    Rows where the chosen region is missing are dropped. An unknown code falls back
    to the total.
    """
    if code and code != "pan_european":
        if code in df.columns:
            return df.filter(F.col(code).isNotNull()).withColumnRenamed(code, "heat_demand_total")
        log.warning("region %s not found, using the total", code)
    return add_region_total(df, codes)


def find_columns(
    df: DataFrame,
    prefix: str | None = None,
    suffix: str | None = None,
    contains: str | None = None,
) -> list[str]:
    """Columns matching every given pattern; an error when there is none."""
    found = [
        c
        for c in df.columns
        if (prefix is None or c.startswith(prefix))
        and (suffix is None or c.endswith(suffix))
        and (contains is None or contains in c)
    ]
    if not found:
        raise ValueError(f"no column matches prefix={prefix} suffix={suffix} contains={contains}")
    return found


def extract_series(
    df: DataFrame, demand_prefix: str, cop_prefix: str, time: str = "ts"
) -> DataFrame:
    """(ts, heat_demand_total, cop_ashp_floor) of the first column of each pattern."""
    demand = find_columns(df, prefix=demand_prefix)[0]
    cop = find_columns(df, prefix=cop_prefix)[0]
    return df.select(
        F.col(time),
        F.col(demand).alias("heat_demand_total"),
        F.col(cop).alias("cop_ashp_floor"),
    ).dropna("any")


def to_long(
    df: DataFrame, columns: Sequence[str], time: str = "ts", value: str = "heat_demand_total"
) -> DataFrame:
    """Wide table to (series, ts, value)."""
    return df.unpivot(time, list(columns), "series", value).select("series", time, value)


def complete_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=list(columns) if columns else None)


def calendar_week(
    df: DataFrame,
    year: int,
    month: int,
    first_day: int,
    last_day: int,
    time: str = "ts",
    fallback_rows: int = 168,
    layout: SeriesLayout = DEFAULT_LAYOUT,
) -> DataFrame:
    """Rows of the given days; if there are none, the first winter rows.

    Works per series: a series without rows in the days gets its own first
    ``fallback_rows`` winter rows.
    """
    start = F.lit(f"{year:04d}-{month:02d}-{first_day:02d}").cast("timestamp_ntz")
    end = F.lit(f"{year:04d}-{month:02d}-{last_day:02d}").cast("timestamp_ntz") + F.expr(
        "INTERVAL 1 DAY"
    )
    in_week = (F.col(time) >= start) & (F.col(time) < end)
    week = df.filter(in_week)
    winter = winter_rows(df, time)
    if layout.keys:
        covered = week.select(*layout.keys).distinct()
        others = winter.join(covered, list(layout.keys), "left_anti")
    else:
        others = winter.filter(week.agg(F.count(F.lit(1))).scalar() == 0)
    return week.unionByName(first_rows(others, fallback_rows, layout))


def peak_hours(df: DataFrame, time: str = "ts") -> DataFrame:
    return df.filter(F.hour(time).between(min(PEAK_HOURS), max(PEAK_HOURS)))


def winter_rows(df: DataFrame, time: str = "ts") -> DataFrame:
    return df.filter(F.month(time).isin(*SEASON_MONTHS["winter"]))


def first_rows(df: DataFrame, rows: int = 168, layout: SeriesLayout = DEFAULT_LAYOUT) -> DataFrame:
    """First rows of every series in time order.

    The rank filter is applied before the shuffle as well, so each map task sends at
    most ``rows`` rows per series.
    """
    if not layout.keys:
        return df.orderBy(layout.time).limit(rows)
    order = Window.partitionBy(*layout.keys).orderBy(layout.time)
    ranked = df.withColumn("_rank", F.row_number().over(order))
    return ranked.filter(F.col("_rank") <= rows).drop("_rank")


def feature_columns(df: DataFrame, exclude: Sequence[str] = NOT_FEATURES) -> list[str]:
    return numeric_columns(df, exclude)


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row, one exact median per column (missing when a column has no value)."""
    cells = quantiles(df, [], columns, [0.5])
    return cells.agg(*[F.max(F.when(F.col(COLUMN) == c, F.col(VALUE))).alias(c) for c in columns])


def feature_matrix(
    df: DataFrame, columns: Sequence[str] | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Feature columns with missing cells set to the column median."""
    columns = list(columns) if columns else feature_columns(df)
    packed = medians(df, columns).select(F.struct("*").alias("m")).scalar()
    return df.select(*keep, *columns, packed.alias("_median")).select(
        *keep,
        *[F.coalesce(F.col(c).cast("double"), F.col(f"_median.{c}")).alias(c) for c in columns],
    )


def feature_vectors(
    df: DataFrame, columns: Sequence[str] | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Filled feature matrix as one vector column ``features``; stays distributed."""
    columns = list(columns) if columns else feature_columns(df)
    assembler = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="error")
    return assembler.transform(feature_matrix(df, columns, keep)).select(*keep, "features")


def target(df: DataFrame, column: str = "stress_hour", keep: Sequence[str] = ()) -> DataFrame:
    if column not in df.columns:
        raise ValueError(f"target column {column} not found")
    return df.select(*keep, column)


def target_summary(df: DataFrame, column: str = "stress_hour") -> DataFrame:
    return target(df, column).agg(
        F.sum(column).cast("bigint").alias("positives"), F.avg(column).alias("positive_rate")
    )


def add_proxy_cop(
    df: DataFrame,
    demand: str = "heat_demand_total",
    time: str = "ts",
    noise: float = 0.0,
    spread: float = 0.0,
    seed: int = 42,
) -> DataFrame:
    """Stand-in ``cop_average`` and ``cop_ashp`` from demand and the time of year.

    ``noise`` is the standard deviation added to the first column and ``spread`` the
    relative half-width of the second around it; both default to none, which keeps
    the result reproducible.
    """
    stats = df.agg(F.struct(F.avg(demand).alias("mean"), F.stddev_samp(demand).alias("sd")))
    z = F.try_divide(F.col(demand) - F.col("_stats.mean"), F.col("_stats.sd"))
    season = F.sin(2 * F.pi() * F.dayofyear(time) / 365) * 0.3
    cop = F.lit(3.5) + z * 0.2 + season
    if noise:
        cop = cop + F.randn(seed) * noise
    ashp = F.col("cop_average")
    if spread:
        ashp = ashp * (1 - spread + F.rand(seed + 1) * 2 * spread)
    return (
        df.withColumn("_stats", stats.scalar())
        .withColumn("cop_average", F.when(z.isNotNull(), clip(cop, 2.0, 5.0)))
        .withColumn("cop_ashp", F.when(F.col("cop_average").isNotNull(), clip(ashp, 2.0, 5.0)))
        .drop("_stats")
    )
