"""Trailing-window statistics and lags over rows of a series.

Windows count rows, not hours: gaps in time are not filled. "Full" windows yield a
value only once ``rows`` non-missing values are in the frame; "partial" windows use
whatever is there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridload.operators.ordering import (
    DEFAULT_LAYOUT,
    SeriesLayout,
    SeriesWindows,
    TrailingQuantiles,
    with_series_windows,
)

# fixed values
ROLLING_ROWS = (24, 168)
LAG_ROWS = (1, 24)
ROLLING_TAILS = {"p90": 0.9, "p10": 0.1}

_STATS = {"mean": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min}


def full_frame(value: Column, column: str, win: SeriesWindows, rows: int) -> Column:
    """``value`` only where the trailing frame holds ``rows`` non-missing values."""
    return F.when(F.count(column).over(win.trailing(rows)) == rows, value)


def rolling_stat(column: str, stat: str, rows: int, win: SeriesWindows) -> Column:
    return full_frame(_STATS[stat](column).over(win.trailing(rows)), column, win, rows)


def partial_stat(column: str, stat: str, rows: int, win: SeriesWindows) -> Column:
    return _STATS[stat](column).over(win.trailing(rows))


def lag(column: str, rows: int, win: SeriesWindows) -> Column:
    return F.lag(column, rows).over(win.ordered())


def _present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def rolling_columns(
    columns: Sequence[str], windows: Sequence[int], win: SeriesWindows
) -> dict[str, Column]:
    built: dict[str, Column] = {}
    for column in columns:
        for rows in windows:
            for stat in ("mean", "std", "max", "min"):
                built[f"{column}_rolling_{stat}_{rows}h"] = rolling_stat(column, stat, rows, win)
    return built


def rolling_tails(columns: Sequence[str], windows: Sequence[int]) -> TrailingQuantiles:
    return TrailingQuantiles(
        {
            f"{column}_rolling_{tail}_{rows}h": (column, prob, rows)
            for column in columns
            for rows in windows
            for tail, prob in ROLLING_TAILS.items()
        }
    )


def lag_columns(columns: Sequence[str], lags: Sequence[int], win: SeriesWindows) -> dict[str, Column]:
    return {f"{c}_lag_{n}h": lag(c, n, win) for c in columns for n in lags}


def add_rolling(
    df: DataFrame,
    columns: Sequence[str] = ("heat_demand_total", "cop_average"),
    windows: Sequence[int] = ROLLING_ROWS,
    layout: SeriesLayout = DEFAULT_LAYOUT,
) -> DataFrame:
    """Rolling mean, std, max, min, p90 and p10; absent columns are skipped."""
    columns = _present(df, columns)
    stages = [
        lambda win: rolling_columns(columns, windows, win),
        rolling_tails(columns, windows),
    ]
    return with_series_windows(df, max(windows) - 1, stages, layout)


def add_lags(
    df: DataFrame,
    columns: Sequence[str] = ("heat_demand_total", "cop_average"),
    lags: Sequence[int] = LAG_ROWS,
    layout: SeriesLayout = DEFAULT_LAYOUT,
) -> DataFrame:
    columns = _present(df, columns)
    return with_series_windows(df, max(lags), lambda win: lag_columns(columns, lags, win), layout)


def summary_columns(
    demand: str | None, cop: str | None, win: SeriesWindows
) -> dict[str, Column]:
    """The fixed 24-row summary and lag set of the preprocessing step."""
    built: dict[str, Column] = {}
    if demand:
        for stat in ("mean", "std", "max"):
            built[f"demand_rolling_{stat}_24h"] = rolling_stat(demand, stat, 24, win)
    if cop:
        for stat in ("mean", "min"):
            built[f"cop_rolling_{stat}_24h"] = rolling_stat(cop, stat, 24, win)
    for label, column in (("demand", demand), ("cop", cop)):
        if column:
            for n in LAG_ROWS:
                built[f"{label}_lag_{n}h"] = lag(column, n, win)
    return built


def add_summary(
    df: DataFrame,
    demand: str = "heat_demand_total",
    cop: str = "cop_average",
    layout: SeriesLayout = DEFAULT_LAYOUT,
) -> DataFrame:
    have = df.columns
    return with_series_windows(
        df,
        max(LAG_ROWS),
        lambda win: summary_columns(
            demand if demand in have else None, cop if cop in have else None, win
        ),
        layout,
    )


def partial_columns(
    demand: str, cop: str, windows: Sequence[int], win: SeriesWindows
) -> dict[str, Column]:
    built: dict[str, Column] = {}
    for rows in windows:
        built[f"demand_ma_{rows}"] = partial_stat(demand, "mean", rows, win)
        built[f"demand_max_{rows}"] = partial_stat(demand, "max", rows, win)
        built[f"cop_min_{rows}"] = partial_stat(cop, "min", rows, win)
    return built


def add_partial_rolling(
    df: DataFrame,
    demand: str = "heat_demand_total",
    cop: str = "cop_average",
    windows: Sequence[int] = (24, 72, 168),
    layout: SeriesLayout = DEFAULT_LAYOUT,
) -> DataFrame:
    """Moving mean and maximum of demand, minimum of COP, on partial frames."""
    return with_series_windows(
        df, max(windows) - 1, lambda win: partial_columns(demand, cop, windows, win), layout
    )


def label_lag_columns(label: str, lags: Sequence[int], win: SeriesWindows) -> dict[str, Column]:
    """Earlier labels; where there is none, 0."""
    return {f"stress_lag_{n}": F.coalesce(lag(label, n, win), F.lit(0)) for n in lags}


def add_label_lags(
    df: DataFrame,
    label: str = "stress_hour",
    lags: Sequence[int] = LAG_ROWS,
    layout: SeriesLayout = DEFAULT_LAYOUT,
) -> DataFrame:
    return with_series_windows(
        df, max(lags), lambda win: label_lag_columns(label, lags, win), layout
    )
