"""Composed preprocessing: calendar, rolling features, labels, cleaning, scaling."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridload.functions.calendar import (
    add_calendar,
    add_calendar_flags,
    add_cycles,
    add_interactions,
    in_season,
)
from gridload.operators.checks import guard_processed
from gridload.operators.ordering import (
    DEFAULT_LAYOUT,
    SeriesLayout,
    SeriesWindows,
    with_series_windows,
)
from gridload.operators.rolling import (
    LAG_ROWS,
    ROLLING_ROWS,
    label_lag_columns,
    lag_columns,
    partial_columns,
    rolling_columns,
    rolling_tails,
    summary_columns,
)
from gridload.operators.stress import COP, DEMAND, dynamic_stages, label_seasonal
from gridload.prep.base import NOT_SCALED, Fitted
from gridload.prep.isolation import IsolationForest
from gridload.prep.steps import FillNeighbours, FillStatistic, Scale
from gridload.session import durable

log = logging.getLogger(__name__)

# fixed values: feature columns of the year-split analysis
ANALYSIS_FEATURES = (
    "hour", "weekday", "month", "is_winter",
    "demand_ma_24", "demand_ma_168", "demand_max_24", "demand_max_168",
    "cop_min_24", "cop_min_168", "stress_lag_1", "stress_lag_24",
)


def label_and_summarise(
    df: DataFrame,
    layout: SeriesLayout = DEFAULT_LAYOUT,
    window: int = 168,
    demand: str = DEMAND,
    cop: str = COP,
) -> DataFrame:
    """Calendar columns, 24-row summaries and lags, rolling stress label: one pass."""
    dated = add_calendar_flags(add_calendar(df, layout.time), ("winter", "summer"))
    have = set(df.columns)

    def summaries(win: SeriesWindows) -> dict[str, Column]:
        return summary_columns(
            demand if demand in have else None, cop if cop in have else None, win
        )

    if not {demand, cop} <= have:
        return with_series_windows(dated, max(LAG_ROWS), summaries, layout).withColumn(
            "stress_hour", F.lit(0)
        )
    stages = [summaries, *dynamic_stages(demand, cop, window=window)]
    return with_series_windows(dated, max(max(LAG_ROWS), window - 1), stages, layout)


def engineer(
    df: DataFrame,
    columns: Sequence[str] = (DEMAND, COP),
    windows: Sequence[int] = ROLLING_ROWS,
    lags: Sequence[int] = LAG_ROWS,
    layout: SeriesLayout = DEFAULT_LAYOUT,
) -> DataFrame:
    """Calendar, cyclic, rolling, lag and interaction features: one window pass."""
    dated = add_cycles(add_calendar_flags(add_calendar(df, layout.time)))
    present = [c for c in columns if c in df.columns]

    def moving(win: SeriesWindows) -> dict[str, Column]:
        return {**rolling_columns(present, windows, win), **lag_columns(present, lags, win)}

    look_back = max(max(windows) - 1, max(lags))
    stages = [moving, rolling_tails(present, windows)]
    return add_interactions(with_series_windows(dated, look_back, stages, layout))


def feature_info(
    features: Sequence[str],
    windows: Sequence[int] = ROLLING_ROWS,
    lags: Sequence[int] = LAG_ROWS,
) -> dict[str, object]:
    """Description stored beside a processed table."""
    # fixed values: layout and category names of the sidecar file
    return {
        "total_features": len(features),
        "feature_names": list(features),
        "rolling_windows": list(windows),
        "lag_periods": list(lags),
        "feature_categories": {
            "time_features": ["hour", "day_of_week", "month", "is_weekend", "is_winter"],
            "rolling_features": [f"*_rolling_*_{n}h" for n in windows],
            "lag_features": [f"*_lag_{n}h" for n in lags],
            "interaction_features": ["demand_cop_ratio", "winter_demand", "peak_demand"],
        },
    }


@dataclass(frozen=True)
class Preprocessor:
    """Label and summarise, fill gaps, drop outliers, scale.

    ``fit`` learns every step on one table; the model applies them to any other, so
    held-out rows never influence what was learned.
    """

    imputation: str = "knn"
    scaling: str = "robust"
    outliers: bool = True
    contamination: float = 0.1
    window: int = 168
    seed: int = 42
    features: tuple[str, ...] | None = None
    label_rows: bool = True
    layout: SeriesLayout = DEFAULT_LAYOUT

    def prepare(self, df: DataFrame) -> DataFrame:
        if not self.label_rows:
            return df
        return label_and_summarise(df, self.layout, self.window)

    def fit(self, df: DataFrame) -> PreprocessorModel:
        return self.fit_transform(df)[1]

    def fit_transform(self, df: DataFrame) -> tuple[DataFrame, PreprocessorModel]:
        """The processed table and the model; every step runs once."""
        ready = self.prepare(df)
        columns = list(self.features) if self.features else None
        filler = None
        if self.imputation == "knn":
            filler = FillNeighbours(columns, layout=self.layout).fit(ready)
        elif self.imputation != "none":
            filler = FillStatistic(self.imputation, columns).fit(ready)
        if filler is not None:
            ready = filler.transform(ready)
        forest = None
        if self.outliers:
            # scored and read several times while fitting
            ready = durable(ready)
            key = (*self.layout.keys, self.layout.time)
            forest = IsolationForest(
                columns, key, self.contamination, seed=self.seed
            ).fit(ready)
            # the survivors are scored once, for the scaler's quantiles and the output
            ready = durable(forest.transform(ready))
        scaled = [c for c in columns if c not in NOT_SCALED] if columns else None
        scaler = Scale(self.scaling, scaled).fit(ready)
        return scaler.transform(ready), PreprocessorModel(self, filler, forest, scaler)


@dataclass(frozen=True)
class PreprocessorModel:
    settings: Preprocessor
    filler: Fitted | None
    forest: Fitted | None
    scaler: Fitted

    def transform(self, df: DataFrame) -> DataFrame:
        ready = self.settings.prepare(df)
        if self.filler is not None:
            ready = self.filler.transform(ready)
        if self.forest is not None:
            ready = self.forest.transform(ready)
        return self.scaler.transform(ready)

    def feature_names(self) -> list[str]:
        return list(self.scaler.state["columns"])

    def info(self) -> dict[str, object]:
        s = self.settings
        return {
            "imputation_method": s.imputation,
            "scaling_method": s.scaling,
            "outlier_detection": s.outliers,
            "outlier_contamination": s.contamination,
            "random_state": s.seed,
            "is_fitted": True,
            "feature_columns": self.feature_names(),
        }


def pipeline_info(model: PreprocessorModel, features: Sequence[str]) -> dict[str, object]:
    """Settings of the preprocessing and of the features built on top."""
    return {"preprocessor_info": model.info(), "feature_info": feature_info(features)}


def process(
    df: DataFrame, preprocessor: Preprocessor = Preprocessor()
) -> tuple[DataFrame, PreprocessorModel]:
    """Preprocess, engineer features on the surviving rows, and check the result."""
    processed, model = preprocessor.fit_transform(df)
    built = durable(engineer(processed, layout=preprocessor.layout))
    for finding in guard_processed(built).collect():
        log.warning("%s: %s", finding["check"], finding["value"])
    return built, model


def analysis_features(
    df: DataFrame,
    thresholds: DataFrame | None = None,
    demand: str = DEMAND,
    cop: str = COP,
    layout: SeriesLayout = DEFAULT_LAYOUT,
) -> DataFrame:
    """Seasonal label plus the twelve analysis features; incomplete rows dropped.

    Pass ``thresholds`` fitted on training years to label all years with them.
    """
    labelled = label_seasonal(df, thresholds, layout.keys, demand, cop)
    ts = F.col(layout.time)
    dated = labelled.withColumns(
        {
            "hour": F.hour(ts),
            "weekday": F.weekday(ts),
            "month": F.month(ts),
            "is_winter": in_season("winter", F.month(ts)),
        }
    )

    def moving(win: SeriesWindows) -> dict[str, Column]:
        return {
            **partial_columns(demand, cop, (24, 72, 168), win),
            **label_lag_columns("stress_hour", LAG_ROWS, win),
        }

    return with_series_windows(dated, 167, moving, layout).dropna("any")


def keep_surviving(
    df: DataFrame, processed: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("series", "ts")
) -> DataFrame:
    """Rows of ``df`` that survived processing, with the processed feature values."""
    values = processed.select(*keys, *columns)
    return df.drop(*columns).join(values, list(keys))
