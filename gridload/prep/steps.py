"""Fitted column steps: simple imputation and scaling."""

from __future__ import annotations

import json
import logging
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridload.operators.ordering import DEFAULT_LAYOUT, SeriesLayout
from gridload.prep.base import (
    NOT_SCALED,
    Fitted,
    Step,
    chosen,
    column_quantiles,
    column_stats,
)
from gridload.prep.neighbours import knn_impute

log = logging.getLogger(__name__)


class FillStatistic(Step):
    """Replace missing cells with the column's mean or exact median."""

    def __init__(self, method: str = "mean", columns: Sequence[str] | None = None):
        super().__init__()
        if method not in ("mean", "median"):
            raise ValueError(f"unknown imputation method: {method}")
        self.method, self.columns = method, columns

    def _fit(self, df: DataFrame) -> FillModel:
        columns = chosen(df, self.columns)
        if self.method == "mean":
            values = {c: s["mean"] for c, s in column_stats(df, columns).items()}
        else:
            values = {c: q.get(0.5) for c, q in column_quantiles(df, columns, [0.5]).items()}
        return FillModel({"values": values})


class FillModel(Fitted):
    def _transform(self, df: DataFrame) -> DataFrame:
        filled = {}
        for c, value in self.state["values"].items():
            if c in df.columns and value is not None:
                x = F.col(c).cast("double")
                filled[c] = F.coalesce(F.when(~F.isnan(x), x), F.lit(float(value)))
        return df.withColumns(filled) if filled else df


class FillNeighbours(Step):
    """Replace missing cells from the nearest rows of the table fitted on."""

    def __init__(
        self,
        columns: Sequence[str] | None = None,
        k: int = 5,
        layout: SeriesLayout = DEFAULT_LAYOUT,
    ):
        super().__init__()
        self.columns, self.k, self.layout = columns, k, layout

    def _fit(self, df: DataFrame) -> NeighbourModel:
        return NeighbourModel(df, chosen(df, self.columns), self.k, self.layout)


class NeighbourModel(Fitted):
    def __init__(self, donors: DataFrame, columns: list[str], k: int, layout: SeriesLayout):
        super().__init__({"columns": columns, "k": k, "layout": asdict(layout)})
        self.donors, self.layout = donors, layout

    def save(self, spark: SparkSession, path: str) -> None:
        """The donors are part of the model: a table beside its description."""
        super().save(spark, f"{path}/state")
        keys = [*self.layout.keys, self.layout.time]
        self.donors.select(*keys, *self.state["columns"]).write.mode("overwrite").parquet(f"{path}/donors")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NeighbourModel:
        row = spark.read.schema("kind string, state string").json(f"{path}/state").first()
        if row is None or row["kind"] != cls.__name__:
            raise ValueError(f"{path} does not hold a {cls.__name__}")
        state = json.loads(row["state"])
        layout = SeriesLayout(**{**state["layout"], "keys": tuple(state["layout"]["keys"])})
        return cls(spark.read.parquet(f"{path}/donors"), state["columns"], state["k"], layout)

    def _transform(self, df: DataFrame) -> DataFrame:
        columns = self.state["columns"]
        donors = None if df is self.donors else self.donors
        return knn_impute(df, columns, self.state["k"], donors, self.layout)


class Scale(Step):
    """Robust (median, quartile range), standard (population) or min-max scaling.

    Labels, calendar columns and the physical quantities themselves are left alone.
    A zero spread divides by one. Unknown methods fall back to robust.
    """

    def __init__(
        self,
        method: str = "robust",
        columns: Sequence[str] | None = None,
        exclude: Sequence[str] = NOT_SCALED,
    ):
        super().__init__()
        if method not in ("robust", "standard", "minmax"):
            log.warning("unknown scaling method %s, using robust", method)
            method = "robust"
        self.method, self.columns, self.exclude = method, columns, exclude

    def _fit(self, df: DataFrame) -> ScaleModel:
        columns = chosen(df, self.columns, self.exclude)
        centre, spread = {}, {}
        if columns and self.method == "robust":
            for c, q in column_quantiles(df, columns, [0.25, 0.5, 0.75]).items():
                if q:
                    centre[c], spread[c] = q[0.5], q[0.75] - q[0.25]
        elif columns:
            for c, s in column_stats(df, columns).items():
                if s["mean"] is None:
                    continue
                if self.method == "standard":
                    centre[c], spread[c] = s["mean"], s["std"]
                else:
                    centre[c], spread[c] = s["min"], s["max"] - s["min"]
        return ScaleModel(
            {
                "columns": columns,
                "centre": centre,
                "spread": {c: v if v else 1.0 for c, v in spread.items()},
            }
        )


class ScaleModel(Fitted):
    def _transform(self, df: DataFrame) -> DataFrame:
        centre, spread = self.state["centre"], self.state["spread"]
        scaled = {
            c: (F.col(c).cast("double") - F.lit(float(centre[c]))) / F.lit(float(spread[c]))
            for c in centre
            if c in df.columns
        }
        return df.withColumns(scaled) if scaled else df
