"""Duration curves and the search for example weeks with stress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridload.operators.ordering import (
    DEFAULT_LAYOUT,
    SeriesLayout,
    running_totals,
    time_position,
)
from gridload.operators.select import first_rows, winter_rows
from gridload.session import durable

_BLOCK = 4096


def duration_steps(
    df: DataFrame, keys: Sequence[str] = ("series",), demand: str = "heat_demand_total"
) -> DataFrame:
    """Duration curve as steps: rows at each demand level and their first rank.

    (keys, demand, hours, first_rank, last_rank), ranks 0-based from the highest
    demand. Equal demands stay one row, however many there are.
    """
    levels = df.filter(F.col(demand).isNotNull()).groupBy(*keys, demand).agg(
        F.count(F.lit(1)).alias("hours")
    )
    ranked = running_totals(levels, keys, demand, ["hours"], descending=True)
    return ranked.select(
        *keys,
        F.col(demand).alias("demand"),
        "hours",
        (F.col("cum_hours") - F.col("hours")).alias("first_rank"),
        (F.col("cum_hours") - 1).alias("last_rank"),
    )


def expand_ranks(steps: DataFrame) -> DataFrame:
    """One row per rank. Long steps are cut into blocks and spread before expanding."""
    blocks = steps.withColumn(
        "_from", F.explode(F.sequence("first_rank", "last_rank", F.lit(_BLOCK)))
    )
    spread = blocks.repartition(F.col("_from"), F.col("demand"))
    return spread.withColumn(
        "rank",
        F.explode(F.sequence("_from", F.least(F.col("_from") + (_BLOCK - 1), "last_rank"))),
    ).drop("_from", "hours", "first_rank", "last_rank")


def duration_curve(
    df: DataFrame, keys: Sequence[str] = ("series",), demand: str = "heat_demand_total"
) -> DataFrame:
    """(keys, demand, rank): demand sorted from high to low."""
    return expand_ranks(duration_steps(df, keys, demand))


def scenario_array(scenarios: Sequence[dict]) -> Column:
    """Literal scenario list as an array of structs, ready to explode."""
    return F.array(
        *[F.struct(*[F.lit(v).alias(k) for k, v in row.items()]) for row in scenarios]
    )


def response_curves(
    df: DataFrame,
    scenarios: Sequence[dict],
    keys: Sequence[str] = ("series",),
    demand: str = "heat_demand_total",
) -> DataFrame:
    """Duration curve after response: demand x (1 - shift_fraction / 2) per scenario."""
    curve = duration_curve(df, keys, demand)
    return (
        curve.withColumn("_s", F.explode(scenario_array(scenarios)))
        .select(
            *keys,
            F.col("_s.scenario").alias("scenario"),
            "rank",
            "demand",
            (F.col("demand") * (1 - F.col("_s.shift_fraction") * 0.5)).alias("demand_after"),
        )
    )


def stress_week_starts(
    df: DataFrame,
    label: str = "stress_hour",
    rows: int = 168,
    step: int = 24,
    examples: int = 3,
    layout: SeriesLayout = DEFAULT_LAYOUT,
) -> DataFrame:
    """(keys, example, start_row): first winter windows that contain stress.

    Windows start every ``step`` winter rows while ``start < n - rows``. Each stress
    row names the few windows it lies in, so no window is ever scanned.
    """
    return _week_starts(_numbered_winter(df, layout), label, rows, step, examples, layout)


def _numbered_winter(df: DataFrame, layout: SeriesLayout) -> DataFrame:
    """Winter rows with ``_row``, their number in the series, and ``_rows``, how many."""
    return time_position(winter_rows(df, layout.time), layout, "_row", total="_rows")


def _week_starts(
    winter: DataFrame, label: str, rows: int, step: int, examples: int, layout: SeriesLayout
) -> DataFrame:
    row, n = F.col("_row"), F.col("_rows")
    first = F.greatest(F.ceil((row - (rows - 1)) / step) * step, F.lit(0))
    last = F.least(F.floor(row / step) * step, F.floor((n - rows - 1) / step) * step)
    starts = (
        winter.filter((F.col(label) > 0) & (n > rows) & (first <= last))
        .withColumn("start_row", F.explode(F.sequence(first, last, F.lit(step).cast("bigint"))))
        .select(*layout.keys, "start_row")
        .distinct()
    )
    order = Window.partitionBy(*layout.keys).orderBy("start_row")
    return starts.withColumn("example", F.row_number().over(order)).filter(
        F.col("example") <= examples
    )


def example_week(
    df: DataFrame,
    label: str = "stress_hour",
    rows: int = 168,
    step: int = 24,
    layout: SeriesLayout = DEFAULT_LAYOUT,
) -> DataFrame:
    """The week to show for each series.

    The first winter window with stress; without one the first winter rows; with
    fewer than ``rows`` winter rows the first rows of the whole series. Winter rows are
    numbered once, in a written table that starts, week and remainder share.
    """
    keys = list(layout.keys)
    winter = durable(_numbered_winter(df, layout))
    starts = _week_starts(winter, label, rows, step, 1, layout).select(*keys, "start_row")
    start = F.coalesce(F.col("start_row"), F.lit(0))
    chosen = (
        winter.filter(F.col("_rows") >= rows)
        .join(starts, keys, "left")
        .filter((F.col("_row") >= start) & (F.col("_row") < start + rows))
        .select(*df.columns)
    )
    served = winter.filter((F.col("_row") == 0) & (F.col("_rows") >= rows)).select(*keys)
    rest = df.join(served, keys, "left_anti")
    return chosen.unionByName(first_rows(rest, rows, layout).select(*df.columns))
