"""Demand-response what-ifs: reduce demand in stress hours, shift it, or estimate.

All of it is one pass over the original demand: an hour's action never depends on
the action of another hour, so hours can be handled in any order and in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridload.functions.calendar import flag
from gridload.functions.scalars import divide_by_maximum, fixed, title_case
from gridload.operators.curves import scenario_array
from gridload.operators.ordering import (
    DEFAULT_LAYOUT,
    SeriesLayout,
    SeriesWindows,
    Stage,
    with_series_windows,
)
from gridload.operators.select import peak_hours
from gridload.operators.stress import COP, DEMAND, rolling_thresholds

STRATEGIES = ("conservative", "aggressive", "adaptive")
# fixed values: share of the shift fraction each strategy applies, severity limit
STRATEGY_SHARE = {"conservative": 0.5, "aggressive": 1.5}
SEVERITY_LIMIT = 2.0
SHIFT_FRACTION, SHIFT_HOURS = 0.1, 4
# fixed values: trigger scenarios
SCENARIOS = (
    {"scenario": "conservative", "tau": 0.6, "alpha": 0.1},
    {"scenario": "moderate", "tau": 0.7, "alpha": 0.15},
    {"scenario": "aggressive", "tau": 0.8, "alpha": 0.2},
)


def _marked(mask: str) -> Column:
    return F.coalesce(F.col(mask).cast("boolean"), F.lit(False))


def _response_stages(
    df: DataFrame,
    strategy: str,
    shift_fraction: float,
    mask: str,
    demand: str,
    cop: str,
    window: int,
) -> tuple[list[Stage], int]:
    """Steps that add the response columns, and how far they look back."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    stages: list[Stage] = []
    look_back = 0
    if strategy == "adaptive":
        if not {"demand_threshold", "cop_threshold"} <= set(df.columns):
            stages.append(rolling_thresholds(demand, cop, window=window))
            look_back = window - 1
        severity = (
            F.try_divide(F.col(demand), F.col("demand_threshold"))
            + F.try_divide(F.col("cop_threshold"), F.col(cop))
        ) / 2
        limited = F.when(severity.isNotNull(), F.least(severity, F.lit(SEVERITY_LIMIT)))
        change = -(F.col(demand) * shift_fraction * limited)
    else:
        severity = F.lit(None).cast("double")
        change = -(F.col(demand) * (shift_fraction * STRATEGY_SHARE[strategy]))
    stages.append(
        lambda win: {
            "severity_factor": F.when(_marked(mask), severity),
            "demand_change": F.when(_marked(mask), change),
        }
    )
    stages.append(
        lambda win: {
            "adjusted_demand": F.col(demand) + F.coalesce(F.col("demand_change"), F.lit(0.0))
        }
    )
    return stages, look_back


def respond(
    df: DataFrame,
    strategy: str = "conservative",
    shift_fraction: float = SHIFT_FRACTION,
    mask: str = "stress_hour",
    demand: str = DEMAND,
    cop: str = COP,
    window: int = 168,
    layout: SeriesLayout = DEFAULT_LAYOUT,
) -> DataFrame:
    """Reduce demand in marked rows.

    Adds ``demand_change`` (null where nothing was done), ``severity_factor``
    (adaptive only) and ``adjusted_demand``. The adaptive strategy reads trailing
    thresholds from the original demand, reusing ``demand_threshold`` and
    ``cop_threshold`` when the table has them; without a full window it does nothing.
    """
    stages, look_back = _response_stages(
        df, strategy, shift_fraction, mask, demand, cop, window
    )
    if look_back == 0:
        # nothing looks at other rows: a plain projection
        return with_series_windows(df, 0, stages, replace(layout, chunk_rows=None))
    return with_series_windows(df, look_back, stages, layout)


def action_list(
    responded: DataFrame,
    strategy: str,
    mask: str = "stress_hour",
    keys: Sequence[str] = ("series",),
    time: str = "ts",
) -> DataFrame:
    """One row per action: when, what, how much."""
    kind = "adaptive_reduction" if strategy == "adaptive" else "demand_reduction"
    return responded.filter(F.col(mask).cast("boolean")).select(
        *keys,
        time,
        F.lit(kind).alias("action_type"),
        "demand_change",
        "severity_factor",
        F.lit(strategy).alias("strategy"),
    )


def _relabel_stages(adjusted: str, cop: str, window: int) -> list[Stage]:
    """``stress_after``: the rolling label evaluated on adjusted demand."""

    def mark(win: SeriesWindows) -> dict[str, Column]:
        high = F.col(adjusted) >= F.col("_after_demand_threshold")
        return {"stress_after": flag(high & (F.col(cop) <= F.col("_after_cop_threshold")))}

    return [rolling_thresholds(adjusted, cop, window=window, prefix="_after_"), mark]


def _reduction(original: str, after: str) -> list[Column]:
    lost = F.col(original) - F.col(after)
    return [
        lost.alias("stress_reduction"),
        F.coalesce(F.try_divide(lost, F.col(original)) * 100, F.lit(0.0)).alias(
            "stress_reduction_percentage"
        ),
    ]


def response_impact(
    df: DataFrame,
    strategy: str = "conservative",
    shift_fraction: float = SHIFT_FRACTION,
    mask: str = "stress_hour",
    demand: str = DEMAND,
    cop: str = COP,
    window: int = 168,
    keys: Sequence[str] = ("series",),
    layout: SeriesLayout = DEFAULT_LAYOUT,
) -> DataFrame:
    """Stress hours before and after, demand change and action count per group.

    Acting and relabelling share one window pass. Groups without stress hours report ``strategy='none'`` and zeros.
    """
    stages, look_back = _response_stages(
        df, strategy, shift_fraction, mask, demand, cop, window
    )
    stages += _relabel_stages("adjusted_demand", cop, window)
    after = with_series_windows(df, look_back + window - 1, stages, layout)
    totals = after.groupBy(*keys).agg(
        F.count_if(_marked(mask)).alias("stress_hours_original"),
        F.sum("stress_after").cast("bigint").alias("_after"),
        F.coalesce(F.sum("demand_change"), F.lit(0.0)).alias("_change"),
    )
    some = F.col("stress_hours_original") > 0
    return totals.select(
        *keys,
        F.when(some, F.lit(strategy)).otherwise(F.lit("none")).alias("strategy"),
        "stress_hours_original",
        F.when(some, F.col("_after")).otherwise(F.lit(0)).alias("stress_hours_after_dr"),
        F.when(some, F.col("_change")).otherwise(F.lit(0.0)).alias("total_demand_change"),
        F.col("stress_hours_original").alias("dr_actions_count"),
    ).select("*", *_reduction("stress_hours_original", "stress_hours_after_dr"))


def _hour_index(time: str) -> Column:
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("HOUR", epoch, F.col(time).cast("timestamp_ntz"))


def shift_targets(
    df: DataFrame,
    mask: str = "stress_hour",
    max_shift_hours: int = SHIFT_HOURS,
    demand: str = DEMAND,
    keys: Sequence[str] = ("series",),
    time: str = "ts",
) -> DataFrame:
    """Lowest-demand hour within reach of each marked hour, earliest on ties.

    (keys, ts, demand, shift_time, target_demand). The interval join runs as an equi
    join: both sides carry time slots as wide as the reach, a marked hour visiting the
    one or two slots its interval touches. Slots also split a long series over tasks.
    """
    keys = list(keys)
    width = 2 * max_shift_hours + 1
    hour = _hour_index(time)
    slot = F.floor(hour / width).cast("bigint")
    sources = (
        df.filter(F.col(mask).cast("boolean"))
        .select(
            *keys,
            F.col(time).alias("_source"),
            F.col(demand).alias("_demand"),
            F.explode(
                F.sequence(
                    F.floor((hour - max_shift_hours - 1) / width).cast("bigint"),
                    F.floor((hour + max_shift_hours + 1) / width).cast("bigint"),
                )
            ).alias("_slot"),
        )
    )
    candidates = df.filter(F.col(demand).isNotNull()).select(
        *keys,
        F.col(time).alias("_target"),
        F.col(demand).alias("_target_demand"),
        slot.alias("_slot"),
    )
    seconds = F.timestamp_diff("SECOND", F.col("_source"), F.col("_target"))
    reachable = (F.abs(seconds) <= max_shift_hours * 3600) & (seconds % 3600 == 0)
    best = F.min(F.struct(F.col("_target_demand").alias("d"), F.col("_target").alias("t")))
    return (
        sources.join(candidates, [*keys, "_slot"])
        .filter(reachable)
        .groupBy(*keys, "_source", "_demand")
        .agg(best.alias("best"))
        .select(
            *keys,
            F.col("_source").alias(time),
            F.col("_demand").alias("demand"),
            F.col("best.t").alias("shift_time"),
            F.col("best.d").alias("target_demand"),
        )
    )


def reachable_hours(
    df: DataFrame,
    mask: str = "stress_hour",
    max_shift_hours: int = SHIFT_HOURS,
    keys: Sequence[str] = ("series",),
    time: str = "ts",
) -> DataFrame:
    """(keys, ts, candidate): the hours around marked rows that exist in the table."""
    keys = list(keys)
    offsets = F.sequence(F.lit(-max_shift_hours), F.lit(max_shift_hours))
    wanted = df.filter(F.col(mask).cast("boolean")).select(
        *keys, F.col(time).alias("_source"), F.explode(offsets).alias("_h")
    )
    wanted = wanted.select(
        *keys,
        "_source",
        (F.col("_source") + F.make_dt_interval(F.lit(0), F.col("_h"))).alias(time),
    )
    return wanted.join(df.select(*keys, time), [*keys, time], "left_semi").select(
        *keys, F.col("_source").alias(time), F.col(time).alias("candidate")
    )


def plan_load_shift(
    df: DataFrame,
    mask: str = "stress_hour",
    shift_fraction: float = SHIFT_FRACTION,
    max_shift_hours: int = SHIFT_HOURS,
    demand: str = DEMAND,
    keys: Sequence[str] = ("series",),
    time: str = "ts",
) -> DataFrame:
    """Moves worth making: targets strictly below the demand they relieve."""
    targets = shift_targets(df, mask, max_shift_hours, demand, keys, time)
    return targets.filter(F.col("target_demand") < F.col("demand")).select(
        *keys,
        time,
        F.col("demand").alias("original_demand"),
        (F.col("demand") * shift_fraction).alias("shiftable_demand"),
        "shift_time",
        F.lit("demand_shift").alias("action_type"),
    )


def apply_shift(
    df: DataFrame,
    plan: DataFrame,
    demand: str = DEMAND,
    keys: Sequence[str] = ("series",),
    time: str = "ts",
) -> DataFrame:
    """Add ``shift_change`` and ``adjusted_demand``; moves into one hour add up."""
    keys = list(keys)
    ends = F.array(
        F.struct(F.col(time).alias("t"), (-F.col("shiftable_demand")).alias("d")),
        F.struct(F.col("shift_time").alias("t"), F.col("shiftable_demand").alias("d")),
    )
    net = (
        plan.select(*keys, F.explode(ends).alias("e"))
        .groupBy(*keys, F.col("e.t").alias(time))
        .agg(F.sum("e.d").alias("shift_change"))
    )
    change = F.coalesce(F.col("shift_change"), F.lit(0.0))
    return (
        df.join(net, [*keys, time], "left")
        .withColumn("shift_change", change)
        .withColumn("adjusted_demand", F.col(demand) + F.col("shift_change"))
    )


def shift_impact(
    df: DataFrame,
    mask: str = "stress_hour",
    shift_fraction: float = SHIFT_FRACTION,
    max_shift_hours: int = SHIFT_HOURS,
    demand: str = DEMAND,
    cop: str = COP,
    window: int = 168,
    keys: Sequence[str] = ("series",),
    layout: SeriesLayout = DEFAULT_LAYOUT,
) -> DataFrame:
    """Stress hours before and after shifting, net change, moves, mean move."""
    keys = list(keys)
    plan = plan_load_shift(df, mask, shift_fraction, max_shift_hours, demand, keys, layout.time)
    moves = plan.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_actions"), F.avg("shiftable_demand").alias("_mean")
    )
    shifted = apply_shift(df, plan, demand, keys, layout.time)
    after = with_series_windows(
        shifted, window - 1, _relabel_stages("adjusted_demand", cop, window), layout
    )
    totals = after.groupBy(*keys).agg(
        F.count_if(_marked(mask)).alias("stress_hours_original"),
        F.sum("stress_after").cast("bigint").alias("_after"),
        F.sum("shift_change").alias("_change"),
    )
    some = F.col("stress_hours_original") > 0
    return (
        totals.join(moves, keys, "left")
        .select(
            *keys,
            "stress_hours_original",
            F.when(some, F.col("_after")).otherwise(F.lit(0)).alias("stress_hours_after_dr"),
            F.when(some, F.col("_change")).otherwise(F.lit(0.0)).alias("total_demand_change"),
            F.coalesce(F.col("_actions"), F.lit(0)).alias("dr_actions_count"),
            F.coalesce(F.col("_mean"), F.lit(0.0)).alias("average_demand_shift"),
        )
        .select("*", *_reduction("stress_hours_original", "stress_hours_after_dr"))
    )


def trigger_estimates(
    df: DataFrame,
    scenarios: Sequence[dict] = SCENARIOS,
    score: str = "y_proba",
    demand: str = DEMAND,
    keys: Sequence[str] = (),
    time: str = "ts",
) -> DataFrame:
    """Peak-hour interventions and shifted energy for each (tau, alpha) scenario.

    One aggregation counts all triggers; scenarios never multiply the input rows.
    """
    peaks = peak_hours(df, time)
    taus = sorted({float(s["tau"]) for s in scenarios})
    totals = peaks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.coalesce(F.sum(demand), F.lit(0.0)).alias("_sum"),
        *[F.count_if(F.col(score) >= t).alias(f"_hits{i}") for i, t in enumerate(taus)],
    )
    hits = F.element_at(
        F.array(*[F.col(f"_hits{i}") for i in range(len(taus))]),
        F.array_position(F.array(*[F.lit(t) for t in taus]), F.col("_s.tau")).cast("int"),
    )
    rows = [
        {"scenario": s["scenario"], "tau": float(s["tau"]), "alpha": float(s["alpha"])}
        for s in scenarios
    ]
    shifted = F.coalesce(
        F.col("_sum") * F.col("alpha") * F.try_divide(F.col("interventions"), F.col("_n")),
        F.lit(0.0),
    )
    return (
        totals.withColumn("_s", F.explode(scenario_array(rows)))
        .select(
            *keys,
            F.col("_s.scenario").alias("scenario"),
            F.col("_s.tau").alias("tau"),
            F.col("_s.alpha").alias("alpha"),
            hits.alias("interventions"),
            "_n",
            "_sum",
        )
        .withColumn("shifted_energy", shifted)
        .withColumn(
            "peak_reduction_percent",
            F.when(
                F.col("_sum") > 0, F.col("shifted_energy") / F.col("_sum") * 100
            ).otherwise(F.lit(0.0)),
        )
        .drop("_n", "_sum")
    )


def sensitivity(
    df: DataFrame,
    taus: Sequence[float] = (),
    alphas: Sequence[float] = (),
    tau: float = 0.6,
    alpha: float = 0.1,
    **columns: object,
) -> DataFrame:
    """Peak reduction over a tau grid (alpha fixed) and an alpha grid (tau fixed)."""
    grid = [{"scenario": "threshold", "tau": t, "alpha": alpha} for t in taus]
    grid += [{"scenario": "shift", "tau": tau, "alpha": a} for a in alphas]
    return trigger_estimates(df, grid, **columns).withColumnRenamed("scenario", "curve")


def response_table(estimates: DataFrame) -> DataFrame:
    """Report table: interventions, peak reduction, reduction per intervention."""
    per = F.try_divide(F.col("peak_reduction_percent"), F.col("interventions"))
    return estimates.select(
        title_case(F.col("scenario")).alias("Scenario"),
        F.col("interventions").cast("bigint").alias("Interventions"),
        fixed("peak_reduction_percent", 3).alias("Peak Reduction (%)"),
        F.when(per.isNotNull(), fixed(per, 6)).alias("Efficiency (Reduction/Intervention)"),
        F.when(per.isNotNull(), fixed(per, 4, "%")).alias("Average Reduction per Intervention"),
    )


def impact_table(impacts: DataFrame) -> DataFrame:
    """Report table over impacts with scenario, threshold, shift_fraction and
    interventions_per_day columns."""
    return impacts.select(
        F.col("scenario").alias("Scenario"),
        F.col("threshold").alias("Threshold"),
        F.col("shift_fraction").alias("Shift Fraction"),
        fixed("stress_reduction_percentage", 1).alias("Peak Reduction (%)"),
        fixed("interventions_per_day", 1).alias("Interventions/Day"),
        F.col("dr_actions_count").alias("Total Actions"),
    )


def compare_scenarios(estimates: DataFrame) -> DataFrame:
    """Peak reduction, interventions and efficiency, each divided by its maximum.

    Runs over one row per scenario.
    """
    rows = estimates.withColumn(
        "efficiency", F.try_divide(F.col("peak_reduction_percent"), F.col("interventions"))
    )
    return divide_by_maximum(
        rows.select("scenario", "peak_reduction_percent", "interventions", "efficiency"),
        {
            "peak_reduction_norm": "peak_reduction_percent",
            "interventions_norm": "interventions",
            "efficiency_norm": "efficiency",
        },
    )


def reduction_trend(estimates: DataFrame) -> DataFrame:
    """Straight-line fit of peak reduction on interventions."""
    y, x = "peak_reduction_percent", "interventions"
    return estimates.agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")
    )
