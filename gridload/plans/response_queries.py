"""Queries for demand response."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridload.operators import curves, response, stress
from gridload.operators.ordering import number_rows
from gridload.plans.fixtures import daily, hourly, with_views
from gridload.plans.registry import query, rounded
from gridload.plans.series_queries import (
    DYNAMIC_FLAGS,
    SMALL_CHUNKS,
    dynamic_sql,
)

WEEK = (
    ("t", dynamic_sql("hourly", 168)),
    ("l", f"SELECT *, {DYNAMIC_FLAGS} FROM t"),
)


def labelled(spark, sf_dir):
    rows = number_rows(hourly(spark, sf_dir), SMALL_CHUNKS)
    return stress.label_dynamic(rows, window=168, layout=SMALL_CHUNKS)


def adjusted_sql(change: str) -> tuple[tuple[str, str], ...]:
    """Demand after the change, relabelled against its own trailing quantiles."""
    frame = "(PARTITION BY series ORDER BY ts ROWS 167 PRECEDING)"
    return (
        (
            "a",
            f"""SELECT series, ts, heat_demand_total AS original, cop_average, stress_hour,
  CASE WHEN stress_hour = 1 THEN {change} END AS demand_change,
  heat_demand_total + coalesce(CASE WHEN stress_hour = 1 THEN {change} END, 0e0) AS adj FROM l""",
        ),
        (
            "b",
            f"""SELECT *, coalesce(adj >= CASE WHEN count(adj) OVER {frame} = 168
    THEN quantile_cont(adj, 0.9) OVER {frame} END
  AND cop_average <= CASE WHEN count(cop_average) OVER {frame} = 168
    THEN quantile_cont(cop_average, 0.1) OVER {frame} END, false)::INT AS after FROM a""",
        ),
    )


SEVERITY = "((heat_demand_total / dt + ct / cop_average) / 2)"
CHANGE = {
    "conservative": "-(heat_demand_total * (0.1e0 * 0.5e0))",
    "aggressive": "-(heat_demand_total * (0.1e0 * 1.5e0))",
    "adaptive": f"-(heat_demand_total * 0.1e0 * least({SEVERITY}, 2e0))",
}


def action_sql(strategy: str) -> str:
    kind = "adaptive_reduction" if strategy == "adaptive" else "demand_reduction"
    severity = f"round({SEVERITY}, 6)" if strategy == "adaptive" else "NULL::DOUBLE"
    return (
        with_views("hourly", *WEEK)
        + f"""SELECT series, ts, '{kind}' AS action_type, round({CHANGE[strategy]}, 6) AS demand_change,
  {severity} AS severity_factor, '{strategy}' AS strategy FROM l WHERE stress_hour = 1"""
    )


def actions(strategy):
    def run(spark, sf_dir):
        acted = response.respond(
            labelled(spark, sf_dir), strategy, window=168, layout=SMALL_CHUNKS
        )
        return rounded(response.action_list(acted, strategy))

    return run


def impact_sql(strategy: str) -> str:
    return (
        with_views("hourly", *WEEK, *adjusted_sql(CHANGE[strategy]))
        + f"""SELECT series, CASE WHEN n > 0 THEN '{strategy}' ELSE 'none' END AS strategy,
  n AS stress_hours_original, CASE WHEN n > 0 THEN m ELSE 0 END AS stress_hours_after_dr,
  n - CASE WHEN n > 0 THEN m ELSE 0 END AS stress_reduction,
  round(coalesce((n - CASE WHEN n > 0 THEN m ELSE 0 END) / nullif(n, 0) * 100, 0e0), 6)
    AS stress_reduction_percentage,
  round(change, 4) AS total_demand_change, n AS dr_actions_count
FROM (SELECT series, sum(stress_hour)::BIGINT AS n, sum(after)::BIGINT AS m,
        coalesce(sum(demand_change), 0e0) AS change FROM b GROUP BY 1)"""
    )


def impact(strategy):
    def run(spark, sf_dir):
        table = response.response_impact(
            labelled(spark, sf_dir), strategy, window=168, layout=SMALL_CHUNKS
        )
        return rounded(
            table.withColumn("total_demand_change", F.round("total_demand_change", 4))
        )

    return run


for _strategy in response.STRATEGIES:
    query(f"response_actions_{_strategy}", action_sql(_strategy))(actions(_strategy))
    query(f"response_impact_{_strategy}", impact_sql(_strategy))(impact(_strategy))


@query(
    "response_impact_none",
    with_views("hourly")
    + """SELECT series, 'none' AS strategy, 0::BIGINT AS stress_hours_original,
  0::BIGINT AS stress_hours_after_dr, 0e0 AS total_demand_change, 0::BIGINT AS dr_actions_count,
  0::BIGINT AS stress_reduction, 0e0 AS stress_reduction_percentage FROM hourly GROUP BY series""",
)
def response_impact_none(spark, sf_dir):
    calm = hourly(spark, sf_dir).withColumn("stress_hour", F.lit(0))
    return response.response_impact(calm, "aggressive", window=168, layout=SMALL_CHUNKS)


TOP = (
    "k",
    """SELECT *, (heat_demand_total > round(quantile_cont(heat_demand_total, 0.9) OVER (PARTITION BY series), 6))::INT
  AS stress_hour FROM hourly""",
)
TARGETS = (
    "tg",
    """SELECT a.series, a.ts, a.heat_demand_total AS demand, b.ts AS shift_time,
  b.heat_demand_total AS target_demand FROM k a JOIN k b ON a.series = b.series
  AND b.ts BETWEEN a.ts - INTERVAL 4 HOUR AND a.ts + INTERVAL 4 HOUR
WHERE a.stress_hour = 1
QUALIFY row_number() OVER (PARTITION BY a.series, a.ts ORDER BY b.heat_demand_total, b.ts) = 1""",
)


def top_demand(spark, sf_dir):
    """Marks the hours above the 90 % quantile of their series."""
    limits = hourly(spark, sf_dir).groupBy("series").agg(
        F.round(F.percentile("heat_demand_total", F.lit(0.9)), 6).alias("_limit")
    )
    return (
        hourly(spark, sf_dir)
        .join(limits, "series")
        .withColumn("stress_hour", (F.col("heat_demand_total") > F.col("_limit")).cast("int"))
        .drop("_limit")
    )


@query("shift_targets", with_views("hourly", TOP, TARGETS) + "SELECT * FROM tg")
def shift_targets(spark, sf_dir):
    return response.shift_targets(top_demand(spark, sf_dir))


@query(
    "reachable_hours",
    with_views("hourly", TOP)
    + """SELECT a.series, a.ts, b.ts AS candidate FROM k a JOIN k b ON a.series = b.series
  AND b.ts BETWEEN a.ts - INTERVAL 4 HOUR AND a.ts + INTERVAL 4 HOUR WHERE a.stress_hour = 1""",
)
def reachable_hours(spark, sf_dir):
    return response.reachable_hours(top_demand(spark, sf_dir))


PLAN = (
    "pl",
    """SELECT series, ts, demand AS original_demand, demand * 0.1e0 AS shiftable_demand, shift_time
FROM tg WHERE target_demand < demand""",
)


@query(
    "load_shift_plan",
    with_views("hourly", TOP, TARGETS, PLAN)
    + """SELECT series, ts, original_demand, round(shiftable_demand, 6) AS shiftable_demand,
  shift_time, 'demand_shift' AS action_type FROM pl""",
)
def load_shift_plan(spark, sf_dir):
    return rounded(response.plan_load_shift(top_demand(spark, sf_dir)))


SHIFTED = (
    "sh",
    """SELECT k.*, coalesce(d, 0e0) AS shift_change FROM k LEFT JOIN (
  SELECT series, ts, sum(d) AS d FROM (
    SELECT series, ts, -shiftable_demand AS d FROM pl
    UNION ALL SELECT series, shift_time, shiftable_demand FROM pl) GROUP BY 1, 2) n
ON k.series = n.series AND k.ts = n.ts""",
)


@query(
    "load_shift_applied",
    with_views("hourly", TOP, TARGETS, PLAN, SHIFTED)
    + """SELECT series, ts, round(shift_change, 5) AS shift_change,
  round(heat_demand_total + shift_change, 5) AS adjusted_demand FROM sh""",
)
def load_shift_applied(spark, sf_dir):
    marked = top_demand(spark, sf_dir)
    shifted = response.apply_shift(marked, response.plan_load_shift(marked))
    return rounded(shifted.select("series", "ts", "shift_change", "adjusted_demand"), 5)


_FRAME = "(PARTITION BY series ORDER BY ts ROWS 167 PRECEDING)"


@query(
    "load_shift_impact",
    with_views(
        "hourly",
        TOP,
        TARGETS,
        PLAN,
        SHIFTED,
        ("aj", "SELECT *, heat_demand_total + shift_change AS adj FROM sh"),
        (
            "b",
            f"""SELECT *, coalesce(adj >= CASE WHEN count(adj) OVER {_FRAME} = 168
    THEN quantile_cont(adj, 0.9) OVER {_FRAME} END
  AND cop_average <= CASE WHEN count(cop_average) OVER {_FRAME} = 168
    THEN quantile_cont(cop_average, 0.1) OVER {_FRAME} END, false)::INT AS after FROM aj""",
        ),
        (
            "g",
            """SELECT series, sum(stress_hour)::BIGINT AS n, sum(after)::BIGINT AS m,
  sum(shift_change) AS ch FROM b GROUP BY 1""",
        ),
        (
            "mv",
            "SELECT series, count(*) AS acts, avg(shiftable_demand) AS mean FROM pl GROUP BY 1",
        ),
    )
    + """SELECT g.series, n AS stress_hours_original, m AS stress_hours_after_dr,
  n - m AS stress_reduction, round((n - m) / n * 100, 6) AS stress_reduction_percentage,
  abs(round(ch, 4)) AS total_demand_change, coalesce(acts, 0) AS dr_actions_count,
  round(coalesce(mean, 0e0), 5) AS average_demand_shift FROM g LEFT JOIN mv USING (series)""",
)
def load_shift_impact(spark, sf_dir):
    table = response.shift_impact(top_demand(spark, sf_dir), window=168, layout=SMALL_CHUNKS)
    return table.select(
        "series",
        "stress_hours_original",
        "stress_hours_after_dr",
        "stress_reduction",
        F.round("stress_reduction_percentage", 6).alias("stress_reduction_percentage"),
        F.abs(F.round("total_demand_change", 4)).alias("total_demand_change"),
        "dr_actions_count",
        F.round("average_demand_shift", 5).alias("average_demand_shift"),
    )


PROBABILITY = ("h", "SELECT *, round((5e0 - cop_average) / 2.5e0, 6) AS y_proba FROM hourly")
SCENARIO_SQL = (
    "sc",
    """SELECT * FROM (VALUES ('conservative', 0.6e0, 0.1e0), ('moderate', 0.7e0, 0.15e0),
  ('aggressive', 0.8e0, 0.2e0)) v(scenario, tau, alpha)""",
)


def triggered(*keys: str) -> tuple[str, str]:
    group = ", ".join((*keys, "scenario", "tau", "alpha"))
    return (
        "e",
        f"""SELECT {group}, count_if(y_proba >= tau)::BIGINT AS interventions,
  sum(heat_demand_total) * alpha * count_if(y_proba >= tau) / count(*) AS shifted_energy,
  sum(heat_demand_total) AS total
FROM h, sc WHERE hour(ts) BETWEEN 17 AND 21 GROUP BY {group}""",
    )


PERCENT = "shifted_energy / total * 100"


def with_probability(spark, sf_dir):
    return hourly(spark, sf_dir).withColumn(
        "y_proba", F.round((5 - F.col("cop_average")) / 2.5, 6)
    )


@query(
    "peak_trigger",
    with_views("hourly", PROBABILITY, SCENARIO_SQL, triggered("series"))
    + f"""SELECT series, scenario, tau, alpha, interventions, round(shifted_energy, 5) AS shifted_energy,
  round({PERCENT}, 8) AS peak_reduction_percent FROM e WHERE scenario = 'conservative'""",
)
def peak_trigger(spark, sf_dir):
    table = response.trigger_estimates(
        with_probability(spark, sf_dir), response.SCENARIOS[:1], keys=["series"]
    )
    return table.withColumn("shifted_energy", F.round("shifted_energy", 5)).withColumn(
        "peak_reduction_percent", F.round("peak_reduction_percent", 8)
    )


@query(
    "peak_scenarios",
    with_views("hourly", PROBABILITY, SCENARIO_SQL, triggered())
    + f"""SELECT scenario, tau, alpha, interventions, round(shifted_energy, 4) AS shifted_energy,
  round({PERCENT}, 8) AS peak_reduction_percent FROM e""",
)
def peak_scenarios(spark, sf_dir):
    table = response.trigger_estimates(with_probability(spark, sf_dir))
    return table.withColumn("shifted_energy", F.round("shifted_energy", 4)).withColumn(
        "peak_reduction_percent", F.round("peak_reduction_percent", 8)
    )


@query(
    "peak_trigger_empty",
    """SELECT 'conservative' AS scenario, 0.6e0 AS tau, 0.1e0 AS alpha, 0::BIGINT AS interventions,
  0e0 AS shifted_energy, 0e0 AS peak_reduction_percent FROM orders
WHERE hour(o_orderdate::TIMESTAMP) < 17 GROUP BY 1""",
)
def peak_trigger_empty(spark, sf_dir):
    """Daily rows are all at midnight, so there is no peak hour: zeros."""
    rows = daily(spark, sf_dir).withColumn("y_proba", F.lit(0.9))
    return response.trigger_estimates(rows, response.SCENARIOS[:1])


TAUS, ALPHAS = (0.5, 0.6, 0.7, 0.8, 0.9), (0.05, 0.1, 0.15, 0.2)
GRID_SQL = (
    "sc",
    "SELECT * FROM (VALUES "
    + ", ".join(
        [f"('threshold', {t}e0, 0.1e0)" for t in TAUS] + [f"('shift', 0.6e0, {a}e0)" for a in ALPHAS]
    )
    + ") v(scenario, tau, alpha)",
)


@query(
    "sensitivity_curves",
    with_views("hourly", PROBABILITY, GRID_SQL, triggered())
    + f"""SELECT scenario AS curve, tau, alpha, interventions, round(shifted_energy, 4) AS shifted_energy,
  round({PERCENT}, 8) AS peak_reduction_percent FROM e""",
)
def sensitivity_curves(spark, sf_dir):
    table = response.sensitivity(with_probability(spark, sf_dir), TAUS, ALPHAS)
    return table.withColumn("shifted_energy", F.round("shifted_energy", 4)).withColumn(
        "peak_reduction_percent", F.round("peak_reduction_percent", 8)
    )


@query(
    "response_table",
    with_views("hourly", PROBABILITY, SCENARIO_SQL, triggered())
    + f"""SELECT upper(scenario[1]) || scenario[2:] AS "Scenario", interventions AS "Interventions",
  printf('%.3f', {PERCENT}) AS "Peak Reduction (%)",
  printf('%.6f', {PERCENT} / interventions) AS "Efficiency (Reduction/Intervention)",
  printf('%.4f%%', {PERCENT} / interventions) AS "Average Reduction per Intervention" FROM e""",
)
def response_table(spark, sf_dir):
    return response.response_table(response.trigger_estimates(with_probability(spark, sf_dir)))


@query(
    "impact_table",
    with_views("hourly", *WEEK, *adjusted_sql(CHANGE["conservative"]))
    + """SELECT series AS "Scenario", 0.6e0 AS "Threshold", 0.1e0 AS "Shift Fraction",
  printf('%.1f', coalesce((n - CASE WHEN n > 0 THEN m ELSE 0 END) / nullif(n, 0) * 100, 0e0))
    AS "Peak Reduction (%)",
  printf('%.1f', n / days) AS "Interventions/Day", n AS "Total Actions"
FROM (SELECT series, sum(stress_hour)::BIGINT AS n, sum(after)::BIGINT AS m,
        count(DISTINCT ts::DATE) AS days FROM b GROUP BY 1)""",
)
def impact_table(spark, sf_dir):
    days = hourly(spark, sf_dir).groupBy("series").agg(
        F.count_distinct(F.to_date("ts")).alias("days")
    )
    impacts = response.response_impact(
        labelled(spark, sf_dir), "conservative", window=168, layout=SMALL_CHUNKS
    ).join(days, "series")
    return response.impact_table(
        impacts.withColumnsRenamed({"series": "scenario"})
        .withColumn("threshold", F.lit(0.6))
        .withColumn("shift_fraction", F.lit(0.1))
        .withColumn("interventions_per_day", F.col("dr_actions_count") / F.col("days"))
    )


@query(
    "scenario_comparison",
    with_views("hourly", PROBABILITY, SCENARIO_SQL, triggered())
    + f"""SELECT scenario, round({PERCENT}, 8) AS peak_reduction_percent, interventions,
  round({PERCENT} / interventions, 8) AS efficiency,
  round({PERCENT} / max({PERCENT}) OVER (), 8) AS peak_reduction_norm,
  round(interventions / max(interventions) OVER (), 8) AS interventions_norm,
  round(({PERCENT} / interventions) / max({PERCENT} / interventions) OVER (), 8) AS efficiency_norm
FROM e""",
)
def scenario_comparison(spark, sf_dir):
    return rounded(
        response.compare_scenarios(response.trigger_estimates(with_probability(spark, sf_dir))), 8
    )


@query(
    "reduction_trend",
    with_views("hourly", PROBABILITY, SCENARIO_SQL, triggered())
    + f"""SELECT round(regr_slope({PERCENT}, interventions), 8) AS slope,
  round(regr_intercept({PERCENT}, interventions), 8) AS intercept FROM e""",
)
def reduction_trend(spark, sf_dir):
    return rounded(
        response.reduction_trend(response.trigger_estimates(with_probability(spark, sf_dir))), 8
    )


@query(
    "response_curves",
    with_views(
        "daily",
        (
            "c",
            """SELECT series, heat_demand_total AS demand, row_number() OVER (PARTITION BY series
  ORDER BY heat_demand_total DESC, ts) - 1 AS rank FROM daily""",
        ),
    )
    + """SELECT series, scenario, rank, demand, round(demand * (1 - f * 0.5e0), 4) AS demand_after
FROM c, (VALUES ('conservative', 0.1e0), ('aggressive', 0.2e0)) s(scenario, f)""",
)
def response_curves(spark, sf_dir):
    scenarios = [
        {"scenario": "conservative", "shift_fraction": 0.1},
        {"scenario": "aggressive", "shift_fraction": 0.2},
    ]
    return curves.response_curves(daily(spark, sf_dir), scenarios).withColumn(
        "demand_after", F.round("demand_after", 4)
    )


