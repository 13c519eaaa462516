"""Queries for data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridload.operators import checks, metrics, stress
from gridload.plans.fixtures import gaps, hourly, models, with_views
from gridload.plans.registry import query, rounded
from gridload.plans.response_queries import WEEK
from gridload.plans.scoring_queries import COUNTS, METRIC_SQL, PREDICTED, predicted
from gridload.plans.series_queries import SMALL_CHUNKS

FINDING = """SELECT "check", severity, "column", round(value, 6) AS value FROM ({rows}) WHERE applies"""


def findings(*rows: tuple[str, str, str | None, str, str]) -> str:
    """One SELECT per finding over the one-row CTE ``a``; ``$`` is the value."""
    parts = []
    for check, severity, column, value, condition in rows:
        name = "NULL::VARCHAR" if column is None else f"'{column}'"
        parts.append(
            f"""SELECT '{check}' AS "check", '{severity}' AS severity, {name} AS "column",
  ({value})::DOUBLE AS value, {condition.replace("$", f"({value})")} AS applies FROM a"""
        )
    return FINDING.format(rows=" UNION ALL ".join(parts))


BROKEN = (
    "g",
    """SELECT series, ts, CASE WHEN hour(ts) = 3 THEN -heat_demand_total ELSE heat_demand_total * 4000 END
  AS heat_demand_total, CASE WHEN hour(ts) = 5 THEN 0.5e0 WHEN hour(ts) = 7 THEN 'inf'::DOUBLE
  ELSE cop_average END AS cop_average FROM gaps""",
)


def broken(spark, sf_dir):
    """``gaps`` with negative and huge demand, tiny and infinite COP."""
    h = F.hour("ts")
    return gaps(spark, sf_dir).select(
        "series",
        "ts",
        F.when(h == 3, -F.col("heat_demand_total"))
        .otherwise(F.col("heat_demand_total") * 4000)
        .alias("heat_demand_total"),
        F.when(h == 5, F.lit(0.5))
        .when(h == 7, F.lit(float("inf")))
        .otherwise(F.col("cop_average"))
        .alias("cop_average"),
    )


BASE = (
    "a",
    """SELECT count(*) AS n, count_if(heat_demand_total IS NULL) AS md, count_if(cop_average IS NULL) AS mc,
  count_if(isinf(heat_demand_total)) AS infd, count_if(isinf(cop_average)) AS infc,
  epoch(min(ts)) AS t0, epoch(max(ts)) AS t1,
  count_if(heat_demand_total < 0) AS neg, count_if(heat_demand_total > 1e6) AS huge,
  count_if(cop_average < 1) AS low, count_if(cop_average > 10) AS high FROM g""",
)


@query(
    "check_loaded",
    with_views("gaps", BROKEN, BASE)
    + findings(
        ("empty", "fatal", None, "n", "$ = 0"),
        ("total_rows", "info", None, "n", "$ > 0"),
        ("total_columns", "info", None, "4", "n > 0"),
        ("first_time", "info", "ts", "t0", "n > 0"),
        ("last_time", "info", "ts", "t1", "n > 0"),
        *[
            (check, severity, c, v, condition)
            for c, v in (
                ("series", "0"), ("ts", "0"), ("heat_demand_total", "md"), ("cop_average", "mc")
            )
            for check, severity, condition in (
                ("missing_cells", "info", "n > 0"),
                ("many_missing", "warning", "$ > n * 0.1"),
            )
        ],
        ("infinite", "warning", "heat_demand_total", "infd", "$ > 0"),
        ("infinite", "warning", "cop_average", "infc", "$ > 0"),
    ),
)
def check_loaded(spark, sf_dir):
    return rounded(checks.check_loaded(broken(spark, sf_dir)))


@query(
    "check_raw",
    with_views("gaps", ("g", BROKEN[1].replace("'inf'::DOUBLE", "99e0")), BASE)
    + findings(
        ("empty", "fatal", None, "n", "$ = 0"),
        ("total_rows", "info", None, "n", "$ > 0"),
        ("total_columns", "info", None, "4", "n > 0"),
        ("negative_demand", "warning", "heat_demand_total", "neg", "$ > 0"),
        ("huge_demand", "warning", "heat_demand_total", "huge", "$ > 0"),
        ("cop_too_low", "warning", "cop_average", "low", "$ > 0"),
        ("cop_too_high", "warning", "cop_average", "high", "$ > 0"),
        *[
            (check, severity, c, v, condition)
            for c, v in (
                ("series", "0"),
                ("ts", "0"),
                ("heat_demand_total", "md / n"),
                ("cop_average", "mc / n"),
            )
            for check, severity, condition in (
                ("missing_ratio", "info", "n > 0"),
                ("high_missing_ratio", "warning", "$ > 0.05"),
            )
        ],
        *[
            (name, "info", c, f"(SELECT {fn}({c}) FROM g)", "n > 0")
            for c in ("heat_demand_total", "cop_average")
            for name, fn in (
                ("min", "min"), ("max", "max"), ("mean", "avg"), ("std", "stddev_samp")
            )
        ],
    ).replace("round(value, 6)", "round(value, 4)"),
)
def check_raw(spark, sf_dir):
    finite = broken(spark, sf_dir).withColumn(
        "cop_average",
        F.when(F.col("cop_average") == float("inf"), 99.0).otherwise(F.col("cop_average")),
    )
    return rounded(checks.check_raw(finite, max_missing_ratio=0.05), 4)


LABELLED = (
    "a",
    """SELECT count(*) AS n, avg(stress_hour) AS rate, sum(stress_hour) AS hours,
  count_if(heat_demand_total IS NULL) AS md FROM l""",
)


@query(
    "check_processed",
    with_views("hourly", *WEEK, LABELLED)
    + findings(
        ("low_stress_rate", "warning", "stress_hour", "rate", "$ < 0.001"),
        ("high_stress_rate", "warning", "stress_hour", "rate", "$ > 0.5"),
        ("total_rows", "info", None, "n", "n >= 0"),
        ("total_columns", "info", None, "9", "n >= 0"),
        ("stress_rate", "info", "stress_hour", "rate", "n > 0"),
        ("stress_hours", "info", "stress_hour", "hours", "n > 0"),
        ("feature_columns", "info", None, "6", "n >= 0"),
        ("missing_critical", "issue", "heat_demand_total", "md", "$ > 0"),
    ),
)
def check_processed(spark, sf_dir):
    labelled = stress.label_dynamic(hourly(spark, sf_dir), layout=SMALL_CHUNKS)
    return rounded(checks.check_processed(labelled))


@query(
    "check_model_inputs",
    with_views(
        "gaps",
        (
            "a",
            """SELECT count(*) AS n, count_if(heat_demand_total IS NULL) AS md,
  count_if(cop_average < 2.6) AS n1, count_if(cop_average >= 2.6) AS n0 FROM gaps""",
        ),
    )
    + findings(
        ("length_mismatch", "fatal", None, "0", "$ <> 0"),
        ("empty_features", "fatal", None, "n", "$ = 0"),
        ("empty_target", "fatal", "y", "n", "$ = 0"),
        ("single_class", "warning", "y", "(n0 > 0)::INT + (n1 > 0)::INT", "$ < 2"),
        ("extreme_imbalance", "warning", "y", "coalesce(n1 / nullif(n0, 0), 0)", "$ < 0.01"),
        ("n_samples", "info", None, "n", "n >= 0"),
        ("n_features", "info", None, "2", "n >= 0"),
        ("n_classes", "info", "y", "(n0 > 0)::INT + (n1 > 0)::INT", "n >= 0"),
        ("class_0", "info", "y", "n0", "n >= 0"),
        ("class_1", "info", "y", "n1", "n >= 0"),
        ("class_ratio", "info", "y", "coalesce(n1 / nullif(n0, 0), 0)", "n >= 0"),
        ("missing_feature", "issue", "heat_demand_total", "md", "$ > 0"),
    ),
)
def check_model_inputs(spark, sf_dir):
    rows = gaps(spark, sf_dir).withColumn("y", (F.col("cop_average") < 2.6).cast("int"))
    return rounded(checks.check_model_inputs(rows, ["heat_demand_total", "cop_average"], "y"))


@query(
    "check_results",
    with_views(
        "models",
        PREDICTED,
        COUNTS,
        (
            "a",
            f"""SELECT count(*) AS n, count_if(NOT (2 * {METRIC_SQL["recall"]} BETWEEN 0 AND 1)) AS bad
FROM c""",
        ),
    )
    + findings(
        ("missing_key", "warning", "model_info", "1", "n >= 0"),
        ("out_of_range", "warning", "recall", "bad", "$ > 0"),
        ("missing_metric", "warning", "f1", "1", "n >= 0"),
        ("models", "info", None, "n", "n >= 0"),
    ),
)
def check_results(spark, sf_dir):
    names = ["accuracy", "precision", "recall"]
    table = metrics.label_metrics(predicted(spark, sf_dir), ["model"], names)
    doubled = table.withColumn("recall", F.col("recall") * 2)
    return rounded(checks.check_results(doubled, keys=["metrics"]))


@query(
    "guard_processed",
    with_views("hourly", ("a", "SELECT count(*) AS n FROM hourly"))
    + findings(("low_stress_rate", "warning", "stress_hour", "0", "$ < 0.001")),
)
def guard_processed(spark, sf_dir):
    calm = hourly(spark, sf_dir).withColumn("stress_hour", F.lit(0))
    return rounded(checks.guard_processed(calm))


@query(
    "report_validity",
    with_views("models") + "SELECT count(*) > 0 AS is_valid FROM models",
)
def report_validity(spark, sf_dir):
    rows = models(spark, sf_dir).withColumn("heat_demand_total", F.col("y_proba"))
    return checks.is_valid(checks.check_raw(rows.withColumn("cop_average", F.lit(3.0))))
