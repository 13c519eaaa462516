"""Queries for imputation, scaling, outliers and composed preprocessing."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridload.plans.fixtures import daily, gaps, hourly, with_views
from gridload.plans.registry import query, rounded
from gridload.plans.series_queries import DAILY_CHUNKS, SEASON, SMALL_CHUNKS
from gridload.prep import features
from gridload.prep.isolation import IsolationForest
from gridload.prep.neighbours import knn_impute
from gridload.prep.steps import FillStatistic, Scale

MEASURES = ["heat_demand_total", "cop_average"]
TWO_GAPS = (
    "gg",
    """SELECT series, ts, heat_demand_total,
  CASE WHEN hour(ts) = 11 THEN NULL ELSE cop_average END AS cop_average, hour(ts)::DOUBLE AS hour
FROM gaps""",
)


def two_gaps(spark, sf_dir):
    h = F.hour("ts")
    return (
        gaps(spark, sf_dir)
        .withColumn("cop_average", F.when(h != 11, F.col("cop_average")))
        .withColumn("hour", h.cast("double"))
    )


def knn_sql(column: str, view: str = "gg") -> str:
    cols = ("heat_demand_total", "cop_average", "hour")
    shared = " + ".join(f"(a.{c} IS NOT NULL AND b.{c} IS NOT NULL)::INT" for c in cols)
    total = " + ".join(f"coalesce((a.{c} - b.{c}) * (a.{c} - b.{c}), 0e0)" for c in cols)
    return f"""SELECT series, ts, avg(v) AS v FROM (
  SELECT a.series, a.ts, b.{column} AS v, row_number() OVER (PARTITION BY a.series, a.ts
    ORDER BY ({total}) * (3e0 / ({shared})), b.ts) AS r
  FROM {view} a JOIN {view} b ON a.series = b.series AND b.{column} IS NOT NULL
  WHERE a.{column} IS NULL) WHERE r <= 5 GROUP BY 1, 2"""


@query(
    "knn_impute",
    with_views(
        "gaps", TWO_GAPS, ("kd", knn_sql("heat_demand_total")), ("kc", knn_sql("cop_average"))
    )
    + """SELECT gg.series, gg.ts, round(coalesce(heat_demand_total, kd.v), 5) AS heat_demand_total,
  round(coalesce(cop_average, kc.v), 5) AS cop_average, hour FROM gg
LEFT JOIN kd ON gg.series = kd.series AND gg.ts = kd.ts
LEFT JOIN kc ON gg.series = kc.series AND gg.ts = kc.ts""",
)
def knn_impute_query(spark, sf_dir):
    filled = knn_impute(
        two_gaps(spark, sf_dir), [*MEASURES, "hour"], layout=SMALL_CHUNKS, tile_rows=256
    )
    return rounded(filled, 5)


def _scattered_gap(column: str) -> str:
    stamp = f"series || strftime(ts, '%Y-%m-%d %H') || '{column}'"
    return f"CASE WHEN substr(md5({stamp}), 1, 2) >= '0d' THEN {column} END AS {column}"


SCATTERED = (
    "sg",
    "SELECT series, ts, " + ", ".join(_scattered_gap(c) for c in MEASURES) + ", hour(ts)::INT AS hour FROM hourly",
)


@query(
    "knn_impute_scattered",
    with_views(
        "hourly",
        SCATTERED,
        ("kd", knn_sql("heat_demand_total", "sg")),
        ("kc", knn_sql("cop_average", "sg")),
    )
    + """SELECT sg.series, sg.ts, round(coalesce(heat_demand_total, kd.v), 5) AS heat_demand_total,
  round(coalesce(cop_average, kc.v), 5) AS cop_average, hour FROM sg
LEFT JOIN kd ON sg.series = kd.series AND sg.ts = kd.ts
LEFT JOIN kc ON sg.series = kc.series AND sg.ts = kc.ts""",
)
def knn_impute_scattered(spark, sf_dir):
    """A twentieth of the cells of two columns is missing at random."""

    def gap(c):
        stamp = F.concat("series", F.date_format("ts", "yyyy-MM-dd HH"), F.lit(c))
        return F.when(F.substring(F.md5(stamp), 1, 2) >= "0d", F.col(c)).alias(c)

    rows = hourly(spark, sf_dir).select(
        "series", "ts", *[gap(c) for c in MEASURES], F.hour("ts").alias("hour")
    )
    filled = knn_impute(rows, [*MEASURES, "hour"], layout=SMALL_CHUNKS, tile_rows=256)
    return rounded(filled, 5)


@query(
    "mean_impute",
    with_views("gaps", ("m", "SELECT avg(heat_demand_total) AS d FROM gaps"))
    + """SELECT series, ts, round(coalesce(heat_demand_total, d), 6) AS heat_demand_total, cop_average
FROM gaps, m""",
)
def mean_impute(spark, sf_dir):
    rows = gaps(spark, sf_dir)
    return rounded(FillStatistic("mean").fit(rows).transform(rows))


@query(
    "median_impute_unseen",
    with_views(
        "gaps",
        ("m", "SELECT median(heat_demand_total) AS d FROM gaps WHERE ts < '2024-01-16'"),
    )
    + """SELECT series, ts, round(coalesce(heat_demand_total, d), 6) AS heat_demand_total, cop_average
FROM gaps, m WHERE ts >= '2024-01-16'""",
)
def median_impute_unseen(spark, sf_dir):
    """Medians of the first half of the month fill the second half."""
    rows = gaps(spark, sf_dir)
    middle = F.lit("2024-01-16").cast("timestamp_ntz")
    model = FillStatistic("median").fit(rows.filter(F.col("ts") < middle))
    return rounded(model.transform(rows.filter(F.col("ts") >= middle)))


LAGGED = (
    "lg",
    """SELECT series, ts, heat_demand_total,
  lag(heat_demand_total) OVER s AS demand_lag_1h, lag(cop_average) OVER s AS cop_lag_1h
FROM hourly WINDOW s AS (PARTITION BY series ORDER BY ts)""",
)


def lagged(spark, sf_dir):
    from gridload.operators.rolling import lag
    from gridload.operators.ordering import with_series_windows

    return with_series_windows(
        hourly(spark, sf_dir),
        1,
        lambda win: {
            "demand_lag_1h": lag("heat_demand_total", 1, win),
            "cop_lag_1h": lag("cop_average", 1, win),
        },
        SMALL_CHUNKS,
    ).drop("cop_average")


def scale_sql(centre: str, spread: str) -> str:
    parts = ", ".join(
        f"""round(({c} - (SELECT {centre.format(c=c)} FROM lg)) / (SELECT {spread.format(c=c)} FROM lg), 6)
  AS {c}"""
        for c in ("demand_lag_1h", "cop_lag_1h")
    )
    return with_views("hourly", LAGGED) + f"SELECT series, ts, heat_demand_total, {parts} FROM lg"


SCALES = {
    "robust": ("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"),
    "standard": ("avg({c})", "stddev_pop({c})"),
    "minmax": ("min({c})", "max({c}) - min({c})"),
}


def scaled(method):
    def run(spark, sf_dir):
        rows = lagged(spark, sf_dir)
        return rounded(Scale(method).fit(rows).transform(rows))

    return run


for _method, _parts in SCALES.items():
    query(f"scale_{_method}", scale_sql(*_parts))(scaled(_method))


@query("outlier_removal")
def outlier_removal(spark, sf_dir):
    """Isolation forest over all hours; about a tenth of the rows go."""
    rows = hourly(spark, sf_dir).withColumn("hour", F.hour("ts"))
    return IsolationForest([*MEASURES, "hour"]).fit(rows).transform(rows)


@query("outlier_scores")
def outlier_scores(spark, sf_dir):
    rows = daily(spark, sf_dir)
    return IsolationForest(MEASURES).fit(rows).flag(rows).select(
        "series", "ts", "anomaly_score", "is_outlier"
    )


@query("preprocess")
def preprocess(spark, sf_dir):
    steps = features.Preprocessor(layout=SMALL_CHUNKS)
    return steps.fit_transform(gaps(spark, sf_dir))[0]


FRAME = "(PARTITION BY series ORDER BY ts ROWS 23 PRECEDING)"


@query(
    "label_and_summarise",
    with_views("hourly")
    + f"""SELECT series, ts, hour(ts)::INT AS hour, (isodow(ts) >= 6)::INT AS is_weekend,
  1 AS is_winter, 0 AS is_summer,
  CASE WHEN count(*) OVER w = 24 THEN max(heat_demand_total) OVER w END AS demand_rolling_max_24h,
  CASE WHEN count(*) OVER w = 24 THEN min(cop_average) OVER w END AS cop_rolling_min_24h,
  lag(heat_demand_total, 24) OVER s AS demand_lag_24h,
  coalesce(heat_demand_total >= CASE WHEN count(*) OVER v = 168
      THEN quantile_cont(heat_demand_total, 0.9) OVER v END
    AND cop_average <= CASE WHEN count(*) OVER v = 168
      THEN quantile_cont(cop_average, 0.1) OVER v END, false)::INT AS stress_hour
FROM hourly WINDOW s AS (PARTITION BY series ORDER BY ts), w AS {FRAME},
  v AS (PARTITION BY series ORDER BY ts ROWS 167 PRECEDING)""",
)
def label_and_summarise(spark, sf_dir):
    built = features.label_and_summarise(hourly(spark, sf_dir), SMALL_CHUNKS)
    return built.select(
        "series", "ts", "hour", "is_weekend", "is_winter", "is_summer",
        "demand_rolling_max_24h", "cop_rolling_min_24h", "demand_lag_24h", "stress_hour",
    )


@query(
    "engineer_features",
    with_views("hourly")
    + """SELECT series, ts, (isodow(ts) - 1)::INT AS day_of_week,
  round(sin(2e0 * pi() * hour(ts) / 24e0), 9) + 0e0 AS hour_sin,
  CASE WHEN count(*) OVER w = 24 THEN round(avg(cop_average) OVER w, 8) END
    AS cop_average_rolling_mean_24h,
  CASE WHEN count(*) OVER v = 168 THEN round(quantile_cont(heat_demand_total, 0.9) OVER v, 6) END
    AS heat_demand_total_rolling_p90_168h,
  lag(cop_average, 24) OVER s AS cop_average_lag_24h,
  round(heat_demand_total / nullif(cop_average, 0), 6) AS demand_cop_ratio,
  heat_demand_total * (hour(ts) BETWEEN 17 AND 21)::INT AS peak_demand
FROM hourly WINDOW s AS (PARTITION BY series ORDER BY ts),
  w AS (PARTITION BY series ORDER BY ts ROWS 23 PRECEDING),
  v AS (PARTITION BY series ORDER BY ts ROWS 167 PRECEDING)""",
)
def engineer_features(spark, sf_dir):
    built = features.engineer(hourly(spark, sf_dir), layout=SMALL_CHUNKS)
    return built.select(
        "series",
        "ts",
        "day_of_week",
        (F.round("hour_sin", 9) + 0.0).alias("hour_sin"),
        F.round("cop_average_rolling_mean_24h", 8).alias("cop_average_rolling_mean_24h"),
        F.round("heat_demand_total_rolling_p90_168h", 6).alias(
            "heat_demand_total_rolling_p90_168h"
        ),
        "cop_average_lag_24h",
        F.round("demand_cop_ratio", 6).alias("demand_cop_ratio"),
        "peak_demand",
    )


@query("process_table")
def process_table(spark, sf_dir):
    steps = features.Preprocessor(imputation="median", layout=SMALL_CHUNKS)
    built, _ = features.process(hourly(spark, sf_dir), steps)
    return built


@query(
    "analysis_features",
    with_views(
        "daily",
        ("d", f"SELECT *, {SEASON} AS season FROM daily"),
        (
            "thr",
            """SELECT series, season, quantile_cont(heat_demand_total, 0.9) AS dp,
  quantile_cont(cop_average, 0.2) AS cp FROM d GROUP BY 1, 2""",
        ),
        (
            "lb",
            """SELECT d.*, (heat_demand_total > dp AND cop_average < cp)::INT AS stress_hour
FROM d JOIN thr ON d.series = thr.series AND d.season = thr.season""",
        ),
    )
    + """SELECT series, ts, hour(ts)::INT AS hour, (isodow(ts) - 1)::INT AS weekday,
  month(ts)::INT AS month, (month(ts) IN (12, 1, 2))::INT AS is_winter,
  max(heat_demand_total) OVER a AS demand_max_24, max(heat_demand_total) OVER c AS demand_max_168,
  min(cop_average) OVER a AS cop_min_24, min(cop_average) OVER c AS cop_min_168,
  coalesce(lag(stress_hour, 1) OVER s, 0) AS stress_lag_1,
  coalesce(lag(stress_hour, 24) OVER s, 0) AS stress_lag_24, stress_hour,
  round(avg(heat_demand_total) OVER a / 1000, 3) AS demand_ma_24,
  round(avg(heat_demand_total) OVER c / 1000, 3) AS demand_ma_168
FROM lb WINDOW s AS (PARTITION BY series ORDER BY ts),
  a AS (PARTITION BY series ORDER BY ts ROWS 23 PRECEDING),
  c AS (PARTITION BY series ORDER BY ts ROWS 167 PRECEDING)""",
)
def analysis_features(spark, sf_dir):
    built = features.analysis_features(daily(spark, sf_dir), layout=DAILY_CHUNKS)
    return built.select(
        "series",
        "ts",
        *[c for c in features.ANALYSIS_FEATURES if not c.startswith("demand_ma_")],
        "stress_hour",
        *[
            F.round(F.col(c) / 1000, 3).alias(c)
            for c in features.ANALYSIS_FEATURES
            if c.startswith("demand_ma_")
        ],
    )


