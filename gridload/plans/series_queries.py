"""Queries for rolling windows, stress labels, curves and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridload.operators import curves, profile, rolling, stress
from gridload.operators.ordering import SeriesLayout
from gridload.plans.fixtures import EVENT_KINDS, daily, gaps, hourly, wide, with_views
from gridload.plans.registry import query, rounded

KINDS = list(EVENT_KINDS)
# small pieces, so that the queries run the chunked path on the test tables too
SMALL_CHUNKS = SeriesLayout(span_hours=24 * 10, chunk_rows=256)
DAILY_CHUNKS = SeriesLayout(span_hours=24 * 366, chunk_rows=500)


def full(expr: str, column: str, rows: int, name: str, digits: int) -> str:
    frame = f"(PARTITION BY series ORDER BY ts ROWS {rows - 1} PRECEDING)"
    return (
        f"CASE WHEN count({column}) OVER {frame} = {rows} "
        f"THEN round({expr} OVER {frame}, {digits}) END AS {name}"
    )


def rolling_sql(column: str, rows: int, mean_digits: int, tails: bool = True) -> str:
    parts = [
        full(f"avg({column})", column, rows, f"{column}_rolling_mean_{rows}h", mean_digits),
        full(f"stddev_samp({column})", column, rows, f"{column}_rolling_std_{rows}h", 6),
        full(f"max({column})", column, rows, f"{column}_rolling_max_{rows}h", 6),
        full(f"min({column})", column, rows, f"{column}_rolling_min_{rows}h", 6),
    ]
    if tails:
        parts += [
            full(f"quantile_cont({column}, 0.9)", column, rows, f"{column}_rolling_p90_{rows}h", 6),
            full(f"quantile_cont({column}, 0.1)", column, rows, f"{column}_rolling_p10_{rows}h", 6),
        ]
    return ",\n  ".join(parts)


def round_rolling(df, mean_digits: int):
    return df.select(
        "series",
        "ts",
        *[
            F.round(c, mean_digits if "_mean_" in c else 6).alias(c)
            for c in df.columns
            if "_rolling_" in c
        ],
    )


@query(
    "rolling_features",
    with_views("hourly")
    + "SELECT series, ts, "
    + ",\n  ".join(
        rolling_sql(c, n, 8) for c in ("heat_demand_total", "cop_average") for n in (24, 168)
    )
    + " FROM hourly",
)
def rolling_features(spark, sf_dir):
    built = rolling.add_rolling(
        hourly(spark, sf_dir), ["heat_demand_total", "cop_average", "absent"], layout=SMALL_CHUNKS
    )
    return round_rolling(built, 8)


@query(
    "rolling_over_gaps",
    with_views("gaps") + "SELECT series, ts, " + rolling_sql("heat_demand_total", 6, 8) + " FROM gaps",
)
def rolling_over_gaps(spark, sf_dir):
    built = rolling.add_rolling(
        gaps(spark, sf_dir), ["heat_demand_total"], [6], layout=SMALL_CHUNKS
    )
    return round_rolling(built, 8)


@query(
    "rolling_one_piece",
    with_views("hourly") + "SELECT series, ts, " + rolling_sql("cop_average", 24, 8) + " FROM hourly",
)
def rolling_one_piece(spark, sf_dir):
    whole = SeriesLayout(chunk_rows=None)
    return round_rolling(
        rolling.add_rolling(hourly(spark, sf_dir), ["cop_average"], [24], whole), 8
    )


@query(
    "rolling_summary",
    with_views("hourly")
    + "SELECT series, ts, "
    + ",\n  ".join(
        [
            full("avg(heat_demand_total)", "heat_demand_total", 24, "demand_rolling_mean_24h", 8),
            full("stddev_samp(heat_demand_total)", "heat_demand_total", 24, "demand_rolling_std_24h", 6),
            full("max(heat_demand_total)", "heat_demand_total", 24, "demand_rolling_max_24h", 6),
            full("avg(cop_average)", "cop_average", 24, "cop_rolling_mean_24h", 8),
            full("min(cop_average)", "cop_average", 24, "cop_rolling_min_24h", 6),
        ]
    )
    + """,
  lag(heat_demand_total, 1) OVER s AS demand_lag_1h, lag(heat_demand_total, 24) OVER s AS demand_lag_24h,
  lag(cop_average, 1) OVER s AS cop_lag_1h, lag(cop_average, 24) OVER s AS cop_lag_24h
FROM hourly WINDOW s AS (PARTITION BY series ORDER BY ts)""",
)
def rolling_summary(spark, sf_dir):
    built = rolling.add_summary(hourly(spark, sf_dir), layout=SMALL_CHUNKS)
    lags = [c for c in built.columns if "_lag_" in c]
    return built.select(
        "series",
        "ts",
        *[
            F.round(c, 8 if "_mean_" in c else 6).alias(c)
            for c in built.columns
            if "_rolling_" in c
        ],
        *lags,
    )


def partial_sql(rows: int) -> str:
    frame = f"(PARTITION BY series ORDER BY ts ROWS {rows - 1} PRECEDING)"
    return (
        f"round(avg(heat_demand_total) OVER {frame}, 3) AS demand_ma_{rows}, "
        f"max(heat_demand_total) OVER {frame} AS demand_max_{rows}, "
        f"min(cop_average) OVER {frame} AS cop_min_{rows}"
    )


@query(
    "rolling_partial",
    with_views("gaps")
    + "SELECT series, ts, "
    + ",\n  ".join(
        f"""round(sum(heat_demand_total) OVER w{n}, 2) / count(heat_demand_total) OVER w{n} AS demand_ma_{n},
  max(heat_demand_total) OVER w{n} AS demand_max_{n}, min(cop_average) OVER w{n} AS cop_min_{n}"""
        for n in (24, 72, 168)
    )
    + " FROM gaps WINDOW "
    + ", ".join(
        f"w{n} AS (PARTITION BY series ORDER BY ts ROWS {n - 1} PRECEDING)" for n in (24, 72, 168)
    ),
)
def rolling_partial(spark, sf_dir):
    from gridload.operators.ordering import with_series_windows

    rows = rolling.add_partial_rolling(gaps(spark, sf_dir), layout=SMALL_CHUNKS)
    # compared as rounded sum over count: a rounded mean may sit on a tie
    counted = with_series_windows(
        rows,
        167,
        lambda win: {
            f"_n{n}": F.count("heat_demand_total").over(win.trailing(n)) for n in (24, 72, 168)
        },
        SMALL_CHUNKS,
    )
    return counted.select(
        "series",
        "ts",
        *[
            (F.round(F.col(f"demand_ma_{n}") * F.col(f"_n{n}"), 2) / F.col(f"_n{n}")).alias(
                f"demand_ma_{n}"
            )
            for n in (24, 72, 168)
        ],
        *[c for c in rows.columns if c.startswith(("demand_max_", "cop_min_"))],
    )


@query(
    "lag_features",
    with_views("daily")
    + """SELECT series, ts, lag(heat_demand_total, 1) OVER s AS heat_demand_total_lag_1h,
  lag(heat_demand_total, 24) OVER s AS heat_demand_total_lag_24h,
  lag(cop_average, 1) OVER s AS cop_average_lag_1h,
  lag(cop_average, 24) OVER s AS cop_average_lag_24h
FROM daily WINDOW s AS (PARTITION BY series ORDER BY ts)""",
)
def lag_features(spark, sf_dir):
    built = rolling.add_lags(daily(spark, sf_dir), layout=DAILY_CHUNKS)
    return built.drop("heat_demand_total", "cop_average")


def dynamic_sql(view: str, rows: int) -> str:
    frame = f"(PARTITION BY series ORDER BY ts ROWS {rows - 1} PRECEDING)"
    return f"""SELECT *,
  CASE WHEN count(heat_demand_total) OVER {frame} = {rows}
    THEN quantile_cont(heat_demand_total, 0.9) OVER {frame} END AS dt,
  CASE WHEN count(cop_average) OVER {frame} = {rows}
    THEN quantile_cont(cop_average, 0.1) OVER {frame} END AS ct
FROM {view}"""


DYNAMIC_FLAGS = """coalesce(heat_demand_total >= dt AND cop_average <= ct, false)::INT AS stress_hour,
  coalesce(heat_demand_total >= dt, false)::INT AS high_demand,
  coalesce(cop_average <= ct, false)::INT AS low_cop"""


@query(
    "stress_dynamic_day",
    with_views("hourly", ("t", dynamic_sql("hourly", 24)))
    + f"""SELECT series, ts, heat_demand_total, cop_average, round(dt, 6) AS demand_threshold,
  round(ct, 6) AS cop_threshold, {DYNAMIC_FLAGS} FROM t""",
)
def stress_dynamic_day(spark, sf_dir):
    return rounded(
        stress.label_dynamic(hourly(spark, sf_dir), window=24, layout=SMALL_CHUNKS)
    )


@query(
    "stress_dynamic_week",
    with_views("daily", ("t", dynamic_sql("daily", 168)))
    + f"""SELECT series, ts, heat_demand_total, cop_average, round(dt, 6) AS demand_threshold,
  round(ct, 6) AS cop_threshold, {DYNAMIC_FLAGS} FROM t""",
)
def stress_dynamic_week(spark, sf_dir):
    return rounded(stress.label_dynamic(daily(spark, sf_dir), layout=DAILY_CHUNKS))


@query(
    "stress_summary",
    with_views("hourly", ("t", dynamic_sql("hourly", 168)), ("l", f"SELECT *, {DYNAMIC_FLAGS} FROM t"))
    + """SELECT series, count(*) AS total_hours, sum(stress_hour)::BIGINT AS stress_hours,
  round(avg(stress_hour), 6) AS stress_rate, round(avg(heat_demand_total), 6) AS avg_demand,
  round(avg(cop_average), 6) AS avg_cop, max(heat_demand_total) AS peak_demand
FROM l GROUP BY series""",
)
def stress_summary(spark, sf_dir):
    """Stress hours and rate per series (the flagship)."""
    labelled = stress.label_dynamic(hourly(spark, sf_dir), layout=SMALL_CHUNKS)
    return rounded(stress.selection_summary(labelled, ["series"]))


@query(
    "stress_label_lags",
    with_views("hourly", ("t", dynamic_sql("hourly", 168)), ("l", f"SELECT *, {DYNAMIC_FLAGS} FROM t"))
    + """SELECT series, ts, stress_hour, coalesce(lag(stress_hour, 1) OVER s, 0) AS stress_lag_1,
  coalesce(lag(stress_hour, 24) OVER s, 0) AS stress_lag_24
FROM l WINDOW s AS (PARTITION BY series ORDER BY ts)""",
)
def stress_label_lags(spark, sf_dir):
    labelled = stress.label_dynamic(hourly(spark, sf_dir), layout=SMALL_CHUNKS)
    return rolling.add_label_lags(labelled, layout=SMALL_CHUNKS).select(
        "series", "ts", "stress_hour", "stress_lag_1", "stress_lag_24"
    )


SEASON = """CASE WHEN month(ts) IN (12, 1, 2) THEN 'winter' WHEN month(ts) <= 5 THEN 'spring'
  WHEN month(ts) <= 8 THEN 'summer' ELSE 'autumn' END"""
SEASONAL = (
    ("d", f"SELECT *, {SEASON} AS season FROM daily"),
    (
        "thr",
        """SELECT series, season, quantile_cont(heat_demand_total, 0.9) AS demand_p90,
  quantile_cont(cop_average, 0.2) AS cop_p20 FROM d GROUP BY 1, 2""",
    ),
)


@query(
    "seasonal_thresholds",
    with_views("daily", *SEASONAL)
    + """SELECT series, season, round(demand_p90, 6) AS demand_p90, round(cop_p20, 6) AS cop_p20
FROM thr""",
)
def seasonal_thresholds(spark, sf_dir):
    return rounded(stress.seasonal_thresholds(daily(spark, sf_dir)))


@query(
    "stress_seasonal",
    with_views("daily", *SEASONAL)
    + """SELECT d.series, ts, d.season, round(demand_p90, 6) AS demand_p90, round(cop_p20, 6) AS cop_p20,
  (heat_demand_total > demand_p90 AND cop_average < cop_p20)::INT AS stress_hour
FROM d LEFT JOIN thr ON d.series = thr.series AND d.season = thr.season""",
)
def stress_seasonal(spark, sf_dir):
    labelled = stress.label_seasonal(daily(spark, sf_dir))
    return rounded(labelled.drop("heat_demand_total", "cop_average"))


@query(
    "stress_rate",
    with_views("daily", *SEASONAL)
    + """SELECT d.series, sum((heat_demand_total > demand_p90 AND cop_average < cop_p20)::INT)::BIGINT
  AS stress_hours,
  round(avg((heat_demand_total > demand_p90 AND cop_average < cop_p20)::INT), 6) AS stress_rate
FROM d JOIN thr ON d.series = thr.series AND d.season = thr.season GROUP BY 1""",
)
def stress_rate(spark, sf_dir):
    return rounded(stress.stress_rate(stress.label_seasonal(daily(spark, sf_dir)), ["series"]))


SELECTION = (
    ("w", "SELECT * FROM hourly WHERE ts >= '2024-01-15' AND ts < '2024-01-22'"),
    (
        "q",
        """SELECT quantile_cont(heat_demand_total, 0.9) AS dp, quantile_cont(cop_average, 0.2) AS cp
FROM w""",
    ),
    (
        "s",
        """SELECT w.*, dp, cp, (heat_demand_total > dp AND cop_average < cp)::INT AS stress_hour
FROM w, q""",
    ),
)


def labelled_week(spark, sf_dir):
    from gridload.operators.select import calendar_week

    return stress.label_selection(calendar_week(hourly(spark, sf_dir), 2024, 1, 15, 21))


@query(
    "stress_selection",
    with_views("hourly", *SELECTION)
    + """SELECT series, ts, heat_demand_total, cop_average, round(dp, 6) AS demand_p90,
  round(cp, 6) AS cop_p20, stress_hour FROM s""",
)
def stress_selection(spark, sf_dir):
    return rounded(labelled_week(spark, sf_dir))


@query(
    "selection_summary",
    with_views("hourly", *SELECTION)
    + """SELECT count(*) AS total_hours, sum(stress_hour)::BIGINT AS stress_hours,
  round(avg(stress_hour), 6) AS stress_rate, round(avg(heat_demand_total), 6) AS avg_demand,
  round(avg(cop_average), 6) AS avg_cop, max(heat_demand_total) AS peak_demand FROM s""",
)
def selection_summary(spark, sf_dir):
    return rounded(stress.selection_summary(labelled_week(spark, sf_dir)))


@query(
    "stress_matrix",
    with_views("hourly", *SELECTION)
    + "SELECT series, ((day(ts) - 15) % 7)::INT AS day, "
    + ", ".join(
        f"max(CASE WHEN hour(ts) = {h} AND stress_hour = 1 THEN 1 ELSE 0 END) AS h{h:02d}"
        for h in range(24)
    )
    + " FROM s GROUP BY 1, 2",
)
def stress_matrix(spark, sf_dir):
    return stress.stress_matrix(labelled_week(spark, sf_dir), ["series"])


@query(
    "efficiency_zones",
    with_views(
        "hourly",
        *SELECTION,
        (
            "n",
            """SELECT series, ts, stress_hour,
  (heat_demand_total - min(heat_demand_total) OVER ())
    / (max(heat_demand_total) OVER () - min(heat_demand_total) OVER ()) AS dn,
  (cop_average - min(cop_average) OVER ())
    / (max(cop_average) OVER () - min(cop_average) OVER ()) AS cn FROM s""",
        ),
    )
    + """SELECT series, ts, stress_hour, round(dn, 6) AS demand_norm, round(cn, 6) AS cop_norm,
  (cn < 0.3e0)::INT AS low_efficiency, (dn > 0.7e0)::INT AS high_demand_zone FROM n""",
)
def efficiency_zones(spark, sf_dir):
    zones = stress.efficiency_zones(labelled_week(spark, sf_dir))
    return rounded(
        zones.drop("heat_demand_total", "cop_average", "demand_p90", "cop_p20")
    )


@query(
    "duration_curve",
    with_views("daily")
    + """SELECT series, heat_demand_total AS demand,
  row_number() OVER (PARTITION BY series ORDER BY heat_demand_total DESC, ts) - 1 AS rank FROM daily""",
)
def duration_curve(spark, sf_dir):
    return curves.duration_curve(daily(spark, sf_dir))


@query(
    "duration_steps",
    with_views("hourly", ("v", "SELECT series, round(heat_demand_total / 50) * 50 AS demand FROM hourly"))
    + """, c AS (SELECT series, demand, count(*) AS hours FROM v GROUP BY 1, 2)
SELECT series, demand, hours,
  (sum(hours) OVER w - hours)::BIGINT AS first_rank, (sum(hours) OVER w - 1)::BIGINT AS last_rank
FROM c WINDOW w AS (PARTITION BY series ORDER BY demand DESC)""",
)
def duration_steps(spark, sf_dir):
    coarse = hourly(spark, sf_dir).withColumn(
        "heat_demand_total", F.round(F.col("heat_demand_total") / 50) * 50
    )
    return curves.duration_steps(coarse)


FLAGGED = (
    "f",
    """SELECT series, ts, (cop_average < 3.2e0 AND dayofyear(ts) % 9 = 0)::INT AS stress_hour,
  row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS r,
  count(*) OVER (PARTITION BY series) AS n FROM daily WHERE month(ts) IN (12, 1, 2)""",
)
WEEK_STARTS = (
    "starts",
    """SELECT series, s.start_row AS start_row,
  row_number() OVER (PARTITION BY series ORDER BY s.start_row) AS example
FROM (SELECT DISTINCT series, unnest(range(0, n - 168, 24)) AS start_row FROM f) s
WHERE EXISTS (SELECT 1 FROM f WHERE f.series = s.series AND f.stress_hour = 1
  AND f.r >= s.start_row AND f.r < s.start_row + 168)""",
)


def flagged_days(spark, sf_dir):
    marked = (F.col("cop_average") < 3.2) & (F.dayofyear("ts") % 9 == 0)
    return daily(spark, sf_dir).withColumn("stress_hour", marked.cast("int"))


@query(
    "stress_weeks",
    with_views("daily", FLAGGED, WEEK_STARTS)
    + "SELECT series, start_row, example::INT AS example FROM starts WHERE example <= 3",
)
def stress_weeks(spark, sf_dir):
    return curves.stress_week_starts(flagged_days(spark, sf_dir), layout=DAILY_CHUNKS)


@query(
    "example_week",
    with_views("daily", FLAGGED, WEEK_STARTS)
    + """, short AS (SELECT series, ts FROM daily
  WHERE series NOT IN (SELECT series FROM f WHERE n >= 168)
  QUALIFY row_number() OVER (PARTITION BY series ORDER BY ts) <= 168)
SELECT f.series, f.ts FROM f LEFT JOIN (SELECT * FROM starts WHERE example = 1) b
  ON f.series = b.series
WHERE n >= 168 AND r >= coalesce(start_row, 0) AND r < coalesce(start_row, 0) + 168
UNION ALL SELECT series, ts FROM short""",
)
def example_week(spark, sf_dir):
    return curves.example_week(flagged_days(spark, sf_dir), layout=DAILY_CHUNKS).select(
        "series", "ts"
    )


@query(
    "class_distribution",
    with_views("scored", ("c", "SELECT y_true AS class, count(*) AS n FROM scored GROUP BY 1"))
    + """SELECT class, n AS count, round(n / sum(n) OVER () * 100, 6) AS percentage,
  round(max(n) OVER () / min(n) OVER (), 6) AS imbalance_ratio,
  round(min(n) OVER () / sum(n) OVER (), 6) AS minority_class_rate FROM c""",
)
def class_distribution(spark, sf_dir):
    from gridload.plans.fixtures import scored

    return rounded(profile.class_distribution(scored(spark, sf_dir)))


@query(
    "yearly_completeness",
    with_views("daily")
    + """SELECT series, year(ts)::INT AS year, count(*) AS hours,
  (CASE WHEN year(ts) % 4 = 0 THEN 8784 ELSE 8760 END)::INT AS expected,
  round(count(*) / CASE WHEN year(ts) % 4 = 0 THEN 8784 ELSE 8760 END * 100, 6) AS completeness
FROM daily GROUP BY series, year(ts)""",
)
def yearly_completeness(spark, sf_dir):
    return rounded(profile.yearly_completeness(daily(spark, sf_dir), ["series"]))


CELLS = (
    "cells",
    """SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS series,
  unnest([click, error, purchase, signup, "view"]) AS v FROM gw""",
)
GAP_WIDE = (
    "gw",
    "SELECT ts, "
    + ", ".join(
        f"max(CASE WHEN series = '{k}' THEN heat_demand_total END) AS {k}" for k in KINDS
    )
    + " FROM gaps GROUP BY ts",
)


def gap_wide(spark, sf_dir):
    return gaps(spark, sf_dir).groupBy("ts").pivot("series", KINDS).agg(F.max("heat_demand_total"))


@query(
    "demand_profile",
    with_views("gaps", GAP_WIDE, CELLS)
    + """SELECT count(*) AS cells, count_if(v IS NULL)::BIGINT AS missing, min(v) AS min_value,
  max(v) AS max_value, count_if(v < 0)::BIGINT AS negative,
  round(count_if(v IS NULL) / count(*) * 100, 6) AS missing_pct FROM cells""",
)
def demand_profile(spark, sf_dir):
    return rounded(profile.demand_profile(gap_wide(spark, sf_dir), KINDS))


@query(
    "missing_by_region",
    with_views("gaps", GAP_WIDE, CELLS)
    + """SELECT series, count_if(v IS NULL)::BIGINT AS missing FROM cells GROUP BY 1
ORDER BY 2 DESC, 1 LIMIT 10""",
)
def missing_by_region(spark, sf_dir):
    return profile.missing_by_column(gap_wide(spark, sf_dir), KINDS)


COP_WIDE = (
    "cw",
    "SELECT ts, "
    + ", ".join(f"max(CASE WHEN series = '{k}' THEN cop_average END) AS {k}" for k in KINDS)
    + " FROM hourly GROUP BY ts",
)


@query(
    "cop_profile",
    with_views(
        "hourly",
        COP_WIDE,
        (CELLS[0], CELLS[1].replace("gw", "cw")),
        (
            "p",
            """SELECT series, count_if(v IS NULL) AS missing, min(v) AS lo, max(v) AS hi,
  count_if(v < 1 OR v > 6) AS bad, avg(v) AS mean, median(v) AS med, stddev_samp(v) AS sd
FROM cells GROUP BY 1""",
        ),
    )
    + """SELECT sum(missing)::BIGINT AS missing, min(lo) AS min_value, max(hi) AS max_value,
  sum(bad)::BIGINT AS unrealistic, round(avg(mean), 6) AS mean_of_means,
  round(median(med), 6) AS median_of_medians, round(avg(sd), 6) AS mean_of_stds FROM p""",
)
def cop_profile(spark, sf_dir):
    cop = (
        hourly(spark, sf_dir).groupBy("ts").pivot("series", KINDS).agg(F.max("cop_average"))
    )
    return rounded(profile.cop_profile(cop, KINDS))


@query(
    "describe_columns",
    with_views(
        "gaps",
        (
            "cells",
            """SELECT unnest(['heat_demand_total', 'cop_average']) AS "column",
  unnest([heat_demand_total, cop_average]) AS v FROM gaps""",
        ),
    )
    + """SELECT "column", count(v) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
  min(v) AS min, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50,
  round(quantile_cont(v, 0.75), 6) AS q75, max(v) AS max FROM cells GROUP BY 1""",
)
def describe_columns(spark, sf_dir):
    return rounded(profile.describe(gaps(spark, sf_dir)))


@query(
    "table_info",
    with_views("daily")
    + """SELECT count(*) AS rows, 4 AS columns, 2 AS numeric_columns, min(ts) AS start, max(ts) AS "end"
FROM daily""",
)
def table_info(spark, sf_dir):
    return profile.table_info(daily(spark, sf_dir))


@query(
    "type_counts",
    with_views("daily")
    + """SELECT unnest(['string', 'timestamp_ntz', 'double']) AS dtype, count(*) AS rows,
  unnest([1::BIGINT, 1::BIGINT, 2::BIGINT]) AS columns FROM daily""",
)
def type_counts(spark, sf_dir):
    return profile.type_counts(daily(spark, sf_dir))


METADATA = {"country": "five series", "years": "2024", "winters": 1, "num_features": 12}


@query(
    "dataset_characteristics",
    with_views("hourly", ("t", dynamic_sql("hourly", 24)), ("l", f"SELECT *, {DYNAMIC_FLAGS} FROM t"))
    + """SELECT unnest(['Country', 'Time Period', 'Number of Winters', 'Number of Features',
    'Stress Rate (%)', 'Evaluation Method', 'Imbalanced Data Handling', 'Analysis Type',
    'Data Source']) AS characteristic,
  unnest(['five series', '2024', '1', '12', printf('%.2f%%', avg(stress_hour) * 100),
    'N/A', 'N/A', 'N/A', 'N/A']) AS value FROM l""",
)
def dataset_characteristics(spark, sf_dir):
    labelled = stress.label_dynamic(hourly(spark, sf_dir), window=24, layout=SMALL_CHUNKS)
    return profile.dataset_characteristics(labelled, METADATA)
