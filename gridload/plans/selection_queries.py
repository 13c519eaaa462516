"""Queries for selection, calendar and scalar operators."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from gridload.functions import calendar, scalars
from gridload.operators import select
from gridload.plans.fixtures import (
    EVENT_KINDS,
    daily,
    gaps,
    hourly,
    scored,
    table,
    wide,
    with_views,
)
from gridload.plans.registry import query, rounded
from gridload.prep.features import keep_surviving as write_back

KINDS = list(EVENT_KINDS)


@query(
    "years_listed",
    with_views("daily")
    + "SELECT * FROM daily WHERE year(ts) IN (1995, 1996, 1999)",
)
def years_listed(spark, sf_dir):
    return select.keep_years(daily(spark, sf_dir), [1999, 1995, 1996])


@query(
    "year_range",
    with_views("daily") + "SELECT * FROM daily WHERE year(ts) BETWEEN 1996 AND 1998",
)
def year_range(spark, sf_dir):
    return select.keep_year_range(daily(spark, sf_dir), 1996, 1998)


@query("column_subset", with_views("wide") + "SELECT ts, purchase, view FROM wide")
def column_subset(spark, sf_dir):
    return select.keep_columns(wide(spark, sf_dir), ["purchase", "absent", "view"])


@query(
    "region_select",
    with_views("wide")
    + """SELECT ts, click, error AS heat_demand_total, purchase, signup, "view"
FROM wide WHERE error IS NOT NULL""",
)
def region_select(spark, sf_dir):
    return select.select_region(wide(spark, sf_dir), "error")


@query(
    "region_fallback_total",
    with_views("wide")
    + """SELECT ts, round(coalesce(click, 0) + coalesce(error, 0) + coalesce(purchase, 0)
  + coalesce(signup, 0) + coalesce("view", 0), 4) AS heat_demand_total FROM wide""",
)
def region_fallback_total(spark, sf_dir):
    total = select.select_region(wide(spark, sf_dir), "XX", KINDS)
    return rounded(total.select("ts", "heat_demand_total"), 4)


@query(
    "find_columns",
    with_views("wide") + """SELECT ts, purchase, signup FROM wide""",
)
def find_columns(spark, sf_dir):
    table_ = wide(spark, sf_dir)
    found = select.find_columns(table_, prefix="p") + select.find_columns(table_, suffix="nup")
    return table_.select("ts", *found)


@query(
    "extract_series",
    with_views("wide")
    + """SELECT ts, click AS heat_demand_total, "view" AS cop_ashp_floor FROM wide
WHERE click IS NOT NULL AND "view" IS NOT NULL""",
)
def extract_series(spark, sf_dir):
    return select.extract_series(wide(spark, sf_dir), "cli", "vie")


@query(
    "row_total_and_mean",
    with_views("wide")
    + """, cells AS (UNPIVOT wide ON click, error, purchase, signup, "view" INTO NAME s VALUE v),
agg AS (SELECT ts, sum(v) AS s, avg(v) AS m FROM cells GROUP BY ts)
SELECT wide.ts, round(coalesce(s, 0e0), 4) AS total_demand, round(m, 6) AS mean_demand
FROM wide LEFT JOIN agg ON wide.ts = agg.ts""",
)
def row_total_and_mean(spark, sf_dir):
    return wide(spark, sf_dir).select(
        "ts",
        F.round(select.row_sum(KINDS), 4).alias("total_demand"),
        F.round(select.row_mean(KINDS), 6).alias("mean_demand"),
    )


@query(
    "long_total_and_mean",
    with_views("hourly")
    + """SELECT ts, round(sum(heat_demand_total), 4) AS total_demand,
  round(avg(cop_average), 6) AS mean_cop FROM hourly GROUP BY ts""",
)
def long_total_and_mean(spark, sf_dir):
    return rounded(
        hourly(spark, sf_dir)
        .groupBy("ts")
        .agg(
            F.round(F.sum("heat_demand_total"), 4).alias("total_demand"),
            F.avg("cop_average").alias("mean_cop"),
        )
    )


@query(
    "wide_to_long",
    with_views("wide", ("cells", """SELECT ts, s, v FROM (
  SELECT ts, unnest(['click', 'error', 'purchase', 'signup', 'view']) AS s,
         unnest([click, error, purchase, signup, "view"]) AS v FROM wide)"""))
    + "SELECT s AS series, ts, v AS heat_demand_total FROM cells",
)
def wide_to_long(spark, sf_dir):
    return select.to_long(wide(spark, sf_dir), KINDS)


@query(
    "complete_rows",
    with_views("gaps") + "SELECT * FROM gaps WHERE heat_demand_total IS NOT NULL",
)
def complete_rows(spark, sf_dir):
    return select.complete_rows(gaps(spark, sf_dir))


@query(
    "calendar_week",
    with_views("hourly")
    + "SELECT * FROM hourly WHERE ts >= '2024-01-15' AND ts < '2024-01-22'",
)
def calendar_week(spark, sf_dir):
    return select.calendar_week(hourly(spark, sf_dir), 2024, 1, 15, 21)


@query(
    "calendar_week_fallback",
    with_views("daily")
    + """SELECT series, ts, heat_demand_total, cop_average FROM daily
WHERE month(ts) IN (12, 1, 2)
QUALIFY row_number() OVER (PARTITION BY series ORDER BY ts) <= 168""",
)
def calendar_week_fallback(spark, sf_dir):
    return select.calendar_week(daily(spark, sf_dir), 2014, 1, 15, 21)


@query(
    "peak_hours",
    with_views("hourly") + "SELECT * FROM hourly WHERE hour(ts) BETWEEN 17 AND 21",
)
def peak_hours(spark, sf_dir):
    return select.peak_hours(hourly(spark, sf_dir))


@query(
    "winter_rows",
    with_views("daily") + "SELECT * FROM daily WHERE month(ts) IN (12, 1, 2)",
)
def winter_rows(spark, sf_dir):
    return select.winter_rows(daily(spark, sf_dir))


@query(
    "first_rows",
    with_views("daily")
    + """SELECT * FROM daily
QUALIFY row_number() OVER (PARTITION BY series ORDER BY ts) <= 168""",
)
def first_rows(spark, sf_dir):
    return select.first_rows(daily(spark, sf_dir))


@query(
    "numeric_columns",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_tax
FROM lineitem""",
)
def numeric_columns(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    return lineitem.select(*scalars.numeric_columns(lineitem, exclude=["l_discount"]))


@query(
    "feature_matrix",
    with_views("gaps", ("m", "SELECT median(heat_demand_total) AS d FROM gaps"))
    + """SELECT series, ts, round(coalesce(heat_demand_total, d), 6) AS heat_demand_total,
  cop_average FROM gaps, m""",
)
def feature_matrix(spark, sf_dir):
    return rounded(select.feature_matrix(gaps(spark, sf_dir), keep=["series", "ts"]))


@query(
    "feature_vectors",
    with_views("gaps", ("m", "SELECT median(heat_demand_total) AS d FROM gaps"))
    + """SELECT series, ts, round(coalesce(heat_demand_total, d), 6) AS first, cop_average AS second
FROM gaps, m""",
)
def feature_vectors(spark, sf_dir):
    vectors = select.feature_vectors(
        gaps(spark, sf_dir), ["heat_demand_total", "cop_average"], ["series", "ts"]
    )
    cells = vector_to_array("features")
    return vectors.select(
        "series", "ts", F.round(cells[0], 6).alias("first"), cells[1].alias("second")
    )


@query(
    "target_summary",
    with_views("scored")
    + """SELECT sum(y_true)::BIGINT AS positives, round(avg(y_true), 9) AS positive_rate FROM scored""",
)
def target_summary(spark, sf_dir):
    return rounded(select.target_summary(scored(spark, sf_dir), "y_true"), 9)


@query(
    "keep_surviving",
    with_views("gaps")
    + """SELECT series, ts, cop_average, heat_demand_total * 2 AS heat_demand_total FROM gaps
WHERE heat_demand_total IS NOT NULL""",
)
def keep_surviving(spark, sf_dir):
    """Processed values written back; rows lost in processing are dropped."""
    rows = gaps(spark, sf_dir)
    processed = rows.dropna().withColumn("heat_demand_total", F.col("heat_demand_total") * 2)
    return write_back(rows, processed, ["heat_demand_total"])


@query(
    "proxy_cop",
    with_views(
        "daily",
        ("s", "SELECT avg(heat_demand_total) AS m, stddev_samp(heat_demand_total) AS sd FROM daily"),
    )
    + """, c AS (SELECT series, ts, heat_demand_total,
  greatest(least(3.5e0 + (heat_demand_total - m) / sd * 0.2e0
    + sin(2e0 * pi() * dayofyear(ts) / 365e0) * 0.3e0, 5e0), 2e0) AS c FROM daily, s)
SELECT series, ts, heat_demand_total, round(c, 6) AS cop_average,
  round(greatest(least(c, 5e0), 2e0), 6) AS cop_ashp FROM c""",
)
def proxy_cop(spark, sf_dir):
    return rounded(select.add_proxy_cop(daily(spark, sf_dir).drop("cop_average")))


CALENDAR_SQL = """series, ts, hour(ts)::INT AS hour, (isodow(ts) - 1)::INT AS day_of_week,
  dayofyear(ts)::INT AS day_of_year, month(ts)::INT AS month, year(ts)::INT AS year"""
FLAGS_SQL = """(isodow(ts) >= 6)::INT AS is_weekend,
  (month(ts) IN (12, 1, 2))::INT AS is_winter, (month(ts) IN (3, 4, 5))::INT AS is_spring,
  (month(ts) IN (6, 7, 8))::INT AS is_summer, (month(ts) IN (9, 10, 11))::INT AS is_autumn"""


@query("calendar_features", with_views("hourly daily", ("u", "SELECT * FROM hourly UNION ALL SELECT * FROM daily")) + f"SELECT {CALENDAR_SQL} FROM u")
def calendar_features(spark, sf_dir):
    rows = hourly(spark, sf_dir).unionByName(daily(spark, sf_dir))
    return calendar.add_calendar(rows.select("series", "ts"))


@query("calendar_flags", with_views("daily") + f"SELECT series, ts, {FLAGS_SQL} FROM daily")
def calendar_flags(spark, sf_dir):
    flagged = calendar.add_calendar_flags(calendar.add_calendar(daily(spark, sf_dir)))
    return flagged.select(
        "series", "ts", "is_weekend", "is_winter", "is_spring", "is_summer", "is_autumn"
    )


@query(
    "calendar_cycles",
    with_views("daily hourly", ("u", "SELECT * FROM hourly UNION ALL SELECT * FROM daily"))
    + """SELECT series, ts,
  round(sin(2e0 * pi() * hour(ts) / 24e0), 9) + 0e0 AS hour_sin,
  round(cos(2e0 * pi() * hour(ts) / 24e0), 9) + 0e0 AS hour_cos,
  round(sin(2e0 * pi() * (isodow(ts) - 1) / 7e0), 9) + 0e0 AS day_sin,
  round(cos(2e0 * pi() * (isodow(ts) - 1) / 7e0), 9) + 0e0 AS day_cos,
  round(sin(2e0 * pi() * month(ts) / 12e0), 9) + 0e0 AS month_sin,
  round(cos(2e0 * pi() * month(ts) / 12e0), 9) + 0e0 AS month_cos FROM u""",
)
def calendar_cycles(spark, sf_dir):
    rows = hourly(spark, sf_dir).unionByName(daily(spark, sf_dir))
    waves = calendar.add_cycles(calendar.add_calendar(rows))
    names = [f"{n}_{w}" for n in calendar.CYCLES for w in ("sin", "cos")]
    # adding zero turns -0.0 into 0.0
    return waves.select("series", "ts", *[(F.round(n, 9) + 0.0).alias(n) for n in names])


@query(
    "season_labels",
    with_views("daily")
    + """SELECT series, ts, CASE WHEN month(ts) IN (12, 1, 2) THEN 'winter'
  WHEN month(ts) <= 5 THEN 'spring' WHEN month(ts) <= 8 THEN 'summer' ELSE 'autumn' END AS season
FROM daily""",
)
def season_labels(spark, sf_dir):
    return calendar.add_season(daily(spark, sf_dir)).select("series", "ts", "season")


@query(
    "interactions",
    with_views("hourly")
    + """SELECT series, ts, round(heat_demand_total / nullif(cop_average, 0), 6) AS demand_cop_ratio,
  round(heat_demand_total * cop_average, 6) AS demand_cop_product,
  heat_demand_total * (month(ts) IN (12, 1, 2))::INT AS winter_demand,
  heat_demand_total * (month(ts) IN (6, 7, 8))::INT AS summer_demand,
  (hour(ts) BETWEEN 17 AND 21)::INT AS is_peak_hour,
  heat_demand_total * (hour(ts) BETWEEN 17 AND 21)::INT AS peak_demand
FROM hourly""",
)
def interactions(spark, sf_dir):
    ready = calendar.add_calendar_flags(calendar.add_calendar(hourly(spark, sf_dir)))
    built = calendar.add_interactions(ready)
    return built.select(
        "series",
        "ts",
        F.round("demand_cop_ratio", 6).alias("demand_cop_ratio"),
        F.round("demand_cop_product", 6).alias("demand_cop_product"),
        "winter_demand",
        "summer_demand",
        "is_peak_hour",
        "peak_demand",
    )


@query(
    "parse_numbers",
    with_views("gaps")
    + """SELECT series, ts, heat_demand_total AS demand, cop_average AS cop FROM gaps""",
)
def parse_numbers(spark, sf_dir):
    text = gaps(spark, sf_dir).select(
        "series",
        "ts",
        F.coalesce(
            F.replace(F.col("heat_demand_total").cast("string"), F.lit("."), F.lit(",")),
            F.lit("n/a"),
        ).alias("d"),
        F.replace(F.col("cop_average").cast("string"), F.lit("."), F.lit(",")).alias("c"),
    )
    return text.select(
        "series", "ts", scalars.parse_number("d").alias("demand"), scalars.parse_number("c").alias("cop")
    )


@query(
    "parse_times",
    "SELECT event_id, date_trunc('second', ts) AS ts FROM events",
)
def parse_times(spark, sf_dir):
    text = table(spark, sf_dir, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utc_timestamp")
    )
    return text.select("event_id", scalars.parse_time("utc_timestamp").alias("ts"))


@query(
    "clip_range",
    with_views("hourly")
    + "SELECT series, ts, greatest(least(cop_average, 3.8e0), 3.2e0) AS cop FROM hourly",
)
def clip_range(spark, sf_dir):
    return hourly(spark, sf_dir).select(
        "series", "ts", scalars.clip(F.col("cop_average"), 3.2, 3.8).alias("cop")
    )


@query(
    "min_max_normalise",
    with_views("daily")
    + """SELECT series, ts,
  round((heat_demand_total - min(heat_demand_total) OVER s)
    / nullif(max(heat_demand_total) OVER s - min(heat_demand_total) OVER s, 0), 6) AS demand_norm,
  round((cop_average - min(cop_average) OVER s)
    / nullif(max(cop_average) OVER s - min(cop_average) OVER s, 0), 6) AS cop_norm
FROM daily WINDOW s AS (PARTITION BY series)""",
)
def min_max_normalise(spark, sf_dir):
    scaled = scalars.normalise_range(
        daily(spark, sf_dir),
        {"demand_norm": "heat_demand_total", "cop_norm": "cop_average"},
        ["series"],
    )
    return rounded(scaled.select("series", "ts", "demand_norm", "cop_norm"))


@query(
    "divide_by_maximum",
    with_views("daily", ("t", "SELECT series, sum(heat_demand_total) AS d, count(*) AS n FROM daily GROUP BY 1"))
    + """SELECT series, round(d / max(d) OVER (), 6) AS demand_share,
  round(n / max(n) OVER (), 6) AS rows_share FROM t""",
)
def divide_by_maximum(spark, sf_dir):
    totals = (
        daily(spark, sf_dir)
        .groupBy("series")
        .agg(F.sum("heat_demand_total").alias("d"), F.count(F.lit(1)).alias("n"))
    )
    shares = scalars.divide_by_maximum(totals, {"demand_share": "d", "rows_share": "n"})
    return rounded(shares.drop("d", "n"))


@query(
    "fixed_text",
    with_views("hourly", ("t", "SELECT series, count(*) AS n, max(heat_demand_total) AS d FROM hourly GROUP BY 1"))
    + """SELECT upper(series[1]) || series[2:] AS name, printf('%.3f', d) AS demand3,
  printf('%.1f%%', n / 4e0) AS share FROM t""",
)
def fixed_text(spark, sf_dir):
    tops = (
        hourly(spark, sf_dir)
        .groupBy("series")
        .agg(F.count(F.lit(1)).alias("n"), F.max("heat_demand_total").alias("d"))
    )
    return tops.select(
        scalars.title_case(F.col("series")).alias("name"),
        scalars.fixed("d", 3).alias("demand3"),
        scalars.fixed(F.col("n") / 4.0, 1, "%").alias("share"),
    )


@query(
    "region_codes",
    """SELECT DISTINCT split_part(c_mktsegment || '_' || c_custkey, '_', 1) AS code FROM customer
WHERE regexp_full_match(split_part(c_mktsegment || '_' || c_custkey, '_', 1), '[A-Z]+')""",
)
def region_codes(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(
        F.concat_ws("_", "c_mktsegment", "c_custkey").alias("name")
    )
    return scalars.codes_in(names)
