"""Queries that write files under the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridload.operators import metrics, response, stress
from gridload.plans.fixtures import EVENT_KINDS, daily, hourly, models, wide, with_views
from gridload.plans.registry import query, rounded
from gridload.plans.response_queries import with_probability
from gridload.plans.scoring_queries import OPTIMAL, T1_SQL, AT_OPTIMAL, AREAS, CURVE, SPLIT_MODELS
from gridload.plans.series_queries import SEASONAL
from gridload.session import new_path
from gridload.sources import sinks, tables

KINDS = list(EVENT_KINDS)
STAMP = "yyyy-MM-dd'T'HH:mm:ss'Z'"
CODES = {"AFRICA": "AT", "AMERICA": "BE", "ASIA": "DE", "EUROPE": "FR", "MIDDLE EAST": "IT"}


def flat_table(spark, sf_dir):
    """One column per region code, all days."""
    pivoted = daily(spark, sf_dir).groupBy("ts").pivot("series", list(CODES))
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("datetime")
    return pivoted.agg(F.max("heat_demand_total")).select(
        stamp, *[F.col(s).alias(code) for s, code in CODES.items()]
    )


@query(
    "wide_csv",
    with_views("wide")
    + """SELECT ts, click AS DE_heat_demand_total, error AS FR_heat_demand_total,
  purchase AS SE_heat_demand_total, signup AS IT_heat_demand_total,
  "view" AS DE_COP_ASHP_floor FROM wide""",
)
def wide_csv(spark, sf_dir):
    """Semicolon file with decimal commas, unparsable cells and two time texts."""
    path = new_path(spark, "wide")
    texts = {
        "DE_heat_demand_total": "click",
        "FR_heat_demand_total": "error",
        "SE_heat_demand_total": "purchase",
        "IT_heat_demand_total": "signup",
        "DE_COP_ASHP_floor": "view",
    }
    wide(spark, sf_dir).select(
        F.date_format("ts", STAMP).alias("utc_timestamp"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+0100'").alias("cet_cest_timestamp"),
        *[
            F.coalesce(
                F.replace(F.col(c).cast("string"), F.lit("."), F.lit(",")), F.lit("n/a")
            ).alias(name)
            for name, c in texts.items()
        ],
    ).write.csv(path, sep=";", header=True)
    return tables.read_wide(spark, path).drop("utc_timestamp", "cet_cest_timestamp")


@query(
    "flat_csv",
    with_views("daily")
    + "SELECT ts, "
    + ", ".join(
        f"""max(CASE WHEN series = '{s}' THEN heat_demand_total END) AS "{code}" """
        for s, code in CODES.items()
    )
    + "FROM daily GROUP BY ts",
)
def flat_csv(spark, sf_dir):
    path = new_path(spark, "flat")
    flat_table(spark, sf_dir).write.csv(path, header=True)
    return tables.read_flat(spark, path, [*CODES.values(), "ZZ"], list(range(1990, 2010)))


@query(
    "region_from_csv",
    with_views("daily")
    + """SELECT ts, round(sum(heat_demand_total), 2) AS heat_demand_total FROM daily
GROUP BY ts""",
)
def region_from_csv(spark, sf_dir):
    path = new_path(spark, "regions")
    flat_table(spark, sf_dir).write.csv(path, header=True)
    total = tables.load_region(spark, path, "pan_european", list(range(1990, 2010)))
    return rounded(total.select("ts", "heat_demand_total"), 2)


@query("processed_csv", with_views("hourly") + "SELECT * FROM hourly")
def processed_csv(spark, sf_dir):
    path = sinks.save_processed(hourly(spark, sf_dir), new_path(spark, "processed"), "DE")
    return sinks.read_processed(
        spark,
        path,
        "series string, ts timestamp_ntz, heat_demand_total double, cop_average double",
    )


@query(
    "processed_partitions",
    with_views("daily") + "SELECT * FROM daily WHERE series = 'ASIA' AND year(ts) = 1997",
)
def processed_partitions(spark, sf_dir):
    path = new_path(spark, "partitions")
    sinks.save_partitioned(daily(spark, sf_dir), path)
    return (
        spark.read.parquet(path)
        .filter("series = 'ASIA' AND year = 1997")
        .select("series", "ts", "heat_demand_total", "cop_average")
    )


@query(
    "feature_sidecar",
    with_views("hourly")
    + """SELECT 2::BIGINT AS total_features, 'heat_demand_total,cop_average' AS names,
  '24,168' AS windows, '1,24' AS lags, count(*) AS rows FROM hourly""",
)
def feature_sidecar(spark, sf_dir):
    rows = hourly(spark, sf_dir)
    folder = new_path(spark, "sidecar")
    path = sinks.save_processed(rows, folder, None, ["heat_demand_total", "cop_average"])
    info = sinks.read_feature_info(spark, path.replace(".csv", "_features.json"))
    count = spark.read.csv(path, header=True).agg(F.count(F.lit(1)).alias("rows")).scalar()
    return info.select(
        "total_features",
        F.array_join("feature_names", ",").alias("names"),
        F.array_join(F.col("rolling_windows").cast("array<string>"), ",").alias("windows"),
        F.array_join(F.col("lag_periods").cast("array<string>"), ",").alias("lags"),
        count.alias("rows"),
    )


def documented(spark, sf_dir):
    path = new_path(spark, "document")
    sinks.save_document(
        spark,
        path,
        {"country": "five series", "num_features": 12},
        metrics.optimal_report(models(spark, sf_dir), OPTIMAL),
        response.trigger_estimates(with_probability(spark, sf_dir)),
        stress.seasonal_thresholds(daily(spark, sf_dir)),
    )
    return sinks.read_document(spark, path)


@query("result_document")
def result_document(spark, sf_dir):
    document, _ = documented(spark, sf_dir)
    return document.select(
        "metadata.country", F.explode("model_performance").alias("m")
    ).select("country", "m.*")


@query(
    "result_thresholds",
    with_views("daily", *SEASONAL)
    + """SELECT series, season, round(demand_p90, 6) AS demand_p90, round(cop_p20, 6) AS cop_p20
FROM thr""",
)
def result_thresholds(spark, sf_dir):
    _, thresholds = documented(spark, sf_dir)
    return rounded(thresholds)


def reports(spark, sf_dir):
    report = metrics.optimal_report(models(spark, sf_dir), OPTIMAL)
    estimates = response.trigger_estimates(with_probability(spark, sf_dir))
    folder = new_path(spark, "reports")
    manifest = sinks.save_reports(
        spark,
        folder,
        {
            "table_1_model_performance.csv": (
                "Model Performance Comparison",
                metrics.performance_table(report),
            ),
            "table_2_dr_analysis.csv": (
                "Demand Response Analysis",
                response.response_table(estimates),
            ),
            "table_4_threshold_optimization.csv": (
                "Threshold Optimization Results",
                metrics.threshold_table(report),
            ),
        },
    )
    return folder, manifest


@query(
    "report_csv", with_views("models", SPLIT_MODELS, AT_OPTIMAL, CURVE, AREAS) + T1_SQL
)
def report_csv(spark, sf_dir):
    folder, _ = reports(spark, sf_dir)
    return spark.read.csv(f"{folder}/table_1_model_performance.csv", header=True)


@query("report_manifest")
def report_manifest(spark, sf_dir):
    """Every file the manifest names, with the rows read back from it."""
    folder, _ = reports(spark, sf_dir)
    manifest = spark.read.csv(f"{folder}/table_summary.csv", header=True)
    found = (
        spark.read.text(folder, pathGlobFilter="part-*", recursiveFileLookup=True)
        .groupBy(F.regexp_extract(F.input_file_name(), r"/([^/]+[.]csv)/", 1).alias("_file"))
        .agg((F.count(F.lit(1)) - F.count_distinct(F.input_file_name())).alias("rows"))
    )
    return manifest.join(found, F.col("File") == F.col("_file"), "left").drop("_file")
