"""Energy-shaped views over the test tables, with their SQL twins.

Each view is lazy and aggregates before it joins, so its cost follows the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_KINDS = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly demand and COP per event type, from ``events``."""
    k = F.get_json_object("props", "$.k").cast("int")
    return (
        table(spark, sf_dir, "events")
        .groupBy(
            F.col("event_type").alias("series"),
            F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"),
        )
        .agg(
            F.round(F.sum("value"), 4).alias("heat_demand_total"),
            F.round(2 + 3 * F.sum(k) / (99 * F.count(F.lit(1))), 4).alias("cop_average"),
        )
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily demand and COP per region, from ``orders`` and its customers."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    mix = (F.col("o_custkey") * 7 + F.col("o_orderkey") * 13) % 100
    return (
        orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(
            F.col("r_name").alias("series"),
            F.col("o_orderdate").cast("timestamp_ntz").alias("ts"),
        )
        .agg(
            F.round(F.sum("o_totalprice"), 2).alias("heat_demand_total"),
            F.round(2 + 3 * F.sum(mix) / (99 * F.count(F.lit(1))), 4).alias("cop_average"),
        )
    )


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per hour, one demand column per event type."""
    return (
        hourly(spark, sf_dir)
        .groupBy("ts")
        .pivot("series", list(EVENT_KINDS))
        .agg(F.max("heat_demand_total"))
    )


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``hourly`` with demand missing at regular places."""
    hole = (F.hour("ts") * 31 + F.dayofyear("ts") * 7) % 17 == 0
    return hourly(spark, sf_dir).withColumn(
        "heat_demand_total", F.when(~hole, F.col("heat_demand_total"))
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled events with a made-up probability; many equal scores."""
    k = F.get_json_object("props", "$.k").cast("int")
    y = (F.col("event_type") == "error").cast("int")
    return (
        table(spark, sf_dir, "events")
        .select("event_id", "ts", y.alias("y_true"), k.alias("k"))
        .select(
            "event_id",
            "ts",
            "y_true",
            F.round(F.lit(0.3) * F.col("y_true") + F.lit(0.7) * F.col("k") / 99, 6).alias(
                "y_proba"
            ),
        )
    )


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three scored rows per event: the score itself and two distortions of it."""
    p = F.col("y_proba")
    variants = F.array(
        F.struct(F.lit("base").alias("model"), p.alias("y_proba")),
        F.struct(F.lit("flat").alias("model"), F.round(0.25 + p / 2, 7).alias("y_proba")),
        F.struct(F.lit("square").alias("model"), F.round(p * p, 6).alias("y_proba")),
    )
    return (
        scored(spark, sf_dir)
        .select("event_id", "ts", "y_true", F.explode(variants).alias("v"))
        .select("v.model", "event_id", "ts", "y_true", "v.y_proba")
    )


def conditional(kind: str) -> str:
    return f"max(CASE WHEN series = '{kind}' THEN heat_demand_total END) AS {kind}"


VIEWS = {
    "hourly": """
  SELECT event_type AS series, CAST(date_trunc('hour', ts) AS timestamp) AS ts,
         round(sum(value), 4) AS heat_demand_total,
         round(2e0 + 3e0 * sum(CAST(json_extract_string(props, '$.k') AS int))
               / (99 * count(*)), 4) AS cop_average
  FROM events GROUP BY 1, 2""",
    "daily": """
  SELECT r_name AS series, CAST(o_orderdate AS timestamp) AS ts,
         round(sum(o_totalprice), 2) AS heat_demand_total,
         round(2e0 + 3e0 * sum((o_custkey * 7 + o_orderkey * 13) % 100)
               / (99 * count(*)), 4) AS cop_average
  FROM orders JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey
  GROUP BY 1, 2""",
    "wide": f"""
  SELECT ts, {", ".join(conditional(kind) for kind in EVENT_KINDS)}
  FROM hourly GROUP BY ts""",
    "gaps": """
  SELECT series, ts,
         CASE WHEN (hour(ts) * 31 + dayofyear(ts) * 7) % 17 = 0 THEN NULL
              ELSE heat_demand_total END AS heat_demand_total, cop_average
  FROM hourly""",
    "scored": """
  SELECT event_id, ts, y AS y_true, round(0.3e0 * y + 0.7e0 * k / 99, 6) AS y_proba
  FROM (SELECT event_id, ts, CAST(event_type = 'error' AS int) AS y,
               CAST(json_extract_string(props, '$.k') AS int) AS k FROM events)""",
    "models": """
  SELECT 'base' AS model, event_id, ts, y_true, y_proba FROM scored
  UNION ALL SELECT 'flat', event_id, ts, y_true, round(0.25e0 + y_proba / 2e0, 7) FROM scored
  UNION ALL SELECT 'square', event_id, ts, y_true, round(y_proba * y_proba, 6) FROM scored""",
}
NEEDS = {"wide": ("hourly",), "gaps": ("hourly",), "models": ("scored",)}


def with_views(names: str, *extra: tuple[str, str]) -> str:
    """``WITH`` clause for the named views (and what they need) plus extra CTEs."""
    order: list[str] = []
    for name in names.split():
        for needed in (*NEEDS.get(name, ()), name):
            if needed not in order:
                order.append(needed)
    parts = [f"{name} AS ({VIEWS[name]})" for name in order]
    parts += [f"{name} AS ({body})" for name, body in extra]
    return "WITH " + ",\n".join(parts) + "\n"
