from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path[:0] = [
    os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
    os.path.dirname(os.path.abspath(__file__)),
]

SF_DIR = os.environ.get("GRIDLOAD_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from gridload.session import configure

    session = configure(
        SparkSession.builder.master("local[8]")
        .appName("gridload-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def hours(spark):
    """Two series of hourly rows; the first holds three quarters of them."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(42)
    parts = []
    for name, n in (("big", 900), ("small", 300)):
        parts.append(
            pd.DataFrame(
                {
                    "series": name,
                    "ts": pd.date_range("2020-01-01", periods=n, freq="h"),
                    "heat_demand_total": rng.exponential(100, n).round(4),
                    "cop_average": rng.uniform(2, 5, n).round(4),
                }
            )
        )
    frame = pd.concat(parts, ignore_index=True)
    frame.loc[rng.random(len(frame)) < 0.01, "heat_demand_total"] = np.nan
    return frame


@pytest.fixture(scope="session")
def hourly_df(spark, hours):
    from gridload.functions.scalars import clean
    from pyspark.sql import functions as F

    df = spark.createDataFrame(hours).repartition(8)
    return df.select(
        "series",
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        clean(F.col("heat_demand_total")).alias("heat_demand_total"),
        "cop_average",
    )
