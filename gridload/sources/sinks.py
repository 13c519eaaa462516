"""Writing processed tables, result documents and report tables, and reading them back."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridload.prep.features import feature_info


def processed_name(code: str | None) -> str:
    return f"{code or 'pan_european'}_processed_data.csv"


def save_processed(
    df: DataFrame, folder: str, code: str | None = None, features: Sequence[str] = ()
) -> str:
    """Processed table as CSV plus its feature description; returns the table path."""
    path = f"{folder}/{processed_name(code)}"
    df.write.mode("overwrite").csv(path, header=True)
    save_feature_info(df.sparkSession, path.replace(".csv", "_features.json"), features)
    return path


def save_feature_info(spark: SparkSession, path: str, features: Sequence[str]) -> None:
    info = json.dumps(feature_info(features))
    spark.range(1).select(F.lit(info).alias("value")).write.mode("overwrite").text(path)


def read_feature_info(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=False)


def save_partitioned(df: DataFrame, path: str, key: str = "series", time: str = "ts") -> None:
    """Columnar form for large tables: one folder per key and year.

    Rows are spread by key, year and a time slice, so a hot key is written by many
    tasks while small ones do not fan out into many files.
    """
    dated = df.withColumn("year", F.year(time))
    slices = dated.repartition(key, "year", F.month(time))
    slices.write.mode("overwrite").partitionBy(key, "year").parquet(path)


def read_processed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.csv(path, header=True, schema=schema)
    except AnalysisException as missing:
        raise FileNotFoundError(f"no table at {path}") from missing


def _as_array(df: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """A report table (one row per model or scenario) as one array cell."""
    row = F.struct(*[F.col(c) for c in (*order, *[c for c in df.columns if c not in order])])
    return df.agg(F.array_sort(F.collect_list(row)).alias(name))


def save_document(
    spark: SparkSession,
    path: str,
    metadata: dict[str, object],
    performance: DataFrame,
    response: DataFrame,
    thresholds: DataFrame,
) -> None:
    """Result document: one nested JSON row, with the thresholds table beside it.

    The nested parts have one entry per model and scenario. Thresholds have rows per
    series and stay a table of their own.
    """
    header = F.struct(*[F.lit(v).alias(k) for k, v in metadata.items()]).alias("metadata")
    document = spark.range(1).select(
        header,
        _as_array(performance, "model_performance", ["model"]).scalar().alias("model_performance"),
        _as_array(response, "dr_analysis", ["scenario"]).scalar().alias("dr_analysis"),
    )
    document.write.mode("overwrite").json(f"{path}/document")
    thresholds.write.mode("overwrite").json(f"{path}/seasonal_thresholds")


def read_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(document, seasonal thresholds) written by ``save_document``."""
    try:
        return (
            spark.read.json(f"{path}/document"),
            spark.read.json(f"{path}/seasonal_thresholds"),
        )
    except AnalysisException as missing:
        raise FileNotFoundError(f"no results at {path}") from missing


def save_reports(spark: SparkSession, folder: str, reports: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """Report tables ``{file: (title, table)}`` as single CSV files plus a manifest.

    Reports have a row per model, scenario or characteristic, so one file each.
    """
    for file, (_, table) in reports.items():
        table.coalesce(1).write.mode("overwrite").csv(f"{folder}/{file}", header=True)
    rows = [
        (f"Table {i}", title, file) for i, (file, (title, _)) in enumerate(reports.items(), 1)
    ]
    manifest = spark.createDataFrame(rows, "`Table` string, Title string, File string")
    manifest.coalesce(1).write.mode("overwrite").csv(f"{folder}/table_summary.csv", header=True)
    return manifest
