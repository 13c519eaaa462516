"""Reading energy tables from CSV: wide decimal-comma files and flat region files."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridload.functions.scalars import clean, parse_number, parse_time
from gridload.operators.select import keep_columns, keep_years, select_region

# fixed values: text columns of the wide file
UTC_COLUMN, LOCAL_COLUMN, FLAT_TIME = "utc_timestamp", "cet_cest_timestamp", "datetime"


def _header(spark: SparkSession, path: str, sep: str) -> list[str]:
    try:
        return spark.read.csv(path, sep=sep, header=True).columns
    except AnalysisException as missing:
        raise FileNotFoundError(f"no table at {path}") from missing


def _text_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_wide(
    spark: SparkSession, path: str, sep: str = ";", columns: Sequence[str] | None = None
) -> DataFrame:
    """Wide table: every column but the two time texts becomes a double, ``ts`` is
    the UTC time. Only columns that are used later are parsed."""
    names = _header(spark, path, sep)
    raw = spark.read.csv(path, sep=sep, header=True, schema=_text_schema(names))
    texts = [c for c in (UTC_COLUMN, LOCAL_COLUMN) if c in names]
    numbers = [c for c in names if c not in texts and (columns is None or c in columns)]
    return raw.select(
        parse_time(UTC_COLUMN).alias("ts"), *texts, *[parse_number(c).alias(c) for c in numbers]
    )


def read_flat(
    spark: SparkSession,
    path: str,
    codes: Sequence[str] | None = None,
    years: Iterable[int] | None = None,
) -> DataFrame:
    """Flat table: ``datetime`` plus one numeric column per region code."""
    names = _header(spark, path, ",")
    raw = spark.read.csv(path, header=True, schema=_text_schema(names))
    numbers = [c for c in names if c != FLAT_TIME]
    table = raw.select(
        parse_time(FLAT_TIME).alias("ts"),
        *[clean(F.col(c).try_cast("double")).alias(c) for c in numbers],
    )
    table = keep_years(table, years)
    return keep_columns(table, codes) if codes else table


def load_region(
    spark: SparkSession,
    path: str,
    code: str | None = None,
    years: Iterable[int] | None = None,
) -> DataFrame:
    """Flat table reduced to one region's demand, or to the total of all."""
    return select_region(read_flat(spark, path, years=years), code)
