"""Data-quality checks: one aggregate pass, one finding per row.

Every check returns rows ``(check, severity, column, value)`` with severity
``fatal`` (makes the table invalid), ``issue``, ``warning`` or ``info``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridload.functions.scalars import numeric_columns

# fixed values
MAX_DEMAND, COP_RANGE = 1e6, (1.0, 10.0)
STRESS_RATE_RANGE, MISSING_LIMIT, CLASS_RATIO_LIMIT = (0.001, 0.5), 0.1, 0.01
REQUIRED = ("heat_demand_total", "cop_average")
CRITICAL = ("stress_hour", "heat_demand_total", "cop_average")
RESULT_KEYS = ("metrics", "model_info")
RESULT_METRICS = ("accuracy", "precision", "recall", "f1")

# check, severity, column, value, and when it applies ("$" is the value)
Finding = tuple[str, str, str | None, Column, str]


def _absent(column: str, df: DataFrame) -> Column:
    c = F.col(column)
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return F.count_if(c.isNull() | F.isnan(c))
    return F.count_if(c.isNull())


def _infinite(column: str, df: DataFrame) -> Column:
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return F.count_if(F.abs(column) == float("inf"))
    return F.lit(0)


def _is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def _report(df: DataFrame, findings: Sequence[Finding]) -> DataFrame:
    """Evaluate all values in one aggregation, then keep the findings that apply."""
    rows = df.agg(
        *[value.cast("double").alias(f"v{i}") for i, (_, _, _, value, _) in enumerate(findings)],
        F.count(F.lit(1)).cast("double").alias("rows"),
    )
    structs = []
    for i, (check, severity, column, _, condition) in enumerate(findings):
        structs.append(
            F.struct(
                F.lit(check).alias("check"),
                F.lit(severity).alias("severity"),
                F.lit(column).cast("string").alias("column"),
                F.col(f"v{i}").alias("value"),
                F.coalesce(F.expr(condition.replace("$", f"v{i}")), F.lit(False)).alias("applies"),
            )
        )
    return (
        rows.select(F.explode(F.array(*structs)).alias("f"))
        .filter("f.applies")
        .select("f.check", "f.severity", "f.column", "f.value")
    )


def is_valid(report: DataFrame) -> DataFrame:
    """One row: false exactly when a fatal finding is present."""
    return report.agg((F.count_if(F.col("severity") == "fatal") == 0).alias("is_valid"))


def _row_count() -> Column:
    return F.count(F.lit(1))


def check_loaded(df: DataFrame, time: str = "ts") -> DataFrame:
    """Empty table, wrong time type, many missing cells, infinities, date range."""
    timed = time in df.columns and isinstance(
        df.schema[time].dataType, (T.TimestampType, T.TimestampNTZType)
    )
    found: list[Finding] = [
        ("empty", "fatal", None, _row_count(), "$ = 0"),
        ("total_rows", "info", None, _row_count(), "$ > 0"),
        ("total_columns", "info", None, F.lit(len(df.columns)), "rows > 0"),
    ]
    if not timed:
        found.append(("time_not_timestamp", "warning", time, F.lit(1), "rows > 0"))
    else:
        seconds = F.unix_seconds(F.col(time).cast("timestamp"))
        found.append(("first_time", "info", time, F.min(seconds), "rows > 0"))
        found.append(("last_time", "info", time, F.max(seconds), "rows > 0"))
    for c in df.columns:
        found.append(("missing_cells", "info", c, _absent(c, df), "rows > 0"))
        found.append(
            ("many_missing", "warning", c, _absent(c, df), f"$ > rows * {MISSING_LIMIT}D")
        )
    for c in numeric_columns(df):
        found.append(("infinite", "warning", c, _infinite(c, df), "$ > 0"))
    return _report(df, found)


def check_raw(df: DataFrame, max_missing_ratio: float = MISSING_LIMIT) -> DataFrame:
    """Required columns, types, plausible ranges, missing share, basic statistics."""
    demand, cop = REQUIRED
    found: list[Finding] = [
        ("empty", "fatal", None, _row_count(), "$ = 0"),
        ("total_rows", "info", None, _row_count(), "$ > 0"),
        ("total_columns", "info", None, F.lit(len(df.columns)), "rows > 0"),
    ]
    for c in REQUIRED:
        if c not in df.columns:
            found.append(("missing_column", "fatal", c, F.lit(1), "rows > 0"))
        elif not _is_numeric(df, c):
            found.append(("not_numeric", "issue", c, F.lit(1), "rows > 0"))
    usable = [c for c in REQUIRED if c in df.columns and _is_numeric(df, c)]
    if demand in usable:
        d = F.col(demand)
        found.append(("negative_demand", "warning", demand, F.count_if(d < 0), "$ > 0"))
        found.append(("huge_demand", "warning", demand, F.count_if(d > MAX_DEMAND), "$ > 0"))
    if cop in usable:
        c = F.col(cop)
        found.append(("cop_too_low", "warning", cop, F.count_if(c < COP_RANGE[0]), "$ > 0"))
        found.append(("cop_too_high", "warning", cop, F.count_if(c > COP_RANGE[1]), "$ > 0"))
    for c in df.columns:
        ratio = F.try_divide(_absent(c, df), _row_count())
        found.append(("missing_ratio", "info", c, ratio, "rows > 0"))
        found.append(("high_missing_ratio", "warning", c, ratio, f"$ > {max_missing_ratio}D"))
    for c in usable:
        for name, fn in (
            ("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_samp)
        ):
            found.append((name, "info", c, fn(c), "rows > 0"))
    return _report(df, found)


def _infinite_issues(df: DataFrame, severity: str) -> list[Finding]:
    return [
        ("infinite", severity, c, _infinite(c, df), "$ > 0") for c in numeric_columns(df)
    ]


def _rate_findings(label: str) -> list[Finding]:
    low, high = STRESS_RATE_RANGE
    return [
        ("low_stress_rate", "warning", label, F.avg(label), f"$ < {low}D"),
        ("high_stress_rate", "warning", label, F.avg(label), f"$ > {high}D"),
    ]


def check_processed(df: DataFrame, label: str = "stress_hour") -> DataFrame:
    """Label present, stress rate plausible, infinities, gaps in critical columns."""
    if label not in df.columns:
        return _report(df, [("missing_column", "fatal", label, F.lit(1), "rows >= 0")])
    found: list[Finding] = [
        *_rate_findings(label),
        *_infinite_issues(df, "issue"),
        ("total_rows", "info", None, _row_count(), "rows >= 0"),
        ("total_columns", "info", None, F.lit(len(df.columns)), "rows >= 0"),
        ("stress_rate", "info", label, F.avg(label), "rows > 0"),
        ("stress_hours", "info", label, F.sum(label), "rows > 0"),
        ("feature_columns", "info", None, F.lit(len(numeric_columns(df)) - 1), "rows >= 0"),
    ]
    for c in CRITICAL:
        if c in df.columns:
            found.append(("missing_critical", "issue", c, _absent(c, df), "$ > 0"))
    return _report(df, found)


def check_model_inputs(
    df: DataFrame, features: Sequence[str], label: str, labels: DataFrame | None = None
) -> DataFrame:
    """Lengths, gaps and infinities in features and label, classes and their ratio.

    ``labels`` is a separate label table to compare row counts with; by default the
    label is a column of ``df`` and the lengths agree by construction.
    """
    y = F.col(label)
    if labels is None:
        y_rows, low, high = _row_count(), F.min(label), F.max(label)
        low_n = F.count_if(y == 0)
        high_n = F.count_if(y == 1)
        y_missing = _absent(label, df)
        frame = df
    else:
        packed = labels.agg(
            F.struct(
                F.count(F.lit(1)).alias("rows"),
                F.min(label).alias("low"),
                F.max(label).alias("high"),
                F.count_if(y == 0).alias("low_n"),
                F.count_if(y == 1).alias("high_n"),
                _absent(label, labels).alias("missing"),
            )
        ).scalar()
        frame = df.withColumn("_y", packed)
        first = lambda field: F.coalesce(F.max(f"_y.{field}"), F.lit(0))
        y_rows, low, high = first("rows"), F.max("_y.low"), F.max("_y.high")
        low_n, high_n, y_missing = first("low_n"), first("high_n"), first("missing")
    classes = F.when(low.isNull(), 0).when(low == high, 1).otherwise(2)
    ratio = F.when(classes < 2, F.lit(0.0)).otherwise(F.try_divide(high_n, low_n))
    found: list[Finding] = [
        ("length_mismatch", "fatal", None, _row_count() - y_rows, "$ <> 0"),
        ("empty_features", "fatal", None, _row_count(), "$ = 0"),
        ("empty_target", "fatal", label, y_rows, "$ = 0"),
        ("missing_target", "issue", label, y_missing, "$ > 0"),
        ("single_class", "warning", label, classes, "$ < 2"),
        ("extreme_imbalance", "warning", label, ratio, f"$ < {CLASS_RATIO_LIMIT}D"),
        ("n_samples", "info", None, _row_count(), "rows >= 0"),
        ("n_features", "info", None, F.lit(len(features)), "rows >= 0"),
        ("n_classes", "info", label, classes, "rows >= 0"),
        ("class_0", "info", label, low_n, "rows >= 0"),
        ("class_1", "info", label, high_n, "rows >= 0"),
        ("class_ratio", "info", label, ratio, "rows >= 0"),
    ]
    for c in features:
        found.append(("missing_feature", "issue", c, _absent(c, df), "$ > 0"))
        found.append(("infinite_feature", "issue", c, _infinite(c, df), "$ > 0"))
    return _report(frame, found)


def check_results(metrics: DataFrame, keys: Sequence[str] = RESULT_KEYS) -> DataFrame:
    """Required keys and metrics present, metrics within [0, 1].

    ``metrics`` has one row per model; ``keys`` are the sections the results carry.
    """
    found: list[Finding] = [
        ("missing_key", "warning", k, F.lit(1), "rows >= 0") for k in RESULT_KEYS if k not in keys
    ]
    if "metrics" in keys:
        for m in RESULT_METRICS:
            if m not in metrics.columns:
                found.append(("missing_metric", "warning", m, F.lit(1), "rows >= 0"))
            else:
                outside = F.count_if(~F.col(m).between(0, 1))
                found.append(("out_of_range", "warning", m, outside, "$ > 0"))
    found.append(("models", "info", None, _row_count(), "rows >= 0"))
    return _report(metrics, found)


def guard_processed(df: DataFrame, required: Sequence[str] = CRITICAL) -> DataFrame:
    """Raise on missing columns or an empty table; return the remaining warnings."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    if df.isEmpty():
        raise ValueError("processed table is empty")
    return _report(df, [*_rate_findings("stress_hour"), *_infinite_issues(df, "warning")])
