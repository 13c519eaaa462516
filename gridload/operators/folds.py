"""Time-aware and stratified splits, as columns on the table rather than copies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridload.functions.calendar import flag
from gridload.operators.metrics import METRICS, evaluate
from gridload.operators.ordering import (
    DEFAULT_LAYOUT,
    SeriesLayout,
    add_position,
    time_position,
)


def _years(df: DataFrame, time: str) -> Column:
    """Sorted calendar years of the table, as a scalar array."""
    return df.agg(F.array_sort(F.collect_set(F.year(time))).alias("years")).scalar()


def year_split(df: DataFrame, time: str = "ts") -> DataFrame:
    """0/1 columns in_train, in_val, in_test by calendar year.

    With three or more years: train on the first two, validate and test on the third,
    later years unused. With fewer: train on the first, validate and test on the last.
    """
    years, year = F.col("_years"), F.year(time)
    many = F.size(years) >= 3
    held_out = F.when(many, F.get(years, F.lit(2))).otherwise(F.element_at(years, -1))
    train = (year == F.get(years, F.lit(0))) | (many & (year == F.get(years, F.lit(1))))
    return (
        df.withColumn("_years", _years(df, time))
        .withColumns(
            {
                "in_train": flag(train),
                "in_val": flag(year == held_out),
                "in_test": flag(year == held_out),
            }
        )
        .drop("_years")
    )


def rolling_origins(df: DataFrame, min_train_years: int = 2, time: str = "ts") -> DataFrame:
    """True rolling origin: per held-out year, all earlier years train.

    Adds ``train_from_fold``: a row trains every fold at or above that number and is
    tested in ``test_fold`` (0: never). Fold f holds out year number min_train_years+f.
    """
    number = F.array_position(F.col("_years"), F.year(time)).cast("int")
    fold = F.greatest(number - min_train_years, F.lit(0))
    return (
        df.withColumn("_years", _years(df, time))
        .withColumn("test_fold", fold)
        .withColumn("train_from_fold", fold + 1)
        .drop("_years")
    )


def time_series_folds(
    df: DataFrame,
    folds: int = 5,
    layout: SeriesLayout = DEFAULT_LAYOUT,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Expanding folds: ``test_fold`` f is tested in fold f and trains all later ones.

    Blocks have floor(n / (folds + 1)) rows; the rows before the first block have
    fold 0 and only train. Positions count within the layout's keys (none: globally).
    """
    placed = time_position(df, layout, "_row", total="_rows", ties=ties)
    block = F.floor(F.col("_rows") / (folds + 1))
    first = F.col("_rows") - block * folds
    fold = F.floor(F.try_divide(F.col("_row") - first, block)) + 1
    return placed.withColumn(
        "test_fold",
        F.when((block > 0) & (F.col("_row") >= first), fold).otherwise(F.lit(0)).cast("int"),
    ).drop("_row", "_rows")


def fold_sizes(df: DataFrame, folds: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, fold, train_size, val_size) of expanding folds."""
    counts = df.groupBy(*keys).agg(
        *[F.count_if(F.col("test_fold") < i).alias(f"_train{i}") for i in range(1, folds + 1)],
        *[F.count_if(F.col("test_fold") == i).alias(f"_val{i}") for i in range(1, folds + 1)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("fold"),
                F.col(f"_train{i}").alias("train_size"),
                F.col(f"_val{i}").alias("val_size"),
            )
            for i in range(1, folds + 1)
        ]
    )
    return counts.select(*keys, F.explode(rows).alias("f")).select(*keys, "f.*")


def _shuffled(df: DataFrame, strata: Sequence[str], row_id: str, seed: int) -> DataFrame:
    """Position of rows in the order of a seeded hash; hash prefixes are the buckets."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")))
    hashed = df.withColumn("_digest", digest)
    bucket = F.conv(F.substring("_digest", 1, 4), 16, 10).cast("bigint")
    return add_position(hashed, strata, ["_digest", row_id], bucket, "_row").drop("_digest")


def stratified_folds(
    df: DataFrame,
    folds: int = 5,
    label: str = "y_true",
    row_id: str = "event_id",
    seed: int = 42,
) -> DataFrame:
    """Shuffled folds 0..folds-1 with each class spread evenly."""
    placed = _shuffled(df, [label], row_id, seed)
    return placed.withColumn("fold", (F.col("_row") % folds).cast("int")).drop("_row")


def shuffled_folds(
    df: DataFrame, folds: int = 5, row_id: str = "event_id", seed: int = 42
) -> DataFrame:
    """Plain shuffled folds 0..folds-1 of equal size."""
    placed = _shuffled(df, [], row_id, seed)
    return placed.withColumn("fold", (F.col("_row") % folds).cast("int")).drop("_row")


def temporal_split(
    df: DataFrame,
    train_share: float = 0.8,
    layout: SeriesLayout = DEFAULT_LAYOUT,
    ties: Sequence[str] = (),
) -> DataFrame:
    """``in_train`` = 1 for the first share of rows in time order."""
    placed = time_position(df, layout, "_row", total="_rows", ties=ties)
    limit = F.floor(F.col("_rows") * F.lit(train_share))
    return placed.withColumn("in_train", flag(F.col("_row") < limit)).drop("_row", "_rows")


SCORE_METRICS = {"roc_auc": "auc_roc", "pr_auc": "auc_pr"}


def fold_metrics(
    df: DataFrame,
    fold: str = "fold",
    names: Sequence[str] = ("accuracy", "precision", "recall", "f1"),
    label: str = "y_true",
    predicted: str = "y_pred",
    score: str | None = None,
) -> DataFrame:
    """(fold, metric, score) rows; unknown metric names score 0."""
    per_fold = evaluate(df, [fold], label, predicted, score)

    def value(name: str) -> Column:
        column = SCORE_METRICS.get(name, name)
        if column in METRICS or column in per_fold.columns:
            return F.col(column) if column in per_fold.columns else F.lit(0.0)
        return F.lit(0.0)

    rows = F.array(
        *[
            F.struct(F.lit(n).alias("metric"), value(n).cast("double").alias("score"))
            for n in names
        ]
    )
    return per_fold.select(fold, F.explode(rows).alias("m")).select(fold, "m.*")


def fold_summary(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, population standard deviation, min and max per metric."""
    return scores.groupBy(*keys, "metric").agg(
        F.avg("score").alias("mean"),
        F.stddev_pop("score").alias("std"),
        F.min("score").alias("min"),
        F.max("score").alias("max"),
    )
