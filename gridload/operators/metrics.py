"""Metrics for imbalanced binary classification, from two small aggregates.

Everything derives from (a) one confusion-count row per group and (b) a curve with
one row per distinct score. Raw rows are shuffled once, already collapsed by score.
Group keys (model, fold, ...) are arbitrary; labels are 0/1.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridload.functions.calendar import flag
from gridload.functions.scalars import fixed
from gridload.operators.ordering import running_totals, split_index

LABEL, SCORE, PREDICTED = "y_true", "y_proba", "y_pred"
OPTIMISED = ("f1", "gmean", "balanced_accuracy", "youden")
THRESHOLD_METRICS = (
    "accuracy", "precision", "recall", "f1", "gmean", "balanced_accuracy", "youden_j"
)
# fixed values: 81 decision thresholds from 0.10 to 0.90
THRESHOLD_GRID = tuple(float(t) for t in np.linspace(0.1, 0.9, 81))
# fixed values: inner edges of ten equal score bins
BIN_EDGES = tuple(float(e) for e in np.linspace(0.0, 1.0, 11)[1:-1])


def predict_at(threshold: float | Column, score: str = SCORE) -> Column:
    """1 where the score reaches the threshold."""
    limit = F.lit(float(threshold)) if isinstance(threshold, int | float) else threshold
    return flag(F.col(score) >= limit)


def decision_value(score: str = SCORE) -> Column:
    """Probability margin ``p1 - p0``."""
    return F.col(score) - (1 - F.col(score))


def ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def confusion_counts(
    df: DataFrame,
    keys: Sequence[str] = (),
    label: str = LABEL,
    predicted: str = PREDICTED,
) -> DataFrame:
    """tp, fp, tn, fn per group (raw counts, also when only one class occurs)."""
    return df.groupBy(*keys).agg(*_confusion_aggregates(label, predicted))


def _confusion_aggregates(label: str, predicted: str) -> list[Column]:
    y, p = F.col(label), F.col(predicted)
    return [
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
    ]


def two_classes() -> Column:
    """Labels and predictions together hold both classes."""
    has_one = F.col("tp") + F.col("fp") + F.col("fn") > 0
    has_zero = F.col("tn") + F.col("fp") + F.col("fn") > 0
    return has_one & has_zero


def _raw_rates() -> tuple[Column, Column]:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return ratio(tp, tp + fn), ratio(tn, tn + fp)


def _when_two(value: Column) -> Column:
    return F.when(two_classes(), value).otherwise(F.lit(0.0))


METRICS: dict[str, Callable[[], Column]] = {
    "accuracy": lambda: ratio(
        F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    ),
    "precision": lambda: ratio(F.col("tp"), F.col("tp") + F.col("fp")),
    "recall": lambda: ratio(F.col("tp"), F.col("tp") + F.col("fn")),
    "f1": lambda: ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
    "sensitivity": lambda: _when_two(_raw_rates()[0]),
    "specificity": lambda: _when_two(_raw_rates()[1]),
    "gmean": lambda: _when_two(F.sqrt(_raw_rates()[0] * _raw_rates()[1])),
    "balanced_accuracy": lambda: _when_two((_raw_rates()[0] + _raw_rates()[1]) / 2),
    "youden_j": lambda: _when_two(_raw_rates()[0]) + _when_two(_raw_rates()[1]) - 1,
    "false_positive_rate": lambda: _when_two(
        ratio(F.col("fp"), F.col("fp") + F.col("tn"))
    ),
    "false_negative_rate": lambda: _when_two(
        ratio(F.col("fn"), F.col("fn") + F.col("tp"))
    ),
    "positive_predictive_value": lambda: _when_two(
        ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    ),
    "negative_predictive_value": lambda: _when_two(
        ratio(F.col("tn"), F.col("tn") + F.col("fn"))
    ),
}
METRICS["youden"] = METRICS["youden_j"]


def metric(name: str) -> Column:
    """Metric by name over confusion columns; unknown names are an error."""
    if name not in METRICS:
        raise ValueError(f"unknown metric: {name}")
    return METRICS[name]()


def confusion_matrix(
    df: DataFrame, keys: Sequence[str] = (), label: str = LABEL, predicted: str = PREDICTED
) -> DataFrame:
    """tn, fp, fn, tp; all zero when only one class occurs at all."""
    counts = confusion_counts(df, keys, label, predicted)
    both = two_classes()
    return counts.select(
        *keys,
        *[F.when(both, F.col(c)).otherwise(F.lit(0)).alias(c) for c in ("tn", "fp", "fn", "tp")],
    )


def label_metrics(
    df: DataFrame,
    keys: Sequence[str] = (),
    names: Sequence[str] = tuple(m for m in METRICS if m != "youden"),
    label: str = LABEL,
    predicted: str = PREDICTED,
) -> DataFrame:
    """Chosen label metrics, one row per group."""
    counts = confusion_counts(df, keys, label, predicted)
    return counts.select(*keys, *[metric(n).alias(n) for n in names])


def score_curve(
    df: DataFrame, keys: Sequence[str] = (), label: str = LABEL, score: str = SCORE
) -> DataFrame:
    """One row per distinct score with the confusion counts of ``score >= threshold``.

    Columns: keys, threshold, pos, neg (rows at this score), tp, fp, tn, fn.
    """
    collapsed = (
        df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(*keys, F.col(score).alias("threshold"))
        .agg(
            F.count_if(F.col(label) == 1).alias("pos"),
            F.count_if(F.col(label) != 1).alias("neg"),
        )
    )
    ranked = running_totals(collapsed, keys, "threshold", ["pos", "neg"], descending=True)
    return ranked.select(
        *keys,
        "threshold",
        "pos",
        "neg",
        F.col("cum_pos").alias("tp"),
        F.col("cum_neg").alias("fp"),
        (F.col("total_neg") - F.col("cum_neg")).alias("tn"),
        (F.col("total_pos") - F.col("cum_pos")).alias("fn"),
    )


def curve_areas(curve: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """auc_roc (trapezoid), auc_pr (step-wise average precision), pr_area (trapezoid).

    Each curve row adds the slice between itself and the row before it, whose counts
    are known from its own (tp - pos, fp - neg); so this is a plain aggregate.
    """
    tp, fp = F.col("tp"), F.col("fp")
    pos, neg = F.col("pos"), F.col("neg")
    p_total, n_total = tp + F.col("fn"), fp + F.col("tn")
    here = F.try_divide(tp, tp + fp)
    before = F.when(tp + fp == pos + neg, F.lit(1.0)).otherwise(
        F.try_divide(tp - pos, tp - pos + fp - neg)
    )
    return curve.groupBy(*keys).agg(
        F.max(p_total).alias("_p"),
        F.max(n_total).alias("_n"),
        F.sum(neg * (tp - pos) + neg * pos / F.lit(2.0)).alias("_roc"),
        F.sum(pos * here).alias("_ap"),
        F.sum(pos * (here + before) / 2).alias("_pr"),
    ).select(
        *keys,
        F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_roc") / (F.col("_p") * F.col("_n")))
        .otherwise(F.lit(0.5))
        .alias("auc_roc"),
        F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_ap") / F.col("_p"))
        .otherwise(F.lit(0.5))
        .alias("auc_pr"),
        F.try_divide(F.col("_pr"), F.col("_p")).alias("pr_area"),
    )


def pr_curve(df: DataFrame, keys: Sequence[str] = (), **columns: str) -> DataFrame:
    """(keys, threshold, precision, recall) at every distinct score."""
    curve = score_curve(df, keys, **columns)
    return curve.select(
        *keys, "threshold", metric("precision").alias("precision"), metric("recall").alias("recall")
    )


def pr_summary(
    df: DataFrame, keys: Sequence[str] = (), label: str = LABEL, score: str = SCORE
) -> DataFrame:
    """Trapezoid area under the precision-recall curve and the positive-rate baseline."""
    curve = score_curve(df, keys, label, score)
    base = curve.groupBy(*keys).agg(
        (F.sum("pos") / F.sum(F.col("pos") + F.col("neg"))).alias("baseline")
    )
    return _side_by_side(curve_areas(curve, keys).select(*keys, "pr_area"), base, keys)


def _side_by_side(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join two one-row-per-group tables; without keys both have a single row."""
    if keys:
        return left.join(right, list(keys))
    packed = right.select(F.struct("*")).scalar()
    return left.withColumn("_right", packed).select("*", "_right.*").drop("_right")


def brier_score(
    df: DataFrame, keys: Sequence[str] = (), label: str = LABEL, score: str = SCORE
) -> DataFrame:
    gap = F.col(score) - F.col(label)
    return df.groupBy(*keys).agg(F.avg(gap * gap).alias("brier_score"))


def evaluate(
    df: DataFrame,
    keys: Sequence[str] = (),
    label: str = LABEL,
    predicted: str = PREDICTED,
    score: str | None = SCORE,
    with_balance: bool = False,
) -> DataFrame:
    """All metrics in one row per group; without ``score`` the label metrics only."""
    keys = list(keys)
    names = [m for m in METRICS if m != "youden"]
    aggregates = _confusion_aggregates(label, predicted)
    kept = []
    if score is not None:
        gap = F.col(score) - F.col(label)
        aggregates.append(F.avg(gap * gap).alias("brier_score"))
        kept.append("brier_score")
    both = two_classes()
    bundle = df.groupBy(*keys).agg(*aggregates).select(
        *keys,
        *[metric(n).alias(n) for n in names],
        *[F.when(both, F.col(c)).otherwise(F.lit(0)).alias(c) for c in ("tn", "fp", "fn", "tp")],
        *kept,
        (F.col("tp") + F.col("fn")).alias("_pos"),
        (F.col("tn") + F.col("fp")).alias("_neg"),
    )
    if not with_balance:
        bundle = bundle.drop("_pos", "_neg")
    if score is None:
        return bundle
    areas = curve_areas(score_curve(df, keys, label, score), keys).drop("pr_area")
    return _side_by_side(bundle, areas, keys)


def evaluation_record(
    df: DataFrame,
    model: str = "model",
    label: str = LABEL,
    predicted: str = PREDICTED,
    score: str | None = SCORE,
) -> DataFrame:
    """``evaluate`` per model plus class balance and sample counts."""
    positives, negatives = F.col("_pos"), F.col("_neg")
    total = positives + negatives
    two = (positives > 0) & (negatives > 0)
    minority, majority = F.least(positives, negatives), F.greatest(positives, negatives)
    return (
        evaluate(df, [model], label, predicted, score, with_balance=True)
        .withColumns(
            {
                "total_samples": total,
                "positive_samples": positives,
                "negative_samples": negatives,
                "imbalance_ratio": F.when(two, F.try_divide(majority, minority)),
                "minority_class_rate": F.when(two, minority / total),
                "positive_rate": ratio(positives, total),
            }
        )
        .drop("_pos", "_neg")
    )


# fixed values: report column of each metric
COMPARISON_COLUMNS = {
    "accuracy": "Accuracy",
    "precision": "Precision",
    "recall": "Recall",
    "f1": "F1-score",
    "gmean": "G-mean",
    "balanced_accuracy": "Balanced Accuracy",
    "specificity": "Specificity",
    "sensitivity": "Sensitivity",
    "auc_roc": "AUC-ROC",
    "auc_pr": "AUC-PR",
}


def compare_models(
    evaluations: DataFrame, primary_metric: str = "gmean", model: str = "model"
) -> DataFrame:
    """Model comparison sorted by the primary metric (metric or report name)."""
    shown = {m: c for m, c in COMPARISON_COLUMNS.items() if m in evaluations.columns}
    by_name = {c: m for m, c in shown.items()}
    chosen = by_name.get(primary_metric, primary_metric)
    if chosen not in shown:
        raise ValueError(f"unknown metric: {primary_metric}")
    return evaluations.orderBy(F.desc(chosen), model).select(
        F.col(model).alias("Model"), *[F.col(m).alias(c) for m, c in shown.items()]
    )


def classification_report(
    df: DataFrame,
    keys: Sequence[str] = (),
    label: str = LABEL,
    predicted: str = PREDICTED,
    names: Sequence[str] = ("No Stress", "Stress"),
) -> DataFrame:
    """Per-class precision, recall, f1 and support, with accuracy and averages."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    total = tp + fp + tn + fn

    def line(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            precision.cast("double").alias("precision"),
            recall.cast("double").alias("recall"),
            f1.alias("f1"),
            support.alias("support"),
        )

    per_class = [
        (ratio(tn, tn + fn), ratio(tn, tn + fp), ratio(2 * tn, 2 * tn + fn + fp), tn + fp),
        (ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(2 * tp, 2 * tp + fn + fp), tp + fn),
    ]

    def mean(i: int) -> Column:
        return (per_class[0][i] + per_class[1][i]) / 2

    def weighted(i: int) -> Column:
        return ratio(
            per_class[0][i] * per_class[0][3] + per_class[1][i] * per_class[1][3], total
        )

    lines = [line(n, *parts) for n, parts in zip(names, per_class, strict=True)]
    lines.append(line("accuracy", F.lit(None), F.lit(None), metric("accuracy"), total))
    lines.append(line("macro avg", mean(0), mean(1), mean(2), total))
    lines.append(line("weighted avg", weighted(0), weighted(1), weighted(2), total))
    return (
        confusion_counts(df, keys, label, predicted)
        .select(*keys, F.explode(F.array(*lines)).alias("line"))
        .select(*keys, "line.*")
    )


def _literal_doubles(values: Sequence[float]) -> Column:
    return F.expr("array(" + ", ".join(f"{v!r}D" for v in values) + ")")


def reliability_bins(
    df: DataFrame, keys: Sequence[str] = (), label: str = LABEL, score: str = SCORE
) -> DataFrame:
    """Ten equal score bins, right-closed; empty bins are absent."""
    bins = split_index(_literal_doubles(BIN_EDGES), F.col(score), len(BIN_EDGES))
    return (
        df.filter(F.col(score).isNotNull())
        .groupBy(*keys, bins.alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.avg(score).alias("mean_predicted"),
            F.avg(label).alias("fraction_positive"),
        )
    )


def best_thresholds(
    df: DataFrame,
    keys: Sequence[str] = (),
    names: Sequence[str] = OPTIMISED,
    label: str = LABEL,
    score: str = SCORE,
) -> DataFrame:
    """(keys, metric, threshold, score): best distinct score per metric.

    The lowest threshold wins ties. Without rows the result is (0.5, 0) per metric
    for an unkeyed call.
    """
    curve = score_curve(df, keys, label, score)
    wide = curve.groupBy(*keys).agg(
        *[
            F.max(F.struct(metric(n).alias("s"), (-F.col("threshold")).alias("t"))).alias(n)
            for n in names
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("metric"),
                F.coalesce(-F.col(f"{n}.t"), F.lit(0.5)).alias("threshold"),
                F.coalesce(F.col(f"{n}.s"), F.lit(0.0)).alias("score"),
            )
            for n in names
        ]
    )
    return wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def mean_thresholds(per_fold: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Average threshold and score over folds, per metric."""
    return per_fold.groupBy(*keys, "metric").agg(
        F.avg("threshold").alias("threshold"), F.avg("score").alias("score")
    )


def metrics_at(
    df: DataFrame,
    threshold: float,
    keys: Sequence[str] = (),
    label: str = LABEL,
    score: str = SCORE,
) -> DataFrame:
    labelled = df.withColumn(PREDICTED, predict_at(threshold, score))
    return label_metrics(labelled, keys, THRESHOLD_METRICS, label, PREDICTED)


def threshold_analysis(
    df: DataFrame,
    keys: Sequence[str] = (),
    grid: Sequence[float] = THRESHOLD_GRID,
    label: str = LABEL,
    score: str = SCORE,
) -> DataFrame:
    """The seven metrics at every grid threshold.

    Rows are first counted by how many grid points they reach, so what is accumulated
    has at most ``len(grid) + 1`` rows per group.
    """
    # grid points <= score: all of them minus those above it (on negated values)
    above = split_index(
        _literal_doubles([-t for t in reversed(grid)]), -F.col(score), len(grid)
    )
    counts = (
        df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(*keys, (F.lit(len(grid)) - above).alias("reached"))
        .agg(
            F.count_if(F.col(label) == 1).alias("pos"),
            F.count_if(F.col(label) != 1).alias("neg"),
        )
    )
    cells = counts.groupBy(*keys).agg(
        F.collect_list(F.struct("reached", "pos", "neg")).alias("cells")
    )

    def total(field: str, condition: Callable[[Column], Column]) -> Column:
        return F.aggregate(
            F.filter("cells", lambda c: condition(c["reached"])),
            F.lit(0).cast("bigint"),
            lambda acc, c: acc + c[field],
        )

    expanded = cells.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(len(grid)))))
    counted = expanded.select(
        *keys,
        F.get(_literal_doubles(grid), F.col("i") - 1).alias("threshold"),
        total("pos", lambda r: r >= F.col("i")).alias("tp"),
        total("neg", lambda r: r >= F.col("i")).alias("fp"),
        total("neg", lambda r: r < F.col("i")).alias("tn"),
        total("pos", lambda r: r < F.col("i")).alias("fn"),
    )
    return counted.select(
        *keys, "threshold", *[metric(n).alias(n) for n in THRESHOLD_METRICS]
    )


def optimal_report(
    df: DataFrame,
    thresholds: dict[str, float] | DataFrame,
    keys: Sequence[str] = ("model",),
    default: float = 0.5,
    label: str = LABEL,
    score: str = SCORE,
) -> DataFrame:
    """Metrics at the optimised and at the default threshold, and what changed.

    ``thresholds`` is a ``{model: threshold}`` dict or a (keys, threshold) table with
    one row per group. ``df`` carries the split as one of the keys when several
    splits are reported.
    """
    keys = list(keys)
    if isinstance(thresholds, dict):
        lookup = F.create_map(
            *[F.lit(v) for pair in thresholds.items() for v in (pair[0], float(pair[1]))]
        )
        marked = df.withColumn("optimal_threshold", lookup[F.col(keys[0])])
    else:
        on = [c for c in thresholds.columns if c in keys]
        marked = df.join(
            thresholds.select(*on, F.col("threshold").alias("optimal_threshold")), on
        )
    y = F.col(label)
    limits = {"optimal": F.col("optimal_threshold"), "default": F.lit(float(default))}
    aggregates = [F.max("optimal_threshold").alias("optimal_threshold")]
    for kind, limit in limits.items():
        hit = F.col(score) >= limit
        aggregates += [
            F.count_if((y == 1) & hit).alias(f"{kind}_tp"),
            F.count_if((y == 0) & hit).alias(f"{kind}_fp"),
            F.count_if((y == 0) & ~hit).alias(f"{kind}_tn"),
            F.count_if((y == 1) & ~hit).alias(f"{kind}_fn"),
        ]
    aggregates.append(F.avg((F.col(score) - y) * (F.col(score) - y)).alias("brier_score"))
    counts = marked.groupBy(*keys).agg(*aggregates)
    names = ("f1", "precision", "recall", "accuracy", "gmean", "balanced_accuracy")
    report = counts
    for kind in limits:
        report = report.withColumns(
            {c: F.col(f"{kind}_{c}") for c in ("tp", "fp", "tn", "fn")}
        ).withColumns({f"{n}_{kind}": metric(n) for n in names})
    report = report.withColumns(
        {
            f"{n}_improvement": F.col(f"{n}_optimal") - F.col(f"{n}_default")
            for n in ("f1", "gmean", "balanced_accuracy")
        }
    ).drop("tp", "fp", "tn", "fn")
    areas = curve_areas(score_curve(df, keys, label, score), keys).select(
        *keys, F.col("auc_roc").alias("roc_auc"), F.col("auc_pr").alias("pr_auc")
    )
    return report.join(areas, keys)


# fixed values: display names of the trained models
MODEL_TITLES = {
    "logistic_regression": "Logistic Regression",
    "gradient_boosting": "Gradient Boosting",
    "xgboost": "XGBoost",
}


def model_title(model: str) -> Column:
    titles = F.create_map(*[F.lit(v) for pair in MODEL_TITLES.items() for v in pair])
    return F.coalesce(titles[F.col(model)], F.col(model))


def performance_table(report: DataFrame, model: str = "model") -> DataFrame:
    """Report table: optimal-threshold metrics as four-decimal text."""
    columns = {
        "Accuracy": "accuracy_optimal",
        "Precision": "precision_optimal",
        "Recall": "recall_optimal",
        "F1-Score": "f1_optimal",
        "G-Mean": "gmean_optimal",
        "Balanced Accuracy": "balanced_accuracy_optimal",
        "AUC-ROC": "roc_auc",
        "AUC-PR": "pr_auc",
        "Optimal Threshold": "optimal_threshold",
    }
    return report.select(
        model_title(model).alias("Model"), *[fixed(c, 4).alias(t) for t, c in columns.items()]
    )


def threshold_table(report: DataFrame, model: str = "model") -> DataFrame:
    """Report table: default-threshold F1 and the gains from the optimal one."""
    columns = {
        "Default Threshold (0.5)": "f1_default",
        "Optimal Threshold": "optimal_threshold",
        "F1-Score Improvement": "f1_improvement",
        "G-Mean Improvement": "gmean_improvement",
        "Balanced Accuracy Improvement": "balanced_accuracy_improvement",
    }
    return report.select(
        model_title(model).alias("Model"), *[fixed(c, 4).alias(t) for t, c in columns.items()]
    )


def scenario_table(evaluations: DataFrame, model: str = "model") -> DataFrame:
    """Report table: five metrics as three-decimal text."""
    columns = {
        "PR-AUC": "auc_pr",
        "F1-Score": "f1",
        "Brier Score": "brier_score",
        "G-mean": "gmean",
        "Balanced Accuracy": "balanced_accuracy",
    }
    return evaluations.select(
        F.col(model).alias("Model"), *[fixed(c, 3).alias(t) for t, c in columns.items()]
    )


def model_pairs(df: DataFrame, model: str = "model") -> DataFrame:
    """Ordered pairs of distinct model names (as many names as models compared)."""
    names = df.agg(F.array_sort(F.collect_set(model)).alias("names"))
    return (
        names.select(F.explode("names").alias("model_1"), "names")
        .select("model_1", F.explode("names").alias("model_2"))
        .filter(F.col("model_1") != F.col("model_2"))
    )


def best_model(evaluations: DataFrame, by: str = "f1", model: str = "model") -> DataFrame:
    """Name of the best model; the first name wins ties."""
    return evaluations.orderBy(F.desc(by), model).limit(1).select(model, by)
