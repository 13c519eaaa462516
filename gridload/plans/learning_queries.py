"""Queries that fit models, with the library's own settings, over all years.

Spark ML and random draws have no SQL twin. Beside the rows of each fitted query stands
a query of its properties, which SQL can state.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gridload.learn.classifiers import (
    KINDS,
    CostSensitiveClassifier,
    FittedClassifier,
    cost_weights,
)
from gridload.learn.tuning import Search, cross_validate, optimise_thresholds
from gridload.operators.folds import (
    fold_summary,
    stratified_folds,
    time_series_folds,
)
from gridload.operators.ordering import SeriesLayout
from gridload.plans.analysis import run_analysis
from gridload.plans.fixtures import daily, scored, with_views
from gridload.plans.registry import query, rounded
from gridload.prep.features import ANALYSIS_FEATURES, analysis_features
from gridload.session import discard, durable, new_path

FEATURES = list(ANALYSIS_FEATURES)
LABEL = "stress_hour"
#: the library's default; every trial draws all five dimensions
TRIALS = 50
GLOBAL = SeriesLayout(keys=(), span_hours=24 * 366)


def training_rows(spark, sf_dir):
    """Analysis features of all days; all years but the last train, the last is held out."""
    # thresholds, positions and windows read the days again and again, the orders once
    days = durable(daily(spark, sf_dir))
    rows = durable(
        analysis_features(days).withColumn(
            "row_id", F.concat_ws("|", "series", F.date_format("ts", "yyyyMMdd"))
        )
    )
    discard(days)
    year, last = F.year("ts"), rows.agg(F.max(F.year("ts"))).scalar()
    return rows.withColumns(
        {"in_train": (year < last).cast("int"), "in_val": (year == last).cast("int")}
    )


def fitted(rows, kind):
    return CostSensitiveClassifier(kind, 10.0).fit(rows.filter("in_train = 1"), FEATURES, LABEL)


def scores(kind):
    def run(spark, sf_dir):
        rows = training_rows(spark, sf_dir)
        out = fitted(rows, kind).score_rows(rows.filter("in_val = 1"))
        return out.select("series", "ts", LABEL, "y_proba", "y_pred")

    return run


for _kind in KINDS:
    query(f"fit_{_kind}")(scores(_kind))


def weights_sql(kind: str) -> str:
    weight = {"xgboost": "n0 / n1 * 10e0", "gradient_boosting": "1e0"}.get(kind, "10e0")
    return (
        with_views(
            "scored",
            (
                "c",
                """SELECT count_if(y_true = 0)::BIGINT AS n0, count_if(y_true = 1)::BIGINT AS n1
FROM scored""",
            ),
        )
        + f"""SELECT 0 AS "class", n0 AS rows, 1e0 AS weight FROM c
UNION ALL SELECT 1, n1, round({weight}, 9) FROM c"""
    )


def weights(kind):
    return lambda spark, sf_dir: rounded(cost_weights(scored(spark, sf_dir), kind, 10.0), 9)


for _kind in KINDS:
    query(f"cost_weights_{_kind}", weights_sql(_kind))(weights(_kind))


@query("decision_function")
def decision_function(spark, sf_dir):
    rows = training_rows(spark, sf_dir)
    out = fitted(rows, "logistic").decision_function(rows.filter("in_val = 1"))
    return out.select("series", "ts", "decision")


@query("predict_with_threshold")
def predict_with_threshold(spark, sf_dir):
    rows = training_rows(spark, sf_dir)
    out = fitted(rows, "random_forest").predict_with_threshold(rows.filter("in_val = 1"), 0.3)
    return out.select("series", "ts", LABEL, "y_pred")


@query("feature_importances")
def feature_importances(spark, sf_dir):
    return fitted(training_rows(spark, sf_dir), "random_forest").importances(spark)


@query("cross_validated_thresholds")
def cross_validated_thresholds(spark, sf_dir):
    rows = training_rows(spark, sf_dir)
    learner = CostSensitiveClassifier("logistic", 10.0)
    return optimise_thresholds(
        learner, rows.filter("in_val = 1"), FEATURES, LABEL, folds=3, row_id="row_id"
    )


@query("time_series_cross_validation")
def time_series_cross_validation(spark, sf_dir):
    rows = time_series_folds(training_rows(spark, sf_dir), 3, GLOBAL, ["series"])
    learner = CostSensitiveClassifier("logistic", 10.0)
    found = cross_validate(
        learner, rows, FEATURES, LABEL, folds=3, fold="test_fold", expanding=True,
        names=("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc"),
    )
    return found


@query("stratified_cross_validation")
def stratified_cross_validation(spark, sf_dir):
    rows = stratified_folds(training_rows(spark, sf_dir), 3, LABEL, "row_id")
    learner = CostSensitiveClassifier("logistic", 10.0)
    return fold_summary(cross_validate(learner, rows, FEATURES, LABEL, folds=3))


@query("hyperparameter_search")
def hyperparameter_search(spark, sf_dir):
    rows = training_rows(spark, sf_dir)
    search = Search("random_forest", "gmean", trials=TRIALS)
    search.tune(rows.filter("in_train = 1"), rows.filter("in_val = 1"), FEATURES, LABEL)
    path = new_path(spark, "search")
    search.save(spark, path)
    return Search.load(spark, path).table(spark)


@query("cost_ratio_sweep")
def cost_ratio_sweep(spark, sf_dir):
    rows = training_rows(spark, sf_dir)
    search = Search("random_forest", "f1", fixed={"n_estimators": 100, "max_depth": 15})
    search.tune_cost_ratio(rows.filter("in_train = 1"), rows.filter("in_val = 1"), FEATURES, LABEL)
    return search.table(spark)


@query("model_round_trip")
def model_round_trip(spark, sf_dir):
    """Scores of the reloaded model next to those of the original."""
    rows = training_rows(spark, sf_dir)
    model = fitted(rows, "gradient_boosting")
    path = new_path(spark, "model")
    model.save(path)
    val = rows.filter("in_val = 1")
    first = model.score_rows(val).select("row_id", "y_proba")
    again = FittedClassifier.load(path, spark).score_rows(val).select(
        "row_id", F.col("y_proba").alias("reloaded")
    )
    return first.join(again, "row_id")


@query("analysis_report")
def analysis_report(spark, sf_dir):
    """The whole main run: three models, outliers removed, three threshold folds."""
    return run_analysis(daily(spark, sf_dir)).report
