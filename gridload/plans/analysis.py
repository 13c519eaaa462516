"""The whole analysis: label, features, year split, models, thresholds, response."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridload.learn.classifiers import CostSensitiveClassifier, FittedClassifier
from gridload.learn.tuning import fits_at_once, optimise_thresholds
from gridload.operators.folds import year_split
from gridload.operators.metrics import optimal_report
from gridload.operators.ordering import DEFAULT_LAYOUT, SeriesLayout
from gridload.operators.response import SCENARIOS, trigger_estimates
from gridload.operators.stress import COP, DEMAND, seasonal_thresholds, stress_rate
from gridload.prep.features import (
    ANALYSIS_FEATURES,
    Preprocessor,
    analysis_features,
    keep_surviving,
)
from gridload.session import discard, durable

MODEL_KINDS = {
    "logistic_regression": ("logistic", {}),
    "gradient_boosting": (
        "gradient_boosting",
        {"n_estimators": 100, "max_depth": 4, "learning_rate": 0.1},
    ),
    "xgboost": ("xgboost", {"n_estimators": 100, "max_depth": 4, "learning_rate": 0.1}),
}


@dataclass
class Analysis:
    """Tables and models of one run."""

    features: DataFrame
    thresholds: DataFrame
    models: dict[str, FittedClassifier]
    decision: dict[str, float]
    report: DataFrame
    response: DataFrame
    metadata: dict[str, object]


def prepare_rows(
    df: DataFrame,
    outliers: bool = True,
    demand: str = DEMAND,
    cop: str = COP,
    layout: SeriesLayout = DEFAULT_LAYOUT,
) -> tuple[DataFrame, DataFrame]:
    """(feature rows with split flags, seasonal thresholds).

    Thresholds, outlier forest and scaler are all learned on the training years.
    """
    # read for years, thresholds, positions and windows: what makes it runs once
    source = durable(df)
    split = year_split(source, layout.time)
    training = split.filter("in_train = 1")
    thresholds = durable(seasonal_thresholds(training, layout.keys, demand, cop))
    rows = durable(analysis_features(split, thresholds, demand, cop, layout))
    discard(source)
    keys = (*layout.keys, layout.time)
    steps = Preprocessor(
        imputation="none",
        scaling="robust",
        outliers=outliers,
        features=ANALYSIS_FEATURES,
        label_rows=False,
        layout=layout,
    )
    model = steps.fit(rows.filter("in_train = 1").select(*keys, *ANALYSIS_FEATURES))
    processed = model.transform(rows.select(*keys, *ANALYSIS_FEATURES))
    # the clock hour stays available for the response step
    clock = rows.withColumn("_clock", F.hour(layout.time))
    return durable(keep_surviving(clock, processed, ANALYSIS_FEATURES, keys)), thresholds


def run_analysis(
    df: DataFrame,
    kinds: dict[str, tuple[str, dict]] | None = None,
    scenarios: Sequence[dict] = (SCENARIOS[0], SCENARIOS[2]),
    cost_ratio: float = 10.0,
    folds: int = 3,
    outliers: bool = True,
    demand: str = DEMAND,
    cop: str = COP,
    layout: SeriesLayout = DEFAULT_LAYOUT,
    description: dict[str, object] | None = None,
) -> Analysis:
    """Train on the first years, tune thresholds and evaluate on the held-out year.

    Threshold folds train copies; the evaluated model is the one of the training
    years.
    """
    label, features = "stress_hour", list(ANALYSIS_FEATURES)
    rows, thresholds = prepare_rows(df, outliers, demand, cop, layout)
    train = rows.filter("in_train = 1")
    val = rows.filter("in_val = 1")
    row_id = F.concat_ws("|", *layout.keys, F.col(layout.time).cast("string"))

    def tuned(learner: CostSensitiveClassifier) -> float:
        found = optimise_thresholds(
            learner, val.withColumn("_id", row_id), features, label, folds, "_id", names=["f1"]
        )
        return float(found.first()["threshold"])

    # neither models nor their threshold folds depend on each other: their many small
    # jobs share the cluster
    learners = {
        name: CostSensitiveClassifier(kind, cost_ratio, settings=settings)
        for name, (kind, settings) in (kinds or MODEL_KINDS).items()
    }
    width = max(len(learners), fits_at_once(rows, 2 * len(learners)))
    with ThreadPoolExecutor(width) as pool:
        fits = {name: pool.submit(w.fit, train, features, label) for name, w in learners.items()}
        searches = {name: pool.submit(tuned, w) for name, w in learners.items()}
        models = {name: job.result() for name, job in fits.items()}
        decision = {name: job.result() for name, job in searches.items()}
    parts = [
        model.score_rows(val).select(
            F.lit(name).alias("model"),
            F.explode(F.array(F.lit("val"), F.lit("test"))).alias("part"),
            F.col(label).alias("y_true"),
            "y_proba",
        )
        for name, model in models.items()
    ]
    scored = reduce(DataFrame.unionByName, parts)
    report = optimal_report(scored, decision, ["model", "part"])
    best = models.get("gradient_boosting") or next(iter(models.values()))
    response = trigger_estimates(
        best.score_rows(rows), scenarios, demand=demand, time=layout.time
    )
    rate = stress_rate(rows).first()["stress_rate"]
    metadata = {
        "analysis_type": "year_split",
        "num_features": len(features),
        "stress_rate": float(rate or 0.0),
        "evaluation_method": "rolling_origin_validation",
        "imbalanced_data_handling": "cost_sensitive_learning + threshold_optimization",
        **(description or {}),
    }
    return Analysis(rows, thresholds, models, decision, report, response, metadata)
