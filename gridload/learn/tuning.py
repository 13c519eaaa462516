"""Cross-validation, threshold search and hyper-parameter search over Spark fits.

The driver only holds settings, confusion counts and scores; every fit and every
evaluation is a Spark job over the whole fold. Training tables are written to the
checkpoint folder once, since iterative learners read them many times.

A search writes its tables once as feature vectors, in partitions of ``TASK_ROWS`` rows:
small tables take one task per job, and as many trials run side by side as then fit the
cores; large tables fill the cores with one trial. Costly trials start first.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridload.learn.classifiers import (
    NODE_MEMORY_MB,
    CostSensitiveClassifier,
    assembled,
    class_counts,
)
from gridload.operators.folds import fold_metrics, shuffled_folds
from gridload.operators.metrics import (
    OPTIMISED,
    best_thresholds,
    confusion_counts,
    curve_areas,
    metric,
    mean_thresholds,
    score_curve,
)
from gridload.session import discard, durable

# fixed values: search ranges (low, high) of the two model families
BOOSTED_RANGES = {
    "n_estimators": (50, 500),
    "max_depth": (3, 10),
    "learning_rate": (0.01, 0.3),
    "subsample": (0.6, 1.0),
    "colsample": (0.6, 1.0),
    "min_child_weight": (1, 10),
}
FOREST_RANGES = {
    "n_estimators": (50, 500),
    "max_depth": (3, 20),
    "min_samples_leaf": (1, 10),
    "max_features": ("sqrt", "log2", "all"),
    "bootstrap": (True, False),
}
COST_RANGE = (1.0, 20.0)
SEARCH_METRICS = ("gmean", "f1", "balanced_accuracy", "auc_pr")
COUNTS = ("tp", "fp", "tn", "fn")
#: rows per task of a search's tables, and histogram memory of a fit per such task: a fit
#: of few rows gains nothing from few passes, and many such fits share the memory
TASK_ROWS, TASK_MEMORY_MB = 250_000, 32


def fits_at_once(table: DataFrame, fits: int, tasks: int | None = None) -> int:
    """How many fits of ``tasks`` tasks (default: by the table's rows) the cores hold."""
    tasks = tasks or -(-table.count() // TASK_ROWS) or 1
    return max(1, min(fits, table.sparkSession.sparkContext.defaultParallelism // tasks))


def score_folds(
    learner: CostSensitiveClassifier,
    df: DataFrame,
    features: Sequence[str],
    label: str,
    folds: Sequence[int],
    fold: str = "fold",
    expanding: bool = False,
) -> DataFrame:
    """Out-of-fold scores: each fold is scored by a model fitted on the others
    (``expanding``: on the earlier ones only). Folds are fitted side by side."""
    table = durable(df)

    def one(f: int) -> DataFrame:
        rest = F.col(fold) < f if expanding else F.col(fold) != f
        model = learner.fit(table.filter(rest), features, label)
        return model.score_rows(table.filter(F.col(fold) == f))

    with ThreadPoolExecutor(fits_at_once(table, len(folds))) as pool:
        parts = list(pool.map(one, folds))
    return reduce(DataFrame.unionByName, parts)


def cross_validate(
    learner: CostSensitiveClassifier,
    df: DataFrame,
    features: Sequence[str],
    label: str = "y_true",
    folds: int = 5,
    fold: str = "fold",
    expanding: bool = False,
    names: Sequence[str] = ("accuracy", "precision", "recall", "f1"),
) -> DataFrame:
    """(fold, metric, score) of a table that carries its fold numbers.

    Stratified folds are numbered from 0, expanding ones from 1.
    """
    numbers = range(1, folds + 1) if expanding else range(folds)
    scored = score_folds(learner, df, features, label, list(numbers), fold, expanding)
    wants_scores = any(n in ("roc_auc", "pr_auc") for n in names)
    return fold_metrics(
        scored, fold, names, label, score="y_proba" if wants_scores else None
    )


def optimise_thresholds(
    learner: CostSensitiveClassifier,
    df: DataFrame,
    features: Sequence[str],
    label: str = "y_true",
    folds: int = 3,
    row_id: str = "event_id",
    seed: int = 42,
    names: Sequence[str] = OPTIMISED,
) -> DataFrame:
    """Cross-validated best threshold per metric. Fold models are discarded."""
    parts = shuffled_folds(df, folds, row_id, seed)
    scored = score_folds(learner, parts, features, label, list(range(folds)))
    return mean_thresholds(best_thresholds(scored, ["fold"], names, label))


def search_table(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Feature vectors, written once in partitions of about ``TASK_ROWS`` rows."""
    parts = max(1, -(-df.count() // TASK_ROWS))
    return durable(assembled(df, features, label).repartition(parts))


def trial_scores(trials: DataFrame, name: str) -> DataFrame:
    """Adds ``score`` to a table of trials with their confusion counts."""
    return trials.withColumn("score", metric(name))


def draw_settings(kind: str, rng: np.random.Generator) -> dict[str, object]:
    """One random point of the search space."""
    settings: dict[str, object] = {}
    ranges = BOOSTED_RANGES if kind == "xgboost" else FOREST_RANGES
    for name, choices in ranges.items():
        if name in ("max_features", "bootstrap"):
            settings[name] = choices[int(rng.integers(len(choices)))]
        elif name == "learning_rate":
            low, high = np.log(choices[0]), np.log(choices[1])
            settings[name] = float(np.exp(rng.uniform(low, high)))
        elif name == "colsample":
            settings[name] = f"{rng.uniform(*choices):.3f}"
        elif isinstance(choices[0], float):
            settings[name] = float(rng.uniform(*choices))
        else:
            settings[name] = int(rng.integers(choices[0], choices[1] + 1))
    if rng.random() < 0.5:
        settings["positive_weight"] = float(rng.uniform(*COST_RANGE))
    return settings


class Search:
    """Random hyper-parameter search scored on a validation table.

    ``parallel`` trials run at a time (default: as many as the cores hold).
    """

    def __init__(
        self,
        kind: str = "xgboost",
        metric: str = "gmean",
        trials: int = 50,
        seed: int = 42,
        parallel: int | None = None,
        fixed: dict[str, object] | None = None,
    ):
        if kind not in ("xgboost", "random_forest"):
            raise ValueError(f"unknown model type: {kind}")
        if metric not in SEARCH_METRICS:
            raise ValueError(f"unknown metric: {metric}")
        self.kind, self.metric, self.trials, self.seed = kind, metric, trials, seed
        self.parallel, self.fixed = parallel, fixed or {}
        self.results: list[dict[str, object]] = []

    def learner(self, settings: dict[str, object]) -> CostSensitiveClassifier:
        """The learner that a trial with these settings trains."""
        used = dict(settings)
        if self.kind == "random_forest":
            used.setdefault("positive_weight", "balanced")
        return CostSensitiveClassifier(
            self.kind, seed=self.seed, settings=used, weighting="positive_weight" in used
        )

    def best_model(self) -> CostSensitiveClassifier:
        """An unfitted learner with the settings and the weighting of the best trial."""
        return self.learner(self.best()["settings"])

    def _run(
        self, learner: CostSensitiveClassifier, train: DataFrame, counts: tuple[int, int],
        val: DataFrame, features: Sequence[str], label: str,
    ) -> dict[str, object]:
        """Confusion counts of one trial, and its curve area if that is the metric."""
        model = learner.fit_assembled(train, counts, features, label)
        scored = model.score_rows(val)
        if self.metric != "auc_pr":
            return confusion_counts(scored, label=label).first().asDict()
        scored = durable(scored.select(label, "y_proba", "y_pred"))
        found = confusion_counts(scored, label=label).first().asDict()
        areas = curve_areas(score_curve(scored, label=label)).first()
        discard(scored)
        return found | {"score": float(areas["auc_pr"])}

    @staticmethod
    def _cost(learner: CostSensitiveClassifier) -> int:
        """Levels of trees to grow: what a trial takes, up to a factor."""
        return int(learner.settings["n_estimators"]) * int(learner.settings["max_depth"])

    def _evaluate(self, points, train, val, features, label) -> list[dict[str, object]]:
        train, val = (search_table(t, features, label) for t in (train, val))
        counts = class_counts(train, label)
        spark, tasks = train.sparkSession, -(-sum(counts) // TASK_ROWS) or 1
        memory = {"node_memory_mb": min(NODE_MEMORY_MB, TASK_MEMORY_MB * tasks)}
        learners = [self.learner({**memory, **p}) for p in points]
        costly_first = sorted(range(len(points)), key=lambda i: -self._cost(learners[i]))
        width = self.parallel or fits_at_once(train, len(points), tasks)
        with ThreadPoolExecutor(width) as pool:
            jobs = {
                i: pool.submit(self._run, learners[i], train, counts, val, features, label)
                for i in costly_first
            }
            found = [jobs[i].result() for i in range(len(points))]
        for table in (train, val):
            discard(table)
        if self.metric != "auc_pr":
            rows = [(i, *(f[c] for c in COUNTS)) for i, f in enumerate(found)]
            names = ", ".join(f"{c} bigint" for c in COUNTS)
            table = spark.createDataFrame(rows, f"trial int, {names}")
            for r in trial_scores(table, self.metric).collect():
                found[r["trial"]]["score"] = float(r["score"])
        return [{"trial": i, "settings": points[i], **f} for i, f in enumerate(found)]

    def tune(
        self, train: DataFrame, val: DataFrame, features: Sequence[str], label: str = "y_true"
    ) -> dict[str, object]:
        """Best settings; the first of equal scores wins."""
        rng = np.random.default_rng(self.seed)
        points = [
            {**draw_settings(self.kind, rng), **self.fixed} for _ in range(self.trials)
        ]
        self.results = self._evaluate(points, train, val, features, label)
        return self.best()["settings"]

    def tune_cost_ratio(
        self,
        train: DataFrame,
        val: DataFrame,
        features: Sequence[str],
        label: str = "y_true",
        low: float = COST_RANGE[0],
        high: float = COST_RANGE[1],
        steps: int = 20,
    ) -> float:
        """Best of evenly spaced cost ratios; the first strict improvement wins."""
        points = [
            {**self.fixed, "positive_weight": float(r)} for r in np.linspace(low, high, steps)
        ]
        self.results = self._evaluate(points, train, val, features, label)
        best = self.best()
        return float(best["settings"]["positive_weight"]) if best["score"] > 0 else 1.0

    def best(self) -> dict[str, object]:
        return max(self.results, key=lambda r: (r["score"], -r["trial"]))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (r["trial"], r["score"], json.dumps(r["settings"], sort_keys=True), *(r[c] for c in COUNTS))
            for r in self.results
        ]
        names = ", ".join(f"{c} bigint" for c in COUNTS)
        schema = f"trial int, score double, settings string, {names}"
        return spark.createDataFrame(rows, schema).withColumns(
            {"model_type": F.lit(self.kind), "metric": F.lit(self.metric)}
        )

    def save(self, spark: SparkSession, path: str) -> None:
        self.table(spark).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Search:
        try:
            rows = spark.read.parquet(path).orderBy("trial").collect()
        except AnalysisException as missing:
            raise FileNotFoundError(f"no tuning results at {path}") from missing
        search = cls(rows[0]["model_type"], rows[0]["metric"], len(rows))
        search.results = [
            {"trial": r["trial"], "score": r["score"], "settings": json.loads(r["settings"])}
            | {c: r[c] for c in COUNTS}
            for r in rows
        ]
        return search
