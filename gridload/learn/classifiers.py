"""Cost-weighted classifiers on Spark ML, with thresholds and persistence."""

from __future__ import annotations

import json
import logging
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridload.operators.metrics import PREDICTED, SCORE, metrics_at, predict_at
from gridload.session import allow_checkpoints

log = logging.getLogger(__name__)

KINDS = ("xgboost", "random_forest", "logistic", "gradient_boosting")
ALIASES = {
    "xgb": "xgboost",
    "rf": "random_forest",
    "logistic_regression": "logistic",
    "gb": "gradient_boosting",
}
# fixed values: settings of each kind
DEFAULTS: dict[str, dict[str, object]] = {
    "xgboost": {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.3},
    "gradient_boosting": {"n_estimators": 100, "max_depth": 4, "learning_rate": 0.1},
    "random_forest": {"n_estimators": 100, "max_depth": 15},
    "logistic": {"max_iter": 1000, "c": 1.0},
}
#: histograms that one pass over the rows may hold
NODE_MEMORY_MB = 256
_WEIGHT, _FEATURES = "_weight", "_features"


def class_counts(df: DataFrame, label: str) -> tuple[int, int]:
    row = df.agg(
        F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos")
    ).first()
    return row["neg"], row["pos"]


def positive_weight(kind: str, cost_ratio: float, negatives: Column, positives: Column) -> Column:
    """Weight of positive rows: boosted trees also offset the class imbalance, plain
    gradient boosting takes no costs. Null when a class is missing (no weighting)."""
    if kind == "gradient_boosting":
        weight = F.lit(1.0)
    elif kind == "xgboost":
        weight = F.try_divide(negatives, positives) * cost_ratio
    else:
        weight = F.lit(float(cost_ratio))
    return F.when((negatives > 0) & (positives > 0), weight)


def cost_weights(
    df: DataFrame, kind: str, cost_ratio: float = 5.0, label: str = "y_true"
) -> DataFrame:
    """(class, rows, weight) table of one kind of model; 1 each if a class is missing."""
    counts = df.agg(
        F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos")
    )
    weight = F.coalesce(
        positive_weight(kind, cost_ratio, F.col("neg"), F.col("pos")), F.lit(1.0)
    )
    rows = F.array(
        F.struct(F.lit(0).alias("class"), F.col("neg").alias("rows"), F.lit(1.0).alias("weight")),
        F.struct(F.lit(1).alias("class"), F.col("pos").alias("rows"), weight.alias("weight")),
    )
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(
        inputCols=list(features), outputCol=_FEATURES, handleInvalid="error"
    )


def assembled(df: DataFrame, features: Sequence[str], label: str = "y_true") -> DataFrame:
    """Labelled rows as (label, feature vector), what ``fit_assembled`` trains on.

    Many models of one table share it, so that each fit reads two columns.
    """
    rows = df.filter(F.col(label).isNotNull())
    return _assembler(features).transform(rows).select(
        F.col(label).cast("double").alias(label), _FEATURES
    )


class CostSensitiveClassifier:
    """Weighted binary classifier.

    ``kind`` names a built-in model (``xgboost`` is gradient-boosted trees with the
    class balance in the weights); ``estimator`` replaces it with any Spark ML
    classifier, which gets the random-forest style weights when it takes a weight
    column. ``settings`` override the kind's defaults.
    """

    def __init__(
        self,
        kind: str = "xgboost",
        cost_ratio: float = 5.0,
        seed: int = 42,
        settings: dict[str, object] | None = None,
        weighting: bool = True,
        estimator: Estimator | None = None,
    ):
        kind = ALIASES.get(kind.lower(), kind.lower())
        if kind not in KINDS:
            raise ValueError(f"unknown model type: {kind}")
        self.kind, self.cost_ratio, self.seed = kind, cost_ratio, seed
        self.settings = {**DEFAULTS[kind], **(settings or {})}
        self.weighting, self.estimator = weighting, estimator

    def _weight_of_positives(self, negatives: int, positives: int) -> float:
        if not self.weighting:
            return 1.0
        if negatives == 0 or positives == 0:
            log.warning("only one class in the target, weights left equal")
            return 1.0
        if self.settings.get("positive_weight") == "balanced":
            return negatives / positives
        if "positive_weight" in self.settings:
            return float(self.settings["positive_weight"])
        if self.estimator is not None:
            return float(self.cost_ratio)
        if self.kind == "gradient_boosting":
            return 1.0
        if self.kind == "xgboost":
            return negatives / positives * self.cost_ratio
        return float(self.cost_ratio)

    def _built_in(self, label: str, total_weight: float) -> Estimator:
        s = self.settings
        common = {"featuresCol": _FEATURES, "labelCol": label, "weightCol": _WEIGHT}
        if self.kind == "logistic":
            # the usual C formulation sums losses; Spark averages them by weight
            return LogisticRegression(
                maxIter=int(s["max_iter"]),
                regParam=1.0 / (float(s["c"]) * max(total_weight, 1.0)),
                standardization=False,
                **common,
            )
        if self.kind == "random_forest":
            return RandomForestClassifier(
                numTrees=int(s["n_estimators"]),
                maxDepth=int(s["max_depth"]),
                minInstancesPerNode=int(s.get("min_samples_leaf", 1)),
                featureSubsetStrategy=str(s.get("max_features", "sqrt")),
                bootstrap=bool(s.get("bootstrap", True)),
                # rows keep their nodes: else each pass walks all trees from the root
                cacheNodeIds=True,
                maxMemoryInMB=int(s.get("node_memory_mb", NODE_MEMORY_MB)),
                seed=self.seed,
                **common,
            )
        return GBTClassifier(
            maxIter=int(s["n_estimators"]),
            maxDepth=int(s["max_depth"]),
            stepSize=float(s["learning_rate"]),
            subsamplingRate=float(s.get("subsample", 1.0)),
            featureSubsetStrategy=str(s.get("colsample", "all")),
            minInstancesPerNode=int(s.get("min_child_weight", 1)),
            maxMemoryInMB=int(s.get("node_memory_mb", NODE_MEMORY_MB)),
            seed=self.seed,
            **common,
        )

    def fit(self, df: DataFrame, features: Sequence[str], label: str = "y_true") -> FittedClassifier:
        counts = class_counts(df, label)
        return self.fit_assembled(assembled(df, features, label), counts, features, label)

    def fit_assembled(
        self,
        table: DataFrame,
        counts: tuple[int, int],
        features: Sequence[str],
        label: str = "y_true",
    ) -> FittedClassifier:
        """Fit on rows of ``assembled`` with known (negative, positive) counts."""
        negatives, positives = counts
        if negatives + positives == 0:
            raise ValueError("no labelled rows to fit on")
        weight = self._weight_of_positives(negatives, positives)
        weighted = table.withColumn(
            _WEIGHT, F.when(F.col(label) == 1, F.lit(weight)).otherwise(F.lit(1.0))
        )
        if self.estimator is None:
            learner = self._built_in(label, negatives + positives * weight)
        else:
            learner = self.estimator.copy()
            learner.set(learner.featuresCol, _FEATURES)
            learner.set(learner.labelCol, label)
            if learner.hasParam("weightCol"):
                learner.set(learner.weightCol, _WEIGHT)
        allow_checkpoints(table.sparkSession)
        model = PipelineModel([_assembler(features), learner.fit(weighted)])
        return FittedClassifier(
            model,
            {
                "model_type": self.kind,
                "feature_names": list(features),
                "label": label,
                "random_state": self.seed,
                "positive_weight": weight,
                "cost_ratio": self.cost_ratio,
                "is_fitted": True,
            },
        )

    def predict(self, *_: object) -> None:
        raise ValueError("model must be fitted before making predictions")

    score = predict_proba = predict


class FittedClassifier:
    """A trained pipeline and its description."""

    def __init__(self, model: PipelineModel, info: dict[str, object]):
        self.model, self._info = model, info

    @property
    def features(self) -> list[str]:
        return list(self._info["feature_names"])

    def score_rows(self, df: DataFrame) -> DataFrame:
        """Adds ``y_proba`` (positive class) and ``y_pred`` (at 0.5, reached counts).

        Rows of ``assembled`` are scored by their vector.
        """
        stage = self.model.stages[-1] if _FEATURES in df.columns else self.model
        scored = stage.transform(df)
        dropped = {"rawPrediction", "probability", "prediction", _FEATURES} - set(df.columns)
        return (
            scored.withColumn(SCORE, vector_to_array("probability")[1])
            .withColumn(PREDICTED, predict_at(0.5))
            .drop(*dropped)
        )

    def predict_with_threshold(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        return self.score_rows(df).withColumn(PREDICTED, predict_at(threshold))

    def decision_function(self, df: DataFrame) -> DataFrame:
        """Adds ``decision``: the fitted stage's own margin (log odds) for logistic
        regression and boosted trees, else the probability margin."""
        scored = self.model.transform(df)
        last = self.model.stages[-1]
        if isinstance(last, LogisticRegressionModel):
            margin = vector_to_array("rawPrediction")[1]
        elif isinstance(last, GBTClassificationModel):
            # the raw prediction of boosted trees is half the log odds
            margin = vector_to_array("rawPrediction")[1] * 2
        else:
            p = vector_to_array("probability")
            margin = p[1] - p[0]
        return scored.withColumn("decision", margin).select(*df.columns, "decision")

    def accuracy(self, df: DataFrame) -> float:
        scored = self.score_rows(df)
        return metrics_at(scored, 0.5, label=str(self._info["label"])).first()["accuracy"]

    def importances(
        self, spark: SparkSession, categories: dict[str, str] | None = None
    ) -> DataFrame | None:
        """(feature, importance, category), most important first."""
        last = self.model.stages[-1]
        if hasattr(last, "featureImportances"):
            values = [float(v) for v in last.featureImportances.toArray()]
        elif hasattr(last, "coefficients"):
            values = [abs(float(v)) for v in last.coefficients.toArray()]
        else:
            log.warning("model has no feature importances")
            return None
        rows = [
            (name, value, (categories or {}).get(name, feature_category(name)))
            for name, value in zip(self.features, values, strict=True)
        ]
        table = spark.createDataFrame(rows, "feature string, importance double, category string")
        return table.orderBy(F.desc("importance"), "feature")

    def info(self) -> dict[str, object]:
        return {
            "model_type": self._info["model_type"],
            "is_fitted": self._info["is_fitted"],
            "feature_count": len(self.features),
            "random_state": self._info["random_state"],
        }

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.model.write().overwrite().save(f"{path}/model")
        meta = spark.range(1).select(F.lit(json.dumps(self._info)).alias("info"))
        meta.write.mode("overwrite").json(f"{path}/info")

    @classmethod
    def load(cls, path: str, spark: SparkSession | None = None) -> FittedClassifier:
        spark = spark or SparkSession.active()
        try:
            row = spark.read.schema("info string").json(f"{path}/info").first()
        except AnalysisException as missing:
            raise FileNotFoundError(f"no model at {path}") from missing
        if row is None or row["info"] is None:
            raise ValueError(f"model description at {path} is unreadable")
        return cls(PipelineModel.load(f"{path}/model"), json.loads(row["info"]))


def feature_category(name: str) -> str:
    """Report category of a feature, from its name."""
    if name.startswith(("demand", "heat_demand")):
        return "Demand"
    if name.startswith("cop"):
        return "Efficiency"
    if name.startswith("is_"):
        return "Seasonal"
    if name.startswith("stress"):
        return "History"
    return "Time"
