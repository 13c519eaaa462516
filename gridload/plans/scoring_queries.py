"""Queries for classification metrics, thresholds and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridload.operators import folds, metrics
from gridload.operators.ordering import SeriesLayout
from gridload.plans.fixtures import daily, models, scored, with_views
from gridload.plans.registry import query, rounded

GLOBAL = SeriesLayout(keys=(), span_hours=24)

PREDICTED = ("p", "SELECT *, (y_proba >= 0.5e0)::INT AS y_pred FROM models")
COUNTS = (
    "c",
    """SELECT model, count_if(y_true = 1 AND y_pred = 1)::BIGINT AS tp,
  count_if(y_true = 0 AND y_pred = 1)::BIGINT AS fp,
  count_if(y_true = 0 AND y_pred = 0)::BIGINT AS tn,
  count_if(y_true = 1 AND y_pred = 0)::BIGINT AS fn
FROM p GROUP BY model""",
)


def r(top: str, bottom: str) -> str:
    return f"coalesce(({top}) / nullif({bottom}, 0), 0e0)"


RECALL, PRECISION = r("tp", "tp + fn"), r("tp", "tp + fp")
SPECIFICITY, ACCURACY = r("tn", "tn + fp"), r("tp + tn", "tp + fp + tn + fn")
F1 = r("2 * tp", "2 * tp + fp + fn")
BOTH = "(tp + fp + fn > 0 AND tn + fp + fn > 0)"
GMEAN = f"CASE WHEN {BOTH} THEN sqrt({RECALL} * {SPECIFICITY}) ELSE 0e0 END"
BALANCED = f"CASE WHEN {BOTH} THEN ({RECALL} + {SPECIFICITY}) / 2 ELSE 0e0 END"
YOUDEN = f"CASE WHEN {BOTH} THEN {RECALL} + {SPECIFICITY} - 1 ELSE -1e0 END"
METRIC_SQL = {
    "accuracy": ACCURACY,
    "precision": PRECISION,
    "recall": RECALL,
    "f1": F1,
    "sensitivity": f"CASE WHEN {BOTH} THEN {RECALL} ELSE 0e0 END",
    "specificity": f"CASE WHEN {BOTH} THEN {SPECIFICITY} ELSE 0e0 END",
    "gmean": GMEAN,
    "balanced_accuracy": BALANCED,
    "youden_j": YOUDEN,
    "false_positive_rate": r("fp", "fp + tn"),
    "false_negative_rate": r("fn", "fn + tp"),
    "positive_predictive_value": PRECISION,
    "negative_predictive_value": r("tn", "tn + fn"),
}


def columns_sql(names, digits: int = 9) -> str:
    return ", ".join(f"round({METRIC_SQL[n]}, {digits}) AS {n}" for n in names)


CURVE = (
    "curve",
    """SELECT model, threshold, pos, neg, tp, fp, tn_all - fp AS tn, fn_all - tp AS fn FROM (
  SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
    sum(pos) OVER a AS fn_all, sum(neg) OVER a AS tn_all
  FROM (SELECT model, y_proba AS threshold, count_if(y_true = 1)::BIGINT AS pos, count_if(y_true = 0)::BIGINT AS neg
        FROM models GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY model ORDER BY threshold DESC), a AS (PARTITION BY model))""",
)
AREAS = (
    "areas",
    """SELECT model,
  sum(neg * (tp - pos) + neg * pos / 2e0) / (max(tp + fn) * max(fp + tn)) AS auc_roc,
  sum(pos * tp / (tp + fp)) / max(tp + fn) AS auc_pr,
  sum(pos * (tp / (tp + fp) + CASE WHEN tp + fp = pos + neg THEN 1e0
    ELSE (tp - pos) / (tp - pos + fp - neg) END) / 2) / max(tp + fn) AS pr_area
FROM curve GROUP BY model""",
)


def predicted(spark, sf_dir):
    return models(spark, sf_dir).withColumn("y_pred", metrics.predict_at(0.5))


@query(
    "decision_values",
    with_views("scored")
    + """SELECT event_id, (y_proba >= 0.4e0)::INT AS y_pred, round(2e0 * y_proba - 1e0, 6) AS margin
FROM scored""",
)
def decision_values(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "event_id",
        metrics.predict_at(0.4).alias("y_pred"),
        F.round(metrics.decision_value(), 6).alias("margin"),
    )


@query("confusion_matrix", with_views("models", PREDICTED, COUNTS) + "SELECT * FROM c")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(predicted(spark, sf_dir), ["model"])


@query(
    "confusion_single_class",
    with_views("scored")
    + """SELECT 0::BIGINT AS tp, 0::BIGINT AS fp, 0::BIGINT AS tn, 0::BIGINT AS fn, 0e0 AS gmean,
  0e0 AS balanced_accuracy, -1e0 AS youden_j, count(*) AS rows FROM scored WHERE y_true = 0""",
)
def confusion_single_class(spark, sf_dir):
    ones = scored(spark, sf_dir).filter("y_true = 0").withColumn("y_pred", F.lit(0))
    zeros = metrics.confusion_matrix(ones)
    extra = metrics.label_metrics(ones, (), ["gmean", "balanced_accuracy", "youden_j"])
    both = metrics._side_by_side(zeros, extra, ())
    return metrics._side_by_side(both, ones.agg(F.count(F.lit(1)).alias("rows")), ())


@query(
    "label_metrics",
    with_views("models", PREDICTED, COUNTS)
    + f"SELECT model, {columns_sql(METRIC_SQL)} FROM c",
)
def label_metrics(spark, sf_dir):
    return rounded(metrics.label_metrics(predicted(spark, sf_dir), ["model"]), 9)


@query(
    "score_curve",
    with_views("models", CURVE)
    + """SELECT model, threshold, pos, neg, tp::BIGINT AS tp, fp::BIGINT AS fp, tn::BIGINT AS tn,
  fn::BIGINT AS fn FROM curve""",
)
def score_curve(spark, sf_dir):
    return metrics.score_curve(models(spark, sf_dir), ["model"])


@query(
    "curve_areas",
    with_views("models", CURVE, AREAS)
    + """SELECT model, round(auc_roc, 9) AS auc_roc, round(auc_pr, 9) AS auc_pr,
  round(pr_area, 9) AS pr_area FROM areas""",
)
def curve_areas(spark, sf_dir):
    curve = metrics.score_curve(models(spark, sf_dir), ["model"])
    return rounded(metrics.curve_areas(curve, ["model"]), 9)


@query(
    "pr_curve",
    with_views("models", CURVE)
    + f"""SELECT model, threshold, round({PRECISION}, 9) AS precision, round({RECALL}, 9) AS recall
FROM curve""",
)
def pr_curve(spark, sf_dir):
    return rounded(metrics.pr_curve(models(spark, sf_dir), ["model"]), 9)


@query(
    "pr_summary",
    with_views("scored", ("models", "SELECT 'm' AS model, * FROM scored"), CURVE, AREAS)
    + """SELECT round(pr_area, 9) AS pr_area, round((SELECT avg(y_true) FROM scored), 9) AS baseline
FROM areas""",
)
def pr_summary(spark, sf_dir):
    return rounded(metrics.pr_summary(scored(spark, sf_dir)), 9)


@query(
    "brier_score",
    with_views("models")
    + """SELECT model, round(avg((y_proba - y_true) * (y_proba - y_true)), 9) AS brier_score
FROM models GROUP BY model""",
)
def brier_score(spark, sf_dir):
    return rounded(metrics.brier_score(models(spark, sf_dir), ["model"]), 9)


BRIER = (
    "brier",
    """SELECT model, avg((y_proba - y_true) * (y_proba - y_true)) AS brier_score, count(*) AS n,
  count_if(y_true = 1)::BIGINT AS pos, count_if(y_true = 0)::BIGINT AS neg FROM models GROUP BY model""",
)
BUNDLE = f"""c.model, {columns_sql(METRIC_SQL)}, tp, fp, tn, fn,
  round(auc_roc, 9) AS auc_roc, round(auc_pr, 9) AS auc_pr, round(brier_score, 9) AS brier_score"""


@query(
    "evaluate_models",
    with_views("models", PREDICTED, COUNTS, CURVE, AREAS, BRIER)
    + f"SELECT {BUNDLE} FROM c JOIN areas USING (model) JOIN brier USING (model)".replace(
        "c.model", "model"
    ),
)
def evaluate_models(spark, sf_dir):
    return rounded(metrics.evaluate(predicted(spark, sf_dir), ["model"]), 9)


@query(
    "evaluation_record",
    with_views("models", PREDICTED, COUNTS, CURVE, AREAS, BRIER)
    + f"""SELECT {BUNDLE}, n AS total_samples, pos AS positive_samples, neg AS negative_samples,
  round(greatest(pos, neg) / least(pos, neg), 9) AS imbalance_ratio,
  round(least(pos, neg) / n, 9) AS minority_class_rate, round(pos / n, 9) AS positive_rate
FROM c JOIN areas USING (model) JOIN brier USING (model)""".replace("c.model", "model"),
)
def evaluation_record(spark, sf_dir):
    return rounded(metrics.evaluation_record(predicted(spark, sf_dir)), 9)


@query(
    "compare_models",
    with_views("models", PREDICTED, COUNTS)
    + 'SELECT model AS "Model", '
    + ", ".join(
        f'round({METRIC_SQL[m]}, 9) AS "{metrics.COMPARISON_COLUMNS[m]}"'
        for m in metrics.COMPARISON_COLUMNS
        if m in METRIC_SQL
    )
    + f" FROM c ORDER BY {GMEAN} DESC, 1",
)
def compare_models(spark, sf_dir):
    records = metrics.evaluate(predicted(spark, sf_dir), ["model"], score=None)
    return rounded(metrics.compare_models(records, "G-mean"), 9)


@query(
    "best_model",
    with_views("models", PREDICTED, COUNTS)
    + f"SELECT model, round({F1}, 9) AS f1 FROM c ORDER BY {F1} DESC, model LIMIT 1",
)
def best_model(spark, sf_dir):
    records = metrics.evaluate(predicted(spark, sf_dir), ["model"], score=None)
    return rounded(metrics.best_model(records), 9)


def report_lines() -> str:
    p0, r0, f0 = r("tn", "tn + fn"), r("tn", "tn + fp"), r("2 * tn", "2 * tn + fn + fp")
    n, n0, n1 = "tp + fp + tn + fn", "tn + fp", "tp + fn"
    lines = [
        ("No Stress", p0, r0, f0, n0),
        ("Stress", PRECISION, RECALL, F1, n1),
        ("accuracy", "NULL::DOUBLE", "NULL::DOUBLE", ACCURACY, n),
        (
            "macro avg",
            f"({p0} + {PRECISION}) / 2",
            f"({r0} + {RECALL}) / 2",
            f"({f0} + {F1}) / 2",
            n,
        ),
        (
            "weighted avg",
            *[
                f"({a} * ({n0}) + {b} * ({n1})) / ({n})"
                for a, b in ((p0, PRECISION), (r0, RECALL), (f0, F1))
            ],
            n,
        ),
    ]
    return " UNION ALL ".join(
        f"""SELECT model, '{name}' AS "class", round({p}, 9) AS precision, round({rc}, 9) AS recall,
  round({f}, 9) AS f1, ({s})::BIGINT AS support FROM c"""
        for name, p, rc, f, s in lines
    )


@query("classification_report", with_views("models", PREDICTED, COUNTS) + report_lines())
def classification_report(spark, sf_dir):
    return rounded(metrics.classification_report(predicted(spark, sf_dir), ["model"]), 9)


@query(
    "reliability_bins",
    with_views("models")
    + "SELECT model, ("
    + " + ".join(f"(y_proba > {e!r}::DOUBLE)::INT" for e in metrics.BIN_EDGES)
    + """)::INT AS bin, count(*) AS rows, round(avg(y_proba), 8) AS mean_predicted,
  round(avg(y_true), 8) AS fraction_positive FROM models GROUP BY 1, 2""",
)
def reliability_bins(spark, sf_dir):
    return rounded(metrics.reliability_bins(models(spark, sf_dir), ["model"]), 8)


def best_sql(names, keys: str = "model") -> str:
    return " UNION ALL ".join(
        f"""(SELECT {keys}, '{n}' AS metric, threshold, round(s, 9) AS score FROM (
  SELECT {keys}, threshold, {METRIC_SQL[m]} AS s FROM curve)
QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY s DESC, threshold) = 1)"""
        for n, m in names
    )


BEST = (("f1", "f1"), ("gmean", "gmean"), ("balanced_accuracy", "balanced_accuracy"),
        ("youden", "youden_j"))


@query("best_thresholds", with_views("models", CURVE) + best_sql(BEST))
def best_thresholds(spark, sf_dir):
    return rounded(metrics.best_thresholds(models(spark, sf_dir), ["model"]), 9)


FOLD_SQL = """SELECT *, (row_number() OVER ({strata} ORDER BY md5('42:' || event_id::VARCHAR), event_id)
  - 1) % 5 AS fold FROM scored"""


@query(
    "fold_thresholds",
    with_views(
        "scored",
        ("models", "SELECT fold AS model, * FROM (" + FOLD_SQL.format(strata="") + ")"),
        CURVE,
        ("best", best_sql(BEST)),
    )
    + """SELECT metric, round(avg(threshold), 6) AS threshold, round(avg(score), 6) AS score
FROM best GROUP BY metric""",
)
def fold_thresholds(spark, sf_dir):
    parts = folds.shuffled_folds(scored(spark, sf_dir))
    return rounded(metrics.mean_thresholds(metrics.best_thresholds(parts, ["fold"])))


@query(
    "metrics_at_threshold",
    with_views("models", ("p", "SELECT *, (y_proba >= 0.35e0)::INT AS y_pred FROM models"), COUNTS)
    + f"SELECT model, {columns_sql(metrics.THRESHOLD_METRICS)} FROM c",
)
def metrics_at_threshold(spark, sf_dir):
    return rounded(metrics.metrics_at(models(spark, sf_dir), 0.35, ["model"]), 9)


@query(
    "threshold_grid",
    with_views(
        "models",
        (
            "g",
            "SELECT unnest(["
            + ", ".join(f"{t!r}::DOUBLE" for t in metrics.THRESHOLD_GRID)
            + "]) AS threshold",
        ),
        (
            "c",
            """SELECT model, threshold, count_if(y_true = 1 AND y_proba >= threshold) AS tp,
  count_if(y_true = 0 AND y_proba >= threshold) AS fp,
  count_if(y_true = 0 AND y_proba < threshold) AS tn,
  count_if(y_true = 1 AND y_proba < threshold) AS fn FROM models, g GROUP BY 1, 2""",
        ),
    )
    + f"SELECT model, threshold, {columns_sql(metrics.THRESHOLD_METRICS)} FROM c",
)
def threshold_grid(spark, sf_dir):
    grid = metrics.threshold_analysis(models(spark, sf_dir), ["model"])
    return rounded(grid, 9, skip=("threshold",))


OPTIMAL = {"base": 0.42, "flat": 0.46, "square": 0.18}
SPLIT_MODELS = (
    "sm",
    """SELECT *, CASE WHEN event_id % 3 = 0 THEN 'val' ELSE 'test' END AS part,
  CASE model WHEN 'base' THEN 0.42e0 WHEN 'flat' THEN 0.46e0 ELSE 0.18e0 END AS t FROM models""",
)


def split_models(spark, sf_dir):
    part = F.when(F.col("event_id") % 3 == 0, "val").otherwise("test")
    return models(spark, sf_dir).withColumn("part", part)


def kind_counts(kind: str, limit: str) -> str:
    return ", ".join(
        f"count_if(y_true = {y} AND {'NOT ' if not hit else ''}(y_proba >= {limit}))::BIGINT AS {kind}_{n}"
        for n, y, hit in (("tp", 1, 1), ("fp", 0, 1), ("tn", 0, 0), ("fn", 1, 0))
    )


def kind_metric(name: str, kind: str) -> str:
    text = METRIC_SQL[name]
    for c in ("tp", "fp", "tn", "fn"):
        text = " ".join(
            w.replace(c, f"{kind}_{c}") if c in w else w for w in text.split(" ")
        )
    return text


REPORTED = ("f1", "precision", "recall", "accuracy", "gmean", "balanced_accuracy")
OPTIMAL_COUNTS = (
    "oc",
    f"""SELECT model, part, max(t) AS optimal_threshold, {kind_counts("optimal", "t")},
  {kind_counts("default", "0.5e0")}, avg((y_proba - y_true) * (y_proba - y_true)) AS brier_score
FROM sm GROUP BY 1, 2""",
)


def optimal_areas() -> tuple[tuple[str, str], ...]:
    keyed = "SELECT model || '/' || part AS model, y_true, y_proba FROM sm"
    return (
        ("curve", CURVE[1].replace("FROM models", f"FROM ({keyed})")),
        AREAS,
    )


@query(
    "optimal_report",
    with_views("models", SPLIT_MODELS, OPTIMAL_COUNTS, *optimal_areas())
    + "SELECT oc.model, part, optimal_threshold, "
    + ", ".join(f"{k}_{c}" for k in ("optimal", "default") for c in ("tp", "fp", "tn", "fn"))
    + ", round(brier_score, 9) AS brier_score, "
    + ", ".join(
        f"round({kind_metric(n, k)}, 9) AS {n}_{k}" for n in REPORTED for k in ("optimal", "default")
    )
    + ", "
    + ", ".join(
        f"round({kind_metric(n, 'optimal')} - {kind_metric(n, 'default')}, 9) AS {n}_improvement"
        for n in ("f1", "gmean", "balanced_accuracy")
    )
    + """, round(auc_roc, 9) AS roc_auc, round(auc_pr, 9) AS pr_auc
FROM oc JOIN areas ON areas.model = oc.model || '/' || part""",
)
def optimal_report(spark, sf_dir):
    report = metrics.optimal_report(split_models(spark, sf_dir), OPTIMAL, ["model", "part"])
    return rounded(report, 9)


T1_SQL = """SELECT model AS "Model", printf('%.4f', {accuracy}) AS "Accuracy",
  printf('%.4f', {precision}) AS "Precision", printf('%.4f', {recall}) AS "Recall",
  printf('%.4f', {f1}) AS "F1-Score", printf('%.4f', {gmean}) AS "G-Mean",
  printf('%.4f', {balanced}) AS "Balanced Accuracy", printf('%.4f', auc_roc) AS "AUC-ROC",
  printf('%.4f', auc_pr) AS "AUC-PR", printf('%.4f', t) AS "Optimal Threshold"
FROM c JOIN areas USING (model)""".format(
    accuracy=ACCURACY, precision=PRECISION, recall=RECALL, f1=F1, gmean=GMEAN, balanced=BALANCED
)
AT_OPTIMAL = (
    "c",
    """SELECT model, max(t) AS t, count_if(y_true = 1 AND y_proba >= t) AS tp,
  count_if(y_true = 0 AND y_proba >= t) AS fp, count_if(y_true = 0 AND y_proba < t) AS tn,
  count_if(y_true = 1 AND y_proba < t) AS fn FROM sm GROUP BY 1""",
)


@query("performance_table", with_views("models", SPLIT_MODELS, AT_OPTIMAL, CURVE, AREAS) + T1_SQL)
def performance_table(spark, sf_dir):
    return metrics.performance_table(metrics.optimal_report(models(spark, sf_dir), OPTIMAL))


@query(
    "threshold_table",
    with_views(
        "models", SPLIT_MODELS, ("oc", OPTIMAL_COUNTS[1].replace("model, part,", "model,").replace("1, 2", "1"))
    )
    + f"""SELECT model AS "Model", printf('%.4f', {kind_metric("f1", "default")}) AS "Default Threshold (0.5)",
  printf('%.4f', optimal_threshold) AS "Optimal Threshold", """
    + ", ".join(
        f"""printf('%.4f', {kind_metric(n, "optimal")} - {kind_metric(n, "default")}) AS "{t}" """
        for n, t in (
            ("f1", "F1-Score Improvement"),
            ("gmean", "G-Mean Improvement"),
            ("balanced_accuracy", "Balanced Accuracy Improvement"),
        )
    )
    + " FROM oc",
)
def threshold_table(spark, sf_dir):
    return metrics.threshold_table(metrics.optimal_report(models(spark, sf_dir), OPTIMAL))


@query(
    "scenario_table",
    with_views("models", PREDICTED, COUNTS, CURVE, AREAS, BRIER)
    + f"""SELECT model AS "Model", printf('%.3f', auc_pr) AS "PR-AUC", printf('%.3f', {F1}) AS "F1-Score",
  printf('%.3f', brier_score) AS "Brier Score", printf('%.3f', {GMEAN}) AS "G-mean",
  printf('%.3f', {BALANCED}) AS "Balanced Accuracy"
FROM c JOIN areas USING (model) JOIN brier USING (model)""",
)
def scenario_table(spark, sf_dir):
    return metrics.scenario_table(metrics.evaluate(predicted(spark, sf_dir), ["model"]))


@query(
    "model_pairs",
    with_views("models")
    + """SELECT a.model AS model_1, b.model AS model_2 FROM (SELECT DISTINCT model FROM models) a
JOIN (SELECT DISTINCT model FROM models) b ON a.model <> b.model""",
)
def model_pairs(spark, sf_dir):
    return metrics.model_pairs(models(spark, sf_dir))


@query(
    "year_split",
    with_views("daily", ("y", "SELECT list_sort(list(DISTINCT year(ts))) AS ys FROM daily"))
    + """SELECT series, ts, (year(ts) IN (ys[1], ys[2]))::INT AS in_train,
  (year(ts) = ys[3])::INT AS in_val, (year(ts) = ys[3])::INT AS in_test FROM daily, y""",
)
def year_split(spark, sf_dir):
    return folds.year_split(daily(spark, sf_dir)).select(
        "series", "ts", "in_train", "in_val", "in_test"
    )


@query(
    "rolling_origins",
    with_views("daily", ("y", "SELECT list_sort(list(DISTINCT year(ts))) AS ys FROM daily"))
    + """SELECT series, ts, greatest(list_position(ys, year(ts)) - 2, 0)::INT AS test_fold,
  (greatest(list_position(ys, year(ts)) - 2, 0) + 1)::INT AS train_from_fold FROM daily, y""",
)
def rolling_origins(spark, sf_dir):
    return folds.rolling_origins(daily(spark, sf_dir)).select(
        "series", "ts", "test_fold", "train_from_fold"
    )


EXPANDING = (
    "e",
    """SELECT event_id, CASE WHEN pos >= n - 5 * b THEN (pos - (n - 5 * b)) // b + 1 ELSE 0 END AS f
FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos,
        count(*) OVER () AS n, count(*) OVER () // 6 AS b FROM scored)""",
)


@query(
    "time_series_folds",
    with_views("scored", EXPANDING) + "SELECT event_id, f::INT AS test_fold FROM e",
)
def time_series_folds(spark, sf_dir):
    return folds.time_series_folds(scored(spark, sf_dir), 5, GLOBAL, ["event_id"]).select(
        "event_id", "test_fold"
    )


@query(
    "time_series_fold_sizes",
    with_views("scored", EXPANDING)
    + """SELECT k::INT AS fold, count_if(f < k)::BIGINT AS train_size, count_if(f = k)::BIGINT AS val_size
FROM e, (SELECT unnest([1, 2, 3, 4, 5]) AS k) GROUP BY k""",
)
def time_series_fold_sizes(spark, sf_dir):
    return folds.fold_sizes(
        folds.time_series_folds(scored(spark, sf_dir), 5, GLOBAL, ["event_id"])
    )


@query(
    "stratified_folds",
    with_views("scored", ("s", FOLD_SQL.format(strata="PARTITION BY y_true")))
    + "SELECT event_id, fold::INT AS fold FROM s",
)
def stratified_folds(spark, sf_dir):
    return folds.stratified_folds(scored(spark, sf_dir)).select("event_id", "fold")


@query(
    "shuffled_folds",
    with_views("scored", ("s", FOLD_SQL.format(strata="")))
    + "SELECT event_id, fold::INT AS fold FROM s",
)
def shuffled_folds(spark, sf_dir):
    return folds.shuffled_folds(scored(spark, sf_dir)).select("event_id", "fold")


FOLD_COUNTS = (
    ("s", FOLD_SQL.format(strata="PARTITION BY y_true")),
    ("p", "SELECT fold AS model, y_true, (y_proba >= 0.5e0)::INT AS y_pred FROM s"),
    COUNTS,
    (
        "m",
        " UNION ALL ".join(
            f"SELECT model AS fold, '{n}' AS metric, {METRIC_SQL[n]} AS score FROM c"
            for n in ("accuracy", "precision", "recall", "f1")
        )
        + " UNION ALL SELECT model, 'unheard_of', 0e0 FROM c",
    ),
)
FOLD_METRICS = ("accuracy", "precision", "recall", "f1", "unheard_of")


def fold_scores(spark, sf_dir):
    parts = folds.stratified_folds(scored(spark, sf_dir)).withColumn(
        "y_pred", metrics.predict_at(0.5)
    )
    return folds.fold_metrics(parts, names=FOLD_METRICS)


@query(
    "fold_metrics",
    with_views("scored", *FOLD_COUNTS)
    + "SELECT fold::INT AS fold, metric, round(score, 9) AS score FROM m",
)
def fold_metrics(spark, sf_dir):
    return rounded(fold_scores(spark, sf_dir), 9)


@query(
    "fold_summary",
    with_views("scored", *FOLD_COUNTS)
    + """SELECT metric, round(avg(score), 8) AS mean, round(stddev_pop(score), 8) AS std,
  round(min(score), 8) AS min, round(max(score), 8) AS max FROM m GROUP BY metric""",
)
def fold_summary(spark, sf_dir):
    return rounded(folds.fold_summary(fold_scores(spark, sf_dir)), 8)


@query(
    "temporal_split",
    with_views("daily")
    + """SELECT series, ts, (row_number() OVER s - 1 < floor(0.8e0 * count(*) OVER (PARTITION BY series)))::INT
  AS in_train FROM daily WINDOW s AS (PARTITION BY series ORDER BY ts)""",
)
def temporal_split(spark, sf_dir):
    return folds.temporal_split(daily(spark, sf_dir)).select("series", "ts", "in_train")
