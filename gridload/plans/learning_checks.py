"""Properties of fitted models, one row each, that SQL can state.

Counts come from the data in both engines; what must not happen is counted as zero.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gridload.learn.classifiers import KINDS, FittedClassifier
from gridload.learn.tuning import COST_RANGE, FOREST_RANGES, Search
from gridload.operators.metrics import curve_areas, score_curve
from gridload.plans.fixtures import daily, hourly, with_views
from gridload.plans.learning_queries import FEATURES, LABEL, TRIALS, fitted, training_rows
from gridload.plans.registry import query
from gridload.prep.isolation import IsolationForest
from gridload.session import durable, new_path

#: of the held-out year; its demand is random, a linear score reaches 0.65, trees 0.7
LEAST_AUC = 0.6
HELD_OUT = ("held", "SELECT * FROM daily WHERE year(ts) = (SELECT max(year(ts)) FROM daily)")


def _checked(kind):
    def run(spark, sf_dir):
        rows = training_rows(spark, sf_dir)
        scored = durable(fitted(rows, kind).score_rows(rows.filter("in_val = 1")))
        areas = curve_areas(score_curve(scored, label=LABEL)).select("auc_roc").scalar()
        wrong = F.col("y_pred") != (F.col("y_proba") >= 0.5).cast("int")
        return scored.agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_distinct("series", "ts").alias("keys"),
            F.count_if(F.col("y_proba").isNull() | ~F.col("y_proba").between(0, 1)).alias("bad_scores"),
            F.count_if(wrong).alias("wrong_predictions"),
        ).withColumn("ranks_well", areas > LEAST_AUC)

    return run


for _kind in KINDS:
    query(
        f"fit_checks_{_kind}",
        with_views("daily", HELD_OUT)
        + """SELECT count(*) AS rows, count(DISTINCT (series, ts)) AS keys, 0::BIGINT AS bad_scores,
  0::BIGINT AS wrong_predictions, true AS ranks_well FROM held""",
    )(_checked(_kind))


@query(
    "importance_checks",
    "SELECT 12::BIGINT AS features, 1e0 AS total, 0::BIGINT AS negative",
)
def importance_checks(spark, sf_dir):
    found = fitted(training_rows(spark, sf_dir), "random_forest").importances(spark)
    return found.agg(
        F.count_distinct("feature").alias("features"),
        F.round(F.sum("importance"), 6).alias("total"),
        F.count_if(F.col("importance") < 0).alias("negative"),
    )


@query(
    "model_reload_checks",
    with_views("daily", HELD_OUT)
    + "SELECT count(*) AS rows, 0e0 AS largest_difference FROM held",
)
def model_reload_checks(spark, sf_dir):
    """Scores of the saved and reloaded model less those of the original."""
    rows = training_rows(spark, sf_dir)
    model = fitted(rows, "logistic")
    path = new_path(spark, "model")
    model.save(path)
    val = rows.filter("in_val = 1")
    first = model.score_rows(val).select("row_id", "y_proba")
    again = FittedClassifier.load(path, spark).score_rows(val)
    both = first.join(again.select("row_id", F.col("y_proba").alias("reloaded")), "row_id")
    return both.agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(F.abs(F.col("y_proba") - F.col("reloaded"))).alias("largest_difference"),
    )


#: forests of the search checks: many trials of small ones
SMALL_FOREST = {"n_estimators": 20, "max_depth": 5}
RATES = ("tp / nullif(tp + fn, 0)", "tn / nullif(tn + fp, 0)")
#: the score of a trial, from its confusion counts
RECOMPUTED = {
    "gmean": f"coalesce(sqrt(({RATES[0]}) * ({RATES[1]})), 0)",
    "f1": "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)",
}


def _search_sql(trials: int) -> str:
    return (
        with_views("daily", HELD_OUT)
        + f"""SELECT {trials}::BIGINT AS trials, count(*) AS least_rows,
  count(*) AS most_rows, 0::BIGINT AS wrong_scores, 0::BIGINT AS out_of_range,
  0::BIGINT AS changed_by_reload, 1::BIGINT AS best FROM held"""
    )


def _search_checks(spark, search):
    """What holds of any finished search; its results are saved and loaded again."""
    path = new_path(spark, "search")
    search.save(spark, path)
    table = Search.load(spark, path).table(spark)
    drawn = F.from_json(
        "settings", "min_samples_leaf int, max_features string, bootstrap boolean, positive_weight double"
    )
    s = {f: drawn[f] for f in ("min_samples_leaf", "max_features", "bootstrap", "positive_weight")}
    inside = (
        s["min_samples_leaf"].isNull() | s["min_samples_leaf"].between(*FOREST_RANGES["min_samples_leaf"])
    ) & (s["max_features"].isNull() | s["max_features"].isin(*FOREST_RANGES["max_features"]))
    inside &= s["positive_weight"].isNull() | s["positive_weight"].between(*COST_RANGE)
    rows = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    wrong = F.abs(F.expr(RECOMPUTED[search.metric]) - F.col("score")) > 1e-12
    # the first of the highest scores, found by order instead of by comparing
    ranked = table.orderBy(F.desc("score"), "trial").limit(1).select("trial").scalar()
    original = search.table(spark)
    changed = table.exceptAll(original).unionAll(original.exceptAll(table))
    return table.agg(
        F.count_distinct("trial").alias("trials"),
        F.min(rows).alias("least_rows"),
        F.max(rows).alias("most_rows"),
        F.count_if(wrong).alias("wrong_scores"),
        F.count_if(~inside).alias("out_of_range"),
    ).withColumns(
        {
            "changed_by_reload": changed.agg(F.count(F.lit(1))).scalar(),
            "best": (ranked == search.best()["trial"]).cast("bigint"),
        }
    )


@query("search_checks", _search_sql(TRIALS))
def search_checks(spark, sf_dir):
    """All trials of a search over small forests, scored by geometric mean."""
    rows = training_rows(spark, sf_dir)
    search = Search("random_forest", "gmean", trials=TRIALS, fixed=SMALL_FOREST)
    search.tune(rows.filter("in_train = 1"), rows.filter("in_val = 1"), FEATURES, LABEL)
    return _search_checks(spark, search)


@query("cost_ratio_checks", _search_sql(20))
def cost_ratio_checks(spark, sf_dir):
    """Twenty cost ratios for small forests, scored by F1."""
    rows = training_rows(spark, sf_dir)
    search = Search("random_forest", "f1", fixed=SMALL_FOREST)
    search.tune_cost_ratio(rows.filter("in_train = 1"), rows.filter("in_val = 1"), FEATURES, LABEL)
    return _search_checks(spark, search)


def _outlier_sql(view: str) -> str:
    return (
        with_views(view)
        + f"""SELECT count(*) AS rows, count(*) AS kept_and_flagged, 0::BIGINT AS bad_scores,
  true AS share_holds FROM {view}"""
    )


def _outliers(rows, columns):
    model = IsolationForest(columns).fit(rows)
    flagged = durable(model.flag(rows))
    kept = model.transform(rows).agg(F.count(F.lit(1)).alias("kept")).scalar()
    score = F.col("anomaly_score")
    counts = flagged.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("is_outlier").alias("flagged"),
        F.count_if(score.isNull() | (score <= 0) | (score > 1)).alias("bad_scores"),
    )
    # the cut is the exact 90 % quantile: at most a tenth of the rows lies above
    return counts.select(
        "rows",
        (F.col("flagged") + kept).alias("kept_and_flagged"),
        "bad_scores",
        (F.col("flagged") <= F.ceil(F.col("rows") * 0.1)).alias("share_holds"),
    )


@query("outlier_checks_hourly", _outlier_sql("hourly"))
def outlier_checks_hourly(spark, sf_dir):
    rows = hourly(spark, sf_dir).withColumn("hour", F.hour("ts"))
    return _outliers(rows, ["heat_demand_total", "cop_average", "hour"])


@query("outlier_checks_daily", _outlier_sql("daily"))
def outlier_checks_daily(spark, sf_dir):
    return _outliers(daily(spark, sf_dir), ["heat_demand_total", "cop_average"])
