"""Imputation, outliers, scaling, checks, models and files."""

from __future__ import annotations

import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.sql import functions as F

from gridload.learn.classifiers import CostSensitiveClassifier, FittedClassifier
from gridload.learn.tuning import (
    FOREST_RANGES,
    Search,
    draw_settings,
    optimise_thresholds,
    score_folds,
)
from gridload.operators import checks, select
from gridload.operators.metrics import curve_areas, label_metrics, score_curve
from gridload.operators.ordering import SeriesLayout
from gridload.plans import learning_queries
from gridload.plans.analysis import prepare_rows, run_analysis
from gridload.prep.features import Preprocessor, engineer, pipeline_info
from gridload.prep.isolation import IsolationForest, IsolationModel
from gridload.prep.neighbours import _code, _order_table, _shares, knn_impute
from gridload.prep.steps import FillModel, FillNeighbours, FillStatistic, NeighbourModel, Scale
from gridload.session import new_path
from gridload.sources import sinks, tables


def brute_force(values, k, donors=None):
    donors = values if donors is None else donors
    out = values.copy()
    for i in np.flatnonzero(np.isnan(values).any(axis=1)):
        both = ~np.isnan(donors) & ~np.isnan(values[i])
        gap = np.where(both, (donors - values[i]) ** 2, 0).sum(axis=1)
        shared = both.sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            distance = np.where(shared > 0, gap * (values.shape[1] / shared), np.inf)
        for c in np.flatnonzero(np.isnan(values[i])):
            usable = np.flatnonzero(~np.isnan(donors[:, c]) & np.isfinite(distance))
            best = usable[np.lexsort((usable, distance[usable]))[:k]]
            out[i, c] = donors[best, c].mean() if len(best) else np.nanmean(donors[:, c])
    return out


@pytest.fixture(scope="module")
def holes():
    rng = np.random.default_rng(5)
    n = 400
    t = np.arange(n)
    x = np.column_stack([np.sin(t / 30) + rng.normal(0, 0.1, n), rng.normal(size=n), t % 24.0])
    x[rng.random(x.shape) < 0.1] = np.nan
    frame = pd.DataFrame(x, columns=["a", "b", "c"])
    frame["ts"] = pd.date_range("2020-01-01", periods=n, freq="h")
    frame["series"] = np.where(t < 300, "hot", "cold")
    return frame


def as_df(spark, frame):
    return spark.createDataFrame(frame).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@pytest.mark.parametrize("tile, levels, fan", [(32, 2, 3), (4096, 1, 64)])
def test_knn_equals_brute_force(spark, holes, tile, levels, fan):
    got = knn_impute(
        as_df(spark, holes), ["a", "b", "c"], k=3, tile_rows=tile, levels=levels, fan=fan
    ).toPandas()
    for name in ("hot", "cold"):
        mine = got[got.series == name].sort_values("ts")[["a", "b", "c"]].to_numpy()
        want = brute_force(holes[holes.series == name][["a", "b", "c"]].to_numpy(), 3)
        np.testing.assert_allclose(mine, want, rtol=1e-9)


def test_knn_of_many_columns(spark):
    rng, columns = np.random.default_rng(8), [f"x{i}" for i in range(25)]
    values = rng.normal(size=(300, 25))
    values[rng.random(values.shape) < 0.02] = np.nan
    values[40:60, 3:9] = np.nan
    frame = pd.DataFrame(values, columns=columns)
    frame["ts"], frame["series"] = pd.date_range("2020-01-01", periods=300, freq="h"), "one"
    got = knn_impute(as_df(spark, frame), columns, k=4, tile_rows=32, levels=1, fan=4).toPandas()
    got = got.sort_values("ts")[columns].to_numpy()
    np.testing.assert_allclose(got, brute_force(values, 4), rtol=1e-9)


@pytest.mark.parametrize("order", ["111", "010", "101", "000", "rest"])
def test_order_codes_interleave_bits(spark, order):
    names = ["a", "b", "c"]
    rows = [(0.0, 0.25, 1.0), (0.9, None, 0.1), (None, None, None), (1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double").withColumn(
        "_shares", _shares(names, {n: (0.0, 1.0) for n in names})
    )
    got = df.select("*", F.inline(_order_table([order], names))).withColumn("_code", _code()).collect()
    used = [i for i in range(3) if order == "rest" or order[i] == "1"]
    bits = 40 // len(used) if used else 0
    for row in got:
        cells = [int((row[names[i]] or 0.0) * (2**bits - 1)) for i in used]
        text = "".join(str(cell >> bit & 1) for bit in reversed(range(bits)) for cell in cells)
        assert row["_code"] == int(text or "0", 2)


def test_knn_with_separate_donors(spark, holes):
    hot = holes[holes.series == "hot"].reset_index(drop=True)
    known, fresh = hot.iloc[:200], hot.iloc[200:]
    got = knn_impute(
        as_df(spark, fresh), ["a", "b", "c"], k=3, donors=as_df(spark, known), tile_rows=50,
        layout=SeriesLayout(keys=()),
    ).toPandas().sort_values("ts")
    columns = ["a", "b", "c"]
    want = brute_force(fresh[columns].to_numpy(), 3, known[columns].to_numpy())
    np.testing.assert_allclose(got[columns].to_numpy(), want, rtol=1e-9)


def test_neighbour_model_round_trip(spark, holes):
    columns = ["a", "b", "c"]
    model = FillNeighbours(columns, k=3).fit(as_df(spark, holes.iloc[:200]))
    path = new_path(spark, "neighbours")
    model.save(spark, path)
    again = NeighbourModel.load(spark, path)
    fresh = as_df(spark, holes.iloc[200:260])
    rows = lambda m: sorted(map(tuple, m.transform(fresh).select("series", "ts", *columns).collect()))
    assert rows(again) == rows(model) and again.layout == model.layout
    with pytest.raises(ValueError):
        NeighbourModel.load(spark, _broken(spark, "state"))


def test_unreadable_model_file(spark):
    with pytest.raises(ValueError, match="unreadable"):
        FittedClassifier.load(_broken(spark, "info"), spark)


def _broken(spark, part):
    path = new_path(spark, "broken")
    spark.createDataFrame([("not json {",)], "value string").write.text(f"{path}/{part}")
    return path


@pytest.mark.parametrize("case", ["demand", "both", "outage"])
def test_knn_searches_few_tiles(spark, case):
    n, rng = 20_000, np.random.default_rng(5)
    hour = np.arange(n)
    year, day = 2 * np.pi * hour / 8766, 2 * np.pi * hour / 24
    frame = pd.DataFrame(
        {
            "series": "one",
            "ts": pd.date_range("2020-01-01", periods=n, freq="h"),
            "demand": 100 + 60 * np.cos(year) + 10 * np.cos(day) + rng.normal(0, 5, n),
            "cop": 3 - np.cos(year) + 0.2 * np.sin(day) + rng.normal(0, 0.1, n),
        }
    )
    if case == "outage":
        frame.loc[9_000:9_999, "demand"] = np.nan
    else:
        frame.loc[rng.random(n) < 0.05, "demand"] = np.nan
    if case == "both":
        frame.loc[rng.random(n) < 0.05, "cop"] = np.nan
    effort = {}
    df = as_df(spark, frame)
    got = knn_impute(df, ["demand", "cop"], tile_rows=512, effort=effort).toPandas()
    assert effort["searched"] < 0.1 * effort["pairs"], effort
    got = got.sort_values("ts").reset_index(drop=True)
    some = np.flatnonzero(frame.demand.isna() | frame.cop.isna())[::97]
    values = frame[["demand", "cop"]].to_numpy()
    for i in some:
        known = ~np.isnan(values) & ~np.isnan(values[i])
        gap = np.where(known, values - values[i], 0.0) ** 2
        with np.errstate(divide="ignore", invalid="ignore"):
            d = np.where(known.any(axis=1), gap.sum(axis=1) * 2 / known.sum(axis=1), np.inf)
        for c, name in enumerate(("demand", "cop")):
            if np.isnan(values[i, c]) and known[i].any():
                usable = np.flatnonzero(~np.isnan(values[:, c]) & np.isfinite(d))
                best = usable[np.lexsort((usable, d[usable]))[:5]]
                assert got.loc[i, name] == pytest.approx(values[best, c].mean(), rel=1e-9)


def test_unseen_rows_get_stored_statistics(spark):
    train = spark.createDataFrame([(1.0,), (3.0,), (None,)], "x double")
    model = FillStatistic("mean").fit(train)
    fresh = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    assert [r.x for r in model.transform(fresh).collect()] == [2.0, 2.0]
    path = new_path(spark, "fill")
    model.save(spark, path)
    assert FillModel.load(spark, path).state == model.state


def test_scaling_rules(spark):
    df = spark.createDataFrame(
        [(float(i), 5.0, i) for i in range(5)], "x double, flat double, hour int"
    )
    rows = Scale("robust").fit(df).transform(df).orderBy("x").collect()
    assert [r.x for r in rows] == [-1.0, -0.5, 0.0, 0.5, 1.0]
    assert {r.flat for r in rows} == {0.0} and [r.hour for r in rows] == [0, 1, 2, 3, 4]
    assert Scale("standard").fit(df).state["spread"]["x"] == pytest.approx(np.std(range(5)))
    assert Scale("minmax").fit(df).state["spread"]["x"] == 4.0
    assert Scale("whatever").method == "robust"


def test_isolation_forest_finds_planted_outliers(spark, hours):
    frame = hours.dropna().head(600).copy()
    frame.loc[frame.index[:5], "heat_demand_total"] = 50_000.0
    frame.loc[frame.index[:5], "cop_average"] = 40.0
    df = as_df(spark, frame)
    model = IsolationForest(["heat_demand_total", "cop_average"], trees=50).fit(df)
    kept = model.transform(df)
    assert kept.filter("heat_demand_total = 50000").count() == 0
    assert abs(1 - kept.count() / 600 - 0.1) < 0.02
    path = new_path(spark, "forest")
    model.save(spark, path)
    again = IsolationModel.load(spark, path)
    assert again.transform(df).exceptAll(kept).count() == 0


def test_preprocessor_applies_to_its_own_and_other_rows(spark, hourly_df):
    steps = Preprocessor(
        imputation="median", window=24, layout=SeriesLayout(span_hours=100, chunk_rows=400)
    )
    processed, model = steps.fit_transform(hourly_df)
    again = model.transform(hourly_df)
    assert processed.count() == again.count()
    assert abs(processed.count() / 1200 - 0.9) < 0.02
    assert processed.columns == again.columns and "demand_lag_24h" in model.feature_names()
    assert model.info()["scaling_method"] == "robust"
    built = engineer(processed, layout=steps.layout)
    assert "heat_demand_total_rolling_p90_24h" in built.columns
    assert pipeline_info(model, ["hour"])["feature_info"]["total_features"] == 1


def findings(report):
    return {(r["check"], r["severity"], r["column"]) for r in report.collect()}


def test_checks(spark):
    schema = "ts timestamp_ntz, heat_demand_total double, cop_average double"
    empty = spark.createDataFrame([], schema)
    assert ("empty", "fatal", None) in findings(checks.check_raw(empty))
    assert not checks.is_valid(checks.check_loaded(empty)).first().is_valid
    bad = spark.createDataFrame([(-1.0,), (float("inf"),)], "heat_demand_total double")
    assert ("missing_column", "fatal", "cop_average") in findings(checks.check_raw(bad))
    assert ("negative_demand", "warning", "heat_demand_total") in findings(checks.check_raw(bad))
    assert ("missing_column", "fatal", "stress_hour") in findings(checks.check_processed(bad))
    infinite = findings(checks.check_processed(bad.withColumn("stress_hour", F.lit(1))))
    assert ("infinite", "issue", "heat_demand_total") in infinite
    assert ("high_stress_rate", "warning", "stress_hour") in infinite


def test_check_model_inputs_compares_lengths(spark):
    x = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    y = spark.createDataFrame([(0,)], "y int")
    got = findings(checks.check_model_inputs(x, ["x"], "y", labels=y))
    assert ("length_mismatch", "fatal", None) in got
    assert ("missing_feature", "issue", "x") in got
    assert ("single_class", "warning", "y") in got


def test_guard_raises(spark):
    with pytest.raises(ValueError, match="missing required"):
        checks.guard_processed(spark.range(1))
    none = spark.createDataFrame(
        [], "stress_hour int, heat_demand_total double, cop_average double"
    )
    with pytest.raises(ValueError, match="empty"):
        checks.guard_processed(none)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(600, 4))
    y = (x[:, 0] + 0.3 * rng.normal(size=600) > 1.2).astype(int)
    frame = pd.DataFrame(x, columns=[f"f{i}" for i in range(4)])
    frame["y"], frame["row_id"] = y, np.arange(600)
    return spark.createDataFrame(frame).repartition(4)


FEATURES = [f"f{i}" for i in range(4)]


@pytest.mark.parametrize(
    "kind, settings",
    [
        ("logistic", {}),
        ("random_forest", {"n_estimators": 5, "max_depth": 4}),
        ("gradient_boosting", {"n_estimators": 3}),
    ],
)
def test_models(spark, labelled, kind, settings):
    model = CostSensitiveClassifier(kind, 5.0, settings=settings).fit(labelled, FEATURES, "y")
    scored = model.score_rows(labelled).toPandas()
    assert set(scored.y_pred) <= {0, 1} and scored.y_proba.between(0, 1).all()
    assert model.accuracy(labelled) > 0.8
    table = model.importances(spark).toPandas()
    assert (table.importance >= 0).all() and table.feature[0] == "f0"
    path = new_path(spark, "deep/model")
    model.save(path)
    again = FittedClassifier.load(path).score_rows(labelled).toPandas()
    both = scored.merge(again, on="row_id")
    assert (both.y_proba_x == both.y_proba_y).all()
    assert FittedClassifier.load(path).info() == model.info()


def test_cost_raises_recall(labelled):
    def recall(ratio):
        model = CostSensitiveClassifier("logistic", ratio).fit(labelled, FEATURES, "y")
        return model.score_rows(labelled).filter("y = 1 AND y_pred = 1").count()

    assert recall(20.0) > recall(1.0)


def test_logistic_matches_the_summed_loss_formulation(labelled):
    """Gradient of 0.5 |w|^2 + C sum(weight * loss) vanishes at the fitted point."""
    model = CostSensitiveClassifier("logistic", 5.0).fit(labelled, FEATURES, "y")
    last = model.model.stages[-1]
    w, b = last.coefficients.toArray(), last.intercept
    pdf = labelled.toPandas()
    x, y = pdf[FEATURES].to_numpy(), pdf.y.to_numpy()
    p = 1 / (1 + np.exp(-(x @ w + b)))
    weight = np.where(y == 1, 5.0, 1.0)
    gradient = w + x.T @ (weight * (p - y))
    assert np.abs(gradient).max() < 0.05


def test_model_errors(spark, labelled):
    with pytest.raises(ValueError, match="unknown model"):
        CostSensitiveClassifier("svm")
    with pytest.raises(ValueError, match="must be fitted"):
        CostSensitiveClassifier("logistic").predict(labelled)
    with pytest.raises(FileNotFoundError):
        FittedClassifier.load(new_path(spark, "absent"))
    with pytest.raises(ValueError, match="unknown metric"):
        Search(metric="luck")
    with pytest.raises(FileNotFoundError):
        Search.load(spark, new_path(spark, "absent"))


def test_any_estimator_can_be_used(labelled):
    shifted = labelled.select("y", "row_id", *[(F.col(c) + 10).alias(c) for c in FEATURES])
    learner = CostSensitiveClassifier("random_forest", estimator=NaiveBayes())
    scored = learner.fit(shifted, FEATURES, "y").score_rows(shifted)
    assert scored.filter(F.col("y_proba").between(0, 1)).count() == 600


def test_single_class_keeps_equal_weights(labelled):
    learner = CostSensitiveClassifier("random_forest", settings={"n_estimators": 2})
    model = learner.fit(labelled.filter("y = 0"), FEATURES, "y")
    assert model._info["positive_weight"] == 1.0


def test_thresholds_and_search(spark, labelled):
    learner = CostSensitiveClassifier("logistic", 5.0)
    found = optimise_thresholds(learner, labelled, FEATURES, "y", 2, "row_id").toPandas()
    assert set(found.metric) == {"f1", "gmean", "balanced_accuracy", "youden"}
    assert found.threshold.between(0, 1).all()
    search = Search("random_forest", "f1", trials=2, fixed={"n_estimators": 2, "max_depth": 3})
    best = search.tune(labelled, labelled, FEATURES, "y")
    assert best == search.best()["settings"] and len(search.results) == 2


@pytest.mark.parametrize("metric", ["gmean", "auc_pr"])
def test_search_equals_separate_fits(spark, labelled, metric):
    """Trials side by side on shared vectors score like each learner alone."""
    fixed = {"n_estimators": 3, "max_depth": 3, "bootstrap": False, "max_features": "all"}
    search = Search("random_forest", metric, trials=4, fixed=fixed)
    search.tune(labelled, labelled, FEATURES, "y")
    for result in search.results:
        model = search.learner(result["settings"]).fit(labelled, FEATURES, "y")
        scored = model.score_rows(labelled)
        if metric == "auc_pr":
            want = curve_areas(score_curve(scored, label="y")).first()["auc_pr"]
        else:
            want = label_metrics(scored, names=[metric], label="y").first()[metric]
        assert result["score"] == pytest.approx(want, abs=1e-9)


def test_default_search_has_fifty_trials_in_the_ranges():
    rng = np.random.default_rng(Search().seed)
    points = [draw_settings("random_forest", rng) for _ in range(Search().trials)]
    assert len(points) == 50
    for name in ("n_estimators", "max_depth", "min_samples_leaf"):
        low, high = FOREST_RANGES[name]
        assert all(low <= p[name] <= high for p in points)
        assert len({p[name] for p in points}) > 5


def test_first_of_equal_trials_wins():
    search = Search()
    search.results = [{"trial": i, "score": s, "settings": {}} for i, s in enumerate([1, 2, 2])]
    assert search.best()["trial"] == 1


def test_missing_files(spark):
    absent = new_path(spark, "absent")
    for read in (tables.read_wide, tables.read_flat, sinks.read_document):
        with pytest.raises(FileNotFoundError):
            read(spark, absent)


def test_selection_errors_and_fallbacks(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "AT double, XX double")
    assert select.keep_columns(df, ["ZZ"]).columns == ["AT", "XX"]
    assert select.select_region(df, "QQ").first().heat_demand_total == 1.0
    with pytest.raises(ValueError, match="no column"):
        select.find_columns(df, prefix="DE_")
    with pytest.raises(ValueError, match="not found"):
        select.target(df)


def test_years_are_read_with_a_pushed_filter(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    plan = select.keep_years(events, [2024])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def test_analysis_runs_end_to_end(spark, sf_dir):
    from gridload.plans.fixtures import daily

    result = run_analysis(
        daily(spark, sf_dir), {"logistic_regression": ("logistic", {"max_iter": 20})}, folds=2
    )
    report = result.report.toPandas()
    assert sorted(report.part) == ["test", "val"]
    assert report.f1_optimal.between(0, 1).all()
    assert result.response.count() == 2 and 0 < result.metadata["stress_rate"] < 0.2
    path = new_path(spark, "results")
    sinks.save_document(
        spark, path, result.metadata, result.report, result.response, result.thresholds
    )
    document, thresholds = sinks.read_document(spark, path)
    assert document.first().metadata.num_features == 12 and thresholds.count() == 20


def counted(spark, df, column="heat_demand_total"):
    """``df`` and an accumulator of how many of its rows were read."""
    reads = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(value):
        reads.add(1)
        return value

    return df.withColumn(column, seen(column)), reads


def test_training_rows_read_the_days_once(spark, sf_dir, monkeypatch):
    days = learning_queries.daily(spark, sf_dir)
    watched, reads = counted(spark, days)
    monkeypatch.setattr(learning_queries, "daily", lambda *_: watched)
    learning_queries.training_rows(spark, sf_dir)
    assert reads.value == days.count()


def test_forests_keep_the_nodes_of_their_rows(spark, labelled):
    learner = CostSensitiveClassifier("random_forest", settings={"n_estimators": 3, "max_depth": 4})
    fitted = learner.fit(labelled, FEATURES, "y")
    assert fitted.model.stages[-1].getCacheNodeIds()
    assert spark.sparkContext.getCheckpointDir() is not None


def test_folds_are_fitted_side_by_side(spark, labelled):
    together = threading.Barrier(3, timeout=60)

    class Meeting(CostSensitiveClassifier):
        def fit(self, *args):
            together.wait()
            return super().fit(*args)

    folds = labelled.withColumn("fold", F.col("row_id") % 3)
    learner = Meeting("logistic", settings={"max_iter": 5})
    assert score_folds(learner, folds, FEATURES, "y", [0, 1, 2]).count() == 600


def test_analysis_reads_its_source_once(spark, sf_dir):
    days = learning_queries.daily(spark, sf_dir)
    watched, reads = counted(spark, days)
    prepare_rows(watched, outliers=False)
    assert reads.value == days.count()
