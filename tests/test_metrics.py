"""Metric values on small and generated inputs."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridload.operators import folds, metrics


def scored(spark, rows):
    return spark.createDataFrame(rows, "y_true int, y_proba double")


def brute(y, p):
    pairs = [(a, b) for a, i in zip(p, y) if i for b, j in zip(p, y) if not j]
    auc = sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs)
    ap, before = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit = [i for i, q in zip(y, p) if q >= t]
        recall = sum(hit) / sum(y)
        ap += (recall - before) * sum(hit) / len(hit)
        before = recall
    return auc, ap


def test_average_precision_is_stepwise(spark):
    df = scored(spark, [(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)])
    areas = metrics.curve_areas(metrics.score_curve(df)).first()
    assert areas.auc_roc == pytest.approx(0.75)
    assert areas.auc_pr == pytest.approx(0.8333333, abs=1e-6)
    assert areas.pr_area == pytest.approx(0.7916667, abs=1e-6)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.tuples(st.integers(0, 1), st.integers(0, 10)), min_size=4, max_size=40).filter(
        lambda rows: len({r[0] for r in rows}) == 2
    )
)
def test_areas_match_brute_force(spark, rows):
    y, p = [r[0] for r in rows], [r[1] / 10 for r in rows]
    df = scored(spark, list(zip(y, p)))
    areas = metrics.curve_areas(metrics.score_curve(df)).first()
    auc, ap = brute(y, p)
    assert areas.auc_roc == pytest.approx(auc)
    assert areas.auc_pr == pytest.approx(ap)
    bundle = metrics.evaluate(df.withColumn("y_pred", metrics.predict_at(0.5))).first()
    for name in ("accuracy", "precision", "recall", "f1", "gmean", "balanced_accuracy"):
        assert 0 <= bundle[name] <= 1
    assert -1 <= bundle.youden_j <= 1


def test_one_class(spark):
    df = scored(spark, [(0, 0.1), (0, 0.2)]).withColumn("y_pred", F.lit(0))
    row = metrics.evaluate(df).first()
    assert (row.tn, row.gmean, row.balanced_accuracy, row.youden_j) == (0, 0.0, 0.0, -1.0)
    assert (row.auc_roc, row.auc_pr, row.accuracy) == (0.5, 0.5, 1.0)


def test_all_zeros_against_all_ones(spark):
    df = scored(spark, [(0, 0.9)] * 5).withColumn("y_pred", F.lit(1))
    row = metrics.evaluate(df).first()
    assert (row.fp, row.precision, row.specificity, row.youden_j) == (5, 0.0, 0.0, -1.0)


def test_lowest_threshold_wins_ties(spark):
    df = scored(spark, [(1, 0.9), (1, 0.8), (0, 0.2), (0, 0.1)])
    best = {r.metric: (r.threshold, r.score) for r in metrics.best_thresholds(df).collect()}
    assert best["f1"] == (0.8, 1.0)
    # every threshold below catches all rows: recall 1, specificity 0 at 0.1
    flat = scored(spark, [(0, 0.3), (0, 0.6)])
    tied = {r.metric: r.threshold for r in metrics.best_thresholds(flat).collect()}
    assert tied["f1"] == 0.3


def test_no_rows_give_the_default_threshold(spark):
    rows = metrics.best_thresholds(scored(spark, [])).collect()
    assert {(r.threshold, r.score) for r in rows} == {(0.5, 0.0)}


def test_threshold_grid_counts(spark):
    rng = np.random.default_rng(0)
    p = rng.random(400).round(2)
    y = (rng.random(400) < p).astype(int)
    got = metrics.threshold_analysis(
        scored(spark, [(int(a), float(b)) for a, b in zip(y, p)])
    ).toPandas()
    assert len(got) == 81
    for _, row in got.iterrows():
        hit = p >= row.threshold
        assert row.accuracy == pytest.approx((hit == y).mean())


def test_unknown_metric(spark):
    with pytest.raises(ValueError, match="unknown metric"):
        metrics.metric("nope")


def test_comparison_sorts_by_either_name(spark):
    df = spark.createDataFrame(
        [("a", 1, 0), ("a", 0, 0), ("b", 1, 1), ("b", 0, 0)], "model string, y_true int, y_pred int"
    )
    table = metrics.evaluate(df, ["model"], score=None)
    for name in ("gmean", "G-mean"):
        assert [r.Model for r in metrics.compare_models(table, name).collect()] == ["b", "a"]


def test_reliability_edges_close_on_the_right(spark):
    df = scored(spark, [(0, 0.0), (1, 0.1), (1, 0.3), (0, 0.30000000000000004), (1, 1.0)])
    got = {r.bin: r.rows for r in metrics.reliability_bins(df).collect()}
    # the third inner edge is 3 * 0.1, a little above 0.3
    assert got == {0: 2, 2: 2, 9: 1}


def test_expanding_folds(spark):
    df = spark.range(23).select(
        F.lit("s").alias("series"),
        (F.lit("2020-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("ts"),
    )
    got = folds.time_series_folds(df, 5).toPandas().sort_values("ts").test_fold.tolist()
    assert got == [0] * 8 + [f for f in range(1, 6) for _ in range(3)]
    sizes = folds.fold_sizes(folds.time_series_folds(df, 5)).collect()
    assert [(r.train_size, r.val_size) for r in sizes] == [(8 + 3 * i, 3) for i in range(5)]


def test_stratified_folds_are_even_on_ten_rows(spark):
    df = spark.range(10).select(F.col("id").alias("event_id"), (F.col("id") < 4).cast("int").alias("y_true"))
    got = folds.stratified_folds(df, 2).toPandas()
    assert got.groupby(["y_true", "fold"]).size().tolist() == [3, 3, 2, 2]
    again = folds.stratified_folds(df.repartition(5), 2).toPandas()
    pd.testing.assert_frame_equal(
        got.sort_values("event_id").reset_index(drop=True),
        again.sort_values("event_id").reset_index(drop=True),
    )


def test_fold_summary_uses_population_deviation(spark):
    df = spark.createDataFrame([("f1", 0.2), ("f1", 0.4)], "metric string, score double")
    row = folds.fold_summary(df).first()
    assert (row["mean"], row["std"]) == (pytest.approx(0.3), pytest.approx(0.1))


def test_year_split_with_two_years(spark):
    df = spark.createDataFrame([("2019-05-01",), ("2020-05-01",)], "d string").select(
        F.col("d").cast("timestamp_ntz").alias("ts")
    )
    got = folds.year_split(df).orderBy("ts").collect()
    assert [(r.in_train, r.in_val, r.in_test) for r in got] == [(1, 0, 0), (0, 1, 1)]
