"""Stress labels and demand response on hand-made rows."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridload.operators import response, stress
from gridload.operators.ordering import SeriesLayout

TINY = SeriesLayout(span_hours=30, chunk_rows=400)


def series(spark, demand, cop=None, marks=None):
    rows = pd.DataFrame(
        {
            "series": "s",
            "ts": pd.date_range("2020-01-01", periods=len(demand), freq="h"),
            "heat_demand_total": [float(d) for d in demand],
            "cop_average": [float(c) for c in (cop or [3.0] * len(demand))],
            "stress_hour": marks or [0] * len(demand),
        }
    )
    df = spark.createDataFrame(rows)
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_dynamic_label_includes_limits_and_warm_up_is_zero(spark):
    df = series(spark, [1, 2, 3, 3, 3], [5, 4, 3, 3, 3]).drop("stress_hour")
    got = stress.label_dynamic(df, window=3, layout=TINY).orderBy("ts").collect()
    assert [r.stress_hour for r in got] == [0, 0, 1, 1, 1]
    assert got[1].demand_threshold is None


def test_label_implies_both_conditions(hourly_df):
    got = stress.label_dynamic(hourly_df, window=24, layout=TINY).toPandas()
    marked = got[got.stress_hour == 1]
    assert len(marked) and (marked.high_demand == 1).all() and (marked.low_cop == 1).all()


def test_missing_columns_give_zero(spark):
    got = stress.label_dynamic(series(spark, [1, 2]).drop("cop_average", "stress_hour"))
    assert got.agg(F.sum("stress_hour")).first()[0] == 0


def test_scaling_demand_leaves_the_label_unchanged(hourly_df):
    a = stress.label_dynamic(hourly_df, window=24, layout=TINY)
    doubled = hourly_df.withColumn("heat_demand_total", F.col("heat_demand_total") * 2)
    b = stress.label_dynamic(doubled, window=24, layout=TINY)
    keys = ["series", "ts", "stress_hour"]
    assert a.select(keys).exceptAll(b.select(keys)).count() == 0


def test_seasonal_label_is_strict(spark):
    calm = series(spark, [50] * 40, [4.5] * 40).drop("stress_hour")
    assert stress.label_seasonal(calm).agg(F.sum("stress_hour")).first()[0] == 0


@pytest.mark.parametrize("strategy, share", [("conservative", 0.05), ("aggressive", 0.15)])
def test_reductions(spark, strategy, share):
    df = series(spark, [100, 200], marks=[0, 1])
    got = response.respond(df, strategy).orderBy("ts").collect()
    assert [r.demand_change for r in got] == [None, pytest.approx(-200 * share)]
    assert got[1].adjusted_demand == pytest.approx(200 * (1 - share))


def test_adaptive_without_a_window_does_nothing(spark):
    df = series(spark, [100, 200, 400], [3, 3, 1], marks=[1, 0, 1])
    got = response.respond(df, "adaptive", window=3, layout=TINY).orderBy("ts").collect()
    assert got[0].demand_change is None and got[0].adjusted_demand == 100
    # thresholds 360 and 1.4: severity (400/360 + 1.4/1) / 2
    assert got[2].severity_factor == pytest.approx((400 / 360 + 1.4) / 2)
    assert got[2].demand_change == pytest.approx(-400 * 0.1 * (400 / 360 + 1.4) / 2)


def test_adaptive_severity_is_limited(spark):
    df = series(spark, [1, 1, 100], [5, 5, 0.1], marks=[0, 0, 1])
    got = response.respond(df, "adaptive", window=3, layout=TINY).orderBy("ts").collect()
    assert got[2].severity_factor > 2
    assert got[2].demand_change == pytest.approx(-100 * 0.1 * 2.0)


def test_adaptive_impact_in_one_pass_equals_two(hourly_df):
    marked = stress.label_dynamic(hourly_df, window=24, layout=TINY)
    kept = marked.drop("demand_threshold", "cop_threshold")
    one = response.response_impact(kept, "adaptive", window=24, layout=TINY)
    acted = response.respond(kept, "adaptive", window=24, layout=TINY)
    relabelled = stress.label_dynamic(
        acted.drop("demand_threshold", "cop_threshold", "stress_hour"),
        "adjusted_demand",
        window=24,
        layout=TINY,
    )
    want = relabelled.groupBy("series").agg(F.sum("stress_hour").alias("n")).toPandas()
    got = one.select("series", F.col("stress_hours_after_dr").alias("n")).toPandas()
    assert sorted(map(tuple, got.values)) == sorted(map(tuple, want.values))


def test_no_stress_reports_none(spark):
    row = response.response_impact(series(spark, [50] * 5), window=3, layout=TINY).first()
    assert (row.strategy, row.dr_actions_count, row.total_demand_change) == ("none", 0, 0.0)
    moved = response.shift_impact(series(spark, [50] * 5), window=3, layout=TINY).first()
    assert (moved.dr_actions_count, moved.average_demand_shift) == (0, 0.0)


def test_unknown_strategy(spark):
    with pytest.raises(ValueError, match="unknown strategy"):
        response.respond(series(spark, [1]), "brave")


def test_shift_goes_to_the_earliest_lowest_hour(spark):
    df = series(spark, [5, 1, 9, 1, 7, 7, 7, 7, 0], marks=[0, 0, 1, 0, 0, 0, 0, 0, 0])
    got = response.plan_load_shift(df, max_shift_hours=4).collect()
    assert [(r.ts.hour, r.shift_time.hour) for r in got] == [(2, 1)]
    assert got[0].shiftable_demand == pytest.approx(0.9)


def test_shift_needs_a_strictly_lower_hour(spark):
    df = series(spark, [4, 4, 4], marks=[0, 1, 0])
    assert response.plan_load_shift(df).count() == 0


def test_two_hours_may_share_a_target_and_nothing_is_lost(spark):
    df = series(spark, [9, 8, 1, 5], marks=[1, 1, 0, 0])
    plan = response.plan_load_shift(df)
    got = response.apply_shift(df, plan).orderBy("ts").collect()
    assert [round(r.adjusted_demand, 6) for r in got] == [8.1, 7.2, 2.7, 5.0]
    assert sum(r.shift_change for r in got) == pytest.approx(0)


def test_reachable_hours_skip_gaps(spark):
    df = series(spark, [1, 1, 1, 1], marks=[1, 0, 0, 0]).filter("hour(ts) <> 1")
    got = response.reachable_hours(df, max_shift_hours=2).collect()
    assert sorted(r.candidate.hour for r in got) == [0, 2]


def test_trigger_estimate(spark):
    df = series(spark, [10] * 24).withColumn("y_proba", F.hour("ts") / 20)
    row = response.trigger_estimates(
        df, [{"scenario": "x", "tau": 0.95, "alpha": 0.2}]
    ).first()
    # hours 19, 20, 21 of the five peak hours reach 0.95
    assert row.interventions == 3
    assert row.shifted_energy == pytest.approx(50 * 0.2 * 3 / 5)
    assert row.peak_reduction_percent == pytest.approx(12.0)


def test_report_handles_no_interventions(spark):
    df = spark.createDataFrame(
        [("calm", 0, 0.0)], "scenario string, interventions long, peak_reduction_percent double"
    )
    row = response.response_table(df).first()
    assert row["Scenario"] == "Calm" and row["Efficiency (Reduction/Intervention)"] is None
