"""Positions, chunked windows, running totals and quantiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridload.operators import ordering, quantiles, rolling
from gridload.operators.ordering import SeriesLayout

TINY = SeriesLayout(span_hours=30, chunk_rows=40)
WHOLE = SeriesLayout(chunk_rows=None)


def frame(df, *by):
    return df.toPandas().sort_values(list(by)).reset_index(drop=True)


def test_positions_count_rows_in_time_order(hourly_df):
    got = frame(ordering.time_position(hourly_df, TINY, "p", total="n"), "series", "ts")
    assert (got.p == got.groupby("series").cumcount()).all()
    assert (got.n == got.groupby("series").ts.transform("count")).all()


def test_positions_without_keys(hourly_df):
    layout = SeriesLayout(keys=(), span_hours=30)
    got = frame(ordering.time_position(hourly_df, layout, "p", ties=["series"]), "ts", "series")
    assert got.p.tolist() == list(range(len(got)))


@pytest.mark.parametrize("chunk", [23, 40, 10_000])
def test_chunked_windows_equal_plain_windows(hourly_df, chunk):
    layout = SeriesLayout(span_hours=30, chunk_rows=chunk)
    columns = ["heat_demand_total", "cop_average"]
    cut = rolling.add_rolling(hourly_df, columns, [24], layout)
    plain = rolling.add_rolling(hourly_df, columns, [24], WHOLE)
    pd.testing.assert_frame_equal(frame(cut, "series", "ts"), frame(plain, "series", "ts"))


def test_stages_share_one_pass(hourly_df):
    stages = [
        lambda win: {"a": F.sum("cop_average").over(win.trailing(10))},
        lambda win: {"b": F.sum("a").over(win.trailing(10))},
    ]
    cut = ordering.with_series_windows(hourly_df, 18, stages, SeriesLayout(chunk_rows=50))
    plain = ordering.with_series_windows(hourly_df, 18, stages, WHOLE)
    pd.testing.assert_frame_equal(frame(cut, "series", "ts"), frame(plain, "series", "ts"))


def test_numbering_is_shared(hourly_df):
    numbered = ordering.number_rows(hourly_df, TINY)
    got = rolling.add_lags(numbered, ["cop_average"], [1], TINY)
    want = rolling.add_lags(hourly_df, ["cop_average"], [1], WHOLE)
    pd.testing.assert_frame_equal(
        frame(ordering.drop_numbers(got), "series", "ts"), frame(want, "series", "ts")
    )


def test_look_back_may_span_several_chunks(hourly_df):
    got = rolling.add_rolling(hourly_df, ["cop_average"], [168], TINY)
    want = rolling.add_rolling(hourly_df, ["cop_average"], [168], WHOLE)
    pd.testing.assert_frame_equal(frame(got, "series", "ts"), frame(want, "series", "ts"))


def test_rolling_matches_pandas(hourly_df, hours):
    got = frame(
        rolling.add_rolling(hourly_df, ["heat_demand_total", "absent"], [6], TINY), "series", "ts"
    )
    src = hours.sort_values(["series", "ts"]).reset_index(drop=True)
    moving = src.groupby("series").heat_demand_total.rolling(6)
    checks = {
        "mean": moving.mean(),
        "std": moving.std(),
        "max": moving.max(),
        "min": moving.min(),
        "p90": moving.quantile(0.9),
        "p10": moving.quantile(0.1),
    }
    for stat, want in checks.items():
        column = got[f"heat_demand_total_rolling_{stat}_6h"].to_numpy(dtype=float)
        np.testing.assert_allclose(column, want.to_numpy(), rtol=1e-9, atol=1e-9)


def test_partial_frames_match_pandas(hourly_df, hours):
    got = frame(rolling.add_partial_rolling(hourly_df, windows=(24,), layout=TINY), "series", "ts")
    src = hours.sort_values(["series", "ts"]).reset_index(drop=True)
    want = src.groupby("series").heat_demand_total.rolling(24, min_periods=1).mean()
    np.testing.assert_allclose(got.demand_ma_24.astype(float), want.to_numpy(), rtol=1e-9)


def test_label_lag_defaults_to_zero(hourly_df):
    marked = hourly_df.withColumn("stress_hour", F.lit(1))
    got = frame(rolling.add_label_lags(marked, lags=[2], layout=TINY), "series", "ts")
    assert got.groupby("series").stress_lag_2.sum().tolist() == [898, 298]


@pytest.mark.parametrize("buckets", [2, 16, 300])
@pytest.mark.parametrize("descending", [True, False])
def test_running_totals_are_exact(spark, buckets, descending):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(
        {"k": rng.choice(["a", "b"], 500, p=[0.9, 0.1]), "v": rng.normal(size=500).round(1)}
    )
    table = spark.createDataFrame(pdf).groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    got = ordering.running_totals(
        table, ["k"], "v", ["n"], descending=descending, buckets=buckets
    ).toPandas().sort_values(["k", "v"], ascending=[True, not descending])
    want = pdf.groupby(["k", "v"]).size().reset_index(name="n")
    want = want.sort_values(["k", "v"], ascending=[True, not descending])
    assert got.cum_n.tolist() == want.groupby("k").n.cumsum().tolist()
    assert got.total_n.tolist() == want.groupby("k").n.transform("sum").tolist()


def test_quantiles_match_numpy_under_skew(spark):
    rng = np.random.default_rng(2)
    values = np.where(rng.random(3000) < 0.4, 7.0, rng.exponential(50, 3000))
    keys = np.where(rng.random(3000) < 0.95, "hot", "cold")
    pdf = pd.DataFrame({"k": keys, "x": values, "y": rng.normal(size=3000)})
    pdf.loc[::17, "y"] = np.nan
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = quantiles.quantiles(spark.createDataFrame(pdf), ["k"], ["x", "y"], probs).toPandas()
    assert len(got) == 20
    for _, row in got.iterrows():
        want = np.nanquantile(pdf.loc[pdf.k == row.k, row["column"]], row.prob)
        assert row.value == pytest.approx(want, rel=1e-12, abs=1e-12)


def test_split_index_counts_splits_below(spark):
    splits = F.array(*[F.lit(v) for v in (1.0, 2.0, 2.0, 5.0)])
    df = spark.createDataFrame([(0.5,), (1.0,), (1.5,), (2.0,), (3.0,), (9.0,)], "v double")
    got = df.select(ordering.split_index(splits, F.col("v"), 8).alias("i")).collect()
    assert [r.i for r in got] == [0, 0, 1, 1, 3, 4]
