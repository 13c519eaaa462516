"""Quantiles: bracket path against numpy, brackets alone shuffled, wide tables of groups."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridload.operators import quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    """60,000 values; a fifth tied, a hot group, nulls, NaN and both infinities."""
    rng = np.random.default_rng(5)
    x = np.where(rng.random(60_000) < 0.2, 7.0, rng.lognormal(3, 2, 60_000))
    x[:2] = [np.inf, -np.inf]
    pdf = pd.DataFrame({"k": np.where(rng.random(60_000) < 0.97, "hot", "cold"), "x": x})
    pdf["y"] = rng.normal(size=60_000)
    pdf.loc[::13, "y"] = np.nan
    return pdf, spark.createDataFrame(pdf).repartition(7)


PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def check(got, pdf, keys):
    for _, row in got.iterrows():
        part = pdf if not keys else pdf[pdf.k == row.k]
        values = np.sort(part[row["column"]].dropna().to_numpy())
        h = (len(values) - 1) * row.prob
        low, high = values[int(np.floor(h))], values[int(np.ceil(h))]
        want = low if low == high else low + (high - low) * (h - np.floor(h))
        assert row.value == pytest.approx(want, rel=1e-12), (row["column"], row.prob)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_bracketed_quantiles_are_exact(skewed, keys):
    pdf, df = skewed
    got = quantiles.quantiles(df, keys, ["x", "y"], PROBS).toPandas()
    assert len(got) == 2 * len(PROBS) * (2 if keys else 1)
    check(got[got.prob.between(0.05, 0.95)], pdf, keys)
    ends = got[(got["column"] == "x") & got.prob.isin([0.0, 1.0])]
    assert np.isinf(ends.value).sum() == 2
    check(got[got["column"] == "y"], pdf, keys)


def test_many_groups_take_the_other_path(skewed, monkeypatch):
    pdf, df = skewed
    monkeypatch.setattr(quantiles, "SMALL", 1)
    check(quantiles.quantiles(df, ["k"], ["y"], PROBS).toPandas(), pdf, ["k"])


def test_only_bracketed_values_are_ranked(skewed, monkeypatch):
    """What is sorted and shuffled by value is a small part of all distinct values."""
    pdf, df = skewed
    seen = []
    plain = quantiles.running_totals
    monkeypatch.setattr(
        quantiles, "running_totals", lambda d, *a, **k: seen.append(d) or plain(d, *a, **k)
    )
    quantiles.quantiles(df, [], ["y"], [0.1, 0.9]).collect()
    (ranked,) = seen
    assert 0 < ranked.count() < 0.02 * pdf.y.nunique()
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    aggregate, filtered = plan.index("Aggregate"), plan.index("value#")
    assert "Join Inner" in plan and aggregate <= filtered


def test_bracket_that_misses_is_widened(spark):
    """Brackets from elsewhere: ranks outside them must still come out right."""
    df = spark.range(1000).select(F.col("id").cast("double").alias("value"), F.lit("x").alias("column"))
    wrong = spark.createDataFrame([("x", 2000.0, 3000.0)], "column string, _lo0 double, _hi0 double")
    row = quantiles.checked_brackets(df, ["column"], [0.5], wrong).first()
    assert (row._total, row._lo0, row._hi0, row._out0) == (1000, -np.inf, np.inf, 0)


def test_no_rows_and_null_keys(spark):
    df = spark.createDataFrame([(None, 1.0), ("a", None), ("b", 2.0)], "k string, x double")
    assert quantiles.quantiles(df.limit(0), [], ["x"], [0.5]).count() == 0
    got = quantiles.quantiles(df, ["k"], ["x"], [0.5]).collect()
    assert [(r.k, r.value) for r in got] == [("b", 2.0)]
