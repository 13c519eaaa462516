"""Physical plans: no pairwise joins, pruned scans, shared shuffles."""

from __future__ import annotations

import pytest

from gridload.plans import catalogue
from gridload.plans.fixtures import hourly
from gridload.prep import features


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    [
        "shift_targets",
        "load_shift_impact",
        "threshold_grid",
        "peak_scenarios",
        "seasonal_thresholds",
        "evaluate_models",
        "model_pairs",
        "stress_weeks",
        "min_max_normalise",
    ],
)
def test_no_nested_loops(spark, sf_dir, name):
    text = plan(catalogue.all_queries()[name](spark, sf_dir))
    assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_windows_run_on_chunks(spark, sf_dir):
    text = plan(features.engineer(hourly(spark, sf_dir)))
    heads = [line for line in text.splitlines() if "Window [" in line and "avg(" in line]
    # every rolling statistic and lag comes from one window pass over chunks
    assert len(heads) == 1 and "_chunk" in heads[0]
    # the rolling quantiles run in the same partitioning: no shuffle in between
    between = text[text.index("FlatMapGroupsInArrow") : text.index(heads[0])]
    assert "Exchange" not in between


def test_scan_reads_only_what_is_used(spark, sf_dir):
    text = plan(catalogue.all_queries()["peak_scenarios"](spark, sf_dir))
    scans = [line for line in text.splitlines() if "FileScan" in line]
    assert scans and all("ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double,props:string>" in s for s in scans)


def test_example_week_numbers_winter_once(spark, sf_dir):
    """Starts, week and remainder read one written numbering: no window over all winter rows."""
    text = plan(catalogue.all_queries()["example_week"](spark, sf_dir))
    text = text.split("Initial Plan")[-1]
    assert "durable-" in text and text.count("Exchange") < 15
