"""Registered queries against their SQL twins (all of them with GRIDLOAD_ALL=1)."""

from __future__ import annotations

import os

import oracle
import pytest

from gridload.plans import catalogue

QUICK = """
region_fallback_total calendar_week_fallback calendar_flags interactions parse_numbers proxy_cop
rolling_features rolling_over_gaps rolling_partial lag_features stress_dynamic_day stress_seasonal
stress_selection stress_matrix duration_steps stress_weeks example_week describe_columns
cop_profile confusion_single_class evaluate_models best_thresholds threshold_grid optimal_report
reliability_bins classification_report year_split time_series_folds stratified_folds fold_summary
response_impact_adaptive response_impact_none load_shift_impact peak_scenarios peak_trigger_empty
check_raw check_loaded check_model_inputs knn_impute scale_robust median_impute_unseen
analysis_features wide_csv processed_partitions report_csv search_checks cost_ratio_checks
""".split()

ORACLES = catalogue.all_oracles()
NAMES = sorted(ORACLES) if os.environ.get("GRIDLOAD_ALL") else QUICK


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, sf_dir, con, name):
    df = catalogue.all_queries()[name](spark, sf_dir)
    assert oracle.spark_rows(df) == oracle.oracle_rows(con, ORACLES[name])


def test_names_and_types_agree(spark, sf_dir, con):
    kinds = {
        "int": "INTEGER",
        "bigint": "BIGINT",
        "double": "DOUBLE",
        "string": "VARCHAR",
        "boolean": "BOOLEAN",
        "timestamp_ntz": "TIMESTAMP",
    }
    for name in ("stress_summary", "score_curve", "confusion_matrix", "check_raw"):
        df = catalogue.all_queries()[name](spark, sf_dir)
        mine = {f.name: kinds[f.dataType.simpleString()] for f in df.schema.fields}
        theirs = {d[0]: str(d[1]) for d in con.execute(ORACLES[name]).description}
        assert mine == theirs


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(catalogue.all_queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
