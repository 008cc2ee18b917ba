"""Registered queries against their SQL in DuckDB.

One query per kind runs by default; TILLWISE_ALL=1 runs every registered query.
"""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from compare import compare, duck

SF = os.environ.get("TILLWISE_SF", "sf0.001")
FOLDER = f"/root/testdata/{SF}"
CHOSEN = (
    "src01_union_parts",
    "cln08_drop_exact_copies",
    "cln15_cleaning_funnel",
    "cln16_cleaning_summary",
    "fea03_recently_active",
    "fea14_previous_invoice",
    "fea26_customer_features",
    "eda02_gap_distribution",
    "eda06_price_sample",
    "eda09_correlation_matrix",
    "eda17_target_quantiles",
    "pre05_scaled_groups",
    "pre06_stratified_split",
    "met01_regression_metrics",
    "met05_pr_auc_brier",
    "met15_model_comparison",
    "dia03_error_by_actual_decile",
    "dia05_lift_table",
    "seg05_davies_bouldin",
    "seg17_segment_cards",
    "mod03_knn_classifier_weighted",
    "mod20_best_trials",
    "tsr01_weekly_by_country",
    "tsr10_seasonal_autoregressive",
    "tsr11_lag_features",
    "tsr16_decomposition",
    "att03_case_contributions",
    "vue01_systematic_sample",
    "vue03_first_per_key",
)
QUERIES, SQL = entry.queries(), entry.oracle_sql()
NAMES = list(QUERIES) if os.environ.get("TILLWISE_ALL") else list(CHOSEN)


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    problem, rows = compare(spark, con, FOLDER, name, QUERIES[name], SQL.get(name))
    assert problem is None, problem
    assert rows > 0
