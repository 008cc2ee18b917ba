"""What the physical plans must and must not contain."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tillwise.functions.lineage import ensure_checkpoint_dir
from tillwise.operators import models as mo
from tillwise.operators import segments as sg
from tillwise.plans import inputs
from tillwise.plans.inputs import kept_features

FOLDER = "/root/testdata/sf0.001"
QUERIES = entry.queries()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    [
        "fea26_customer_features",
        "cln15_cleaning_funnel",
        "eda05_top_countries",
        "tsr01_weekly_series",
        "eda10_revenue_per_month",
    ],
)
def test_no_python_and_no_cross_product(spark, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    for word in ("Python", "ArrowEval", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan, word


def test_lines_are_dealt_once_after_the_joins(spark):
    """Copies, products per invoice and invoices follow from one shuffle of the lines by customer and invoice."""
    plan = plan_of(QUERIES["fea26_customer_features"](spark, FOLDER))
    dealt = [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "Exchange hashpartitioning(Customer_ID" in line]
    assert len(dealt) == 3  # lines, days of a customer, customers
    assert not any("Description" in keys or "StockCode" in keys for keys in dealt)


def test_copies_and_products_follow_from_one_sort(spark):
    """The dealt lines are sorted once per task; no hash table holds whole lines or the codes of an invoice."""
    plan = plan_of(QUERIES["fea26_customer_features"](spark, FOLDER)).splitlines()
    grouped = [line.split("functions=")[0] for line in plan if "Aggregate(keys=" in line]
    assert grouped and not any("Description" in keys or "StockCode" in keys for keys in grouped)
    sorts = [line for line in plan if "Sort [Customer_ID" in line and "Invoice" in line]
    assert len(sorts) == 1


def test_scan_reads_only_what_is_needed(spark):
    plan = plan_of(QUERIES["src03_column_subset"](spark, FOLDER))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in plan


def test_sheet_dates_reach_the_scan(spark):
    plan = plan_of(QUERIES["src01_union_parts"](spark, FOLDER))
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan


def test_samples_number_rows_in_buckets(spark):
    """No window takes all rows of a feature into one task."""
    plan = plan_of(QUERIES["eda08_feature_samples"](spark, FOLDER))
    assert "row_number() windowspecdefinition(Measure" in plan
    for part in plan.split("row_number() windowspecdefinition(")[1:]:
        assert "_bucket" in part.split("_hash")[0]


def test_checkpoint_folder_is_kept(spark):
    assert ensure_checkpoint_dir(spark) == ensure_checkpoint_dir(spark)


def test_fitted_models(spark):
    """Invariants of fits that have no SQL."""
    features = kept_features(spark, FOLDER)
    rows = mo.model_rows(features)
    scored = mo.classify(rows, "LogisticRegression").collect()
    assert scored and all(0 <= r["Score"] <= 1 and r["Decision"] in (0, 1) for r in scored)
    spend = mo.tweedie_spend(rows).collect()
    assert len(spend) == len(scored) and all(r["Predicted"] >= 0 for r in spend)
    matrix = sg.cluster_matrix(features)
    labels = sg.kmeans_labels(matrix, 4, 3)
    assert labels.count() == features.count()
    assert {r["Cluster"] for r in labels.select("Cluster").distinct().collect()} <= set(range(4))


@pytest.mark.parametrize("name", ["att03_case_contributions", "rep03_kpi_cards", "rep04_report_metrics"])
def test_reports_build_features_once(spark, monkeypatch, name):
    built = []
    features = inputs.features
    monkeypatch.setattr(inputs, "features", lambda *args: built.append(args) or features(*args))
    QUERIES[name](spark, FOLDER)
    assert len(built) == 1
