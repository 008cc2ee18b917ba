"""Rows and tasks of the fits of the search."""

from __future__ import annotations

from pyspark.ml.linalg import Vectors

from tillwise.operators import search as se


def test_tasks_of_a_fit_fill_the_cores_and_stay_bounded():
    assert se.tasks_per_fit(0, 5, 12) == 1
    assert se.tasks_per_fit(36_000, 5, 12) == 1
    assert se.tasks_per_fit(360_000, 5, 12) == 3  # not one per 50,000 rows: five fits run side by side
    assert se.tasks_per_fit(2_100_000, 5, 12) == 5
    assert se.tasks_per_fit(50_000_000, 5, 12) == 100


def test_folds_keep_only_the_columns_of_a_fit(spark):
    kinds = "Customer_ID string, Split string, Recency double, RetentionLabel int, Weight double"
    made = [(f"{k:02d}", "train", float(k), k % 2, 1.0) for k in range(30)]
    rows = spark.createDataFrame(made, kinds).rdd.map(lambda r: (*r, Vectors.dense([r["Recency"]]))).toDF(
        ["Customer_ID", "Split", "Recency", "RetentionLabel", "Weight", "vector"]
    )
    parts = se.fold_parts(rows, 5)
    assert all(part.fit.columns == ["Fold", "RetentionLabel", "Weight", "vector"] for part in parts)
    assert [part.held.count() for part in parts] == [6] * 5 and [part.rows for part in parts] == [24] * 5
    for part in parts:
        part.fit.unpersist()
