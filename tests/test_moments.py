"""Correlations from one pass against pandas; thresholds by slots against plain counts; distinct counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillwise.operators import behaviour as be
from tillwise.operators import cleaning as cl
from tillwise.operators import metrics as me


def frame(spark):
    draw = np.random.default_rng(3)
    pdf = pd.DataFrame(draw.normal(size=(500, 4)) * [1, 100, 1e-3, 5] + [1e6, 0, 7, -3], columns=list("abcd"))
    pdf["b"] += pdf["a"] * 50
    pdf["same"] = 0.1
    pdf["a"] = pdf["a"].where(draw.random(500) > 0.2)
    pdf["d"] = pdf["d"].where(draw.random(500) > 0.5)
    pdf["none"] = np.nan
    df = spark.createDataFrame(pdf)
    return pdf, df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in df.columns]).repartition(7)


def test_correlations_from_one_pass(spark):
    pdf, df = frame(spark)
    names = list(pdf.columns)
    found = {(r["X"], r["Y"]): r["Correlation"] for r in be.correlation_matrix(df, names, 6).collect()}
    expected = pdf.corr()
    for x in names:
        for y in names:
            known = "same" not in (x, y) and "none" not in (x, y)
            assert found[x, y] == pytest.approx(expected.loc[x, y] if known else 0.0, abs=2e-6), (x, y)
    to_label = {r["Measure"]: r["Correlation"] for r in be.label_correlations(df, ["a", "b", "same"], "d").collect()}
    assert to_label["same"] is None
    assert to_label["a"] == pytest.approx(expected.loc["a", "d"]) and to_label["b"] == pytest.approx(expected.loc["b", "d"])
    assert {r["Correlation"] for r in be.correlation_matrix(df.limit(0), names).collect()} == {0.0}
    plan = be.correlation_matrix(df, names)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1


def test_thresholds_by_slots(spark):
    draw = np.random.default_rng(4)
    pdf = pd.DataFrame({"s": np.round(draw.random(400), 2), "y": draw.integers(0, 2, 400)})
    marks = [0.5, 0.1, 0.25, 0.9, 1.0, 0.0]
    df = spark.createDataFrame(pdf)
    for row in me.threshold_sweep(df, "y", "s", marks).collect():
        decided = pdf["s"] >= row["Threshold"]
        hits = (decided & (pdf["y"] == 1)).sum()
        assert row["Recall"] == pytest.approx(hits / (pdf["y"] == 1).sum())
        assert row["Precision"] == (pytest.approx(hits / decided.sum()) if decided.any() else None)
    plan = me.threshold_sweep(df, "y", "s", marks)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_distinct_counts_without_expand(spark):
    rows = [(1, "a", 0.0), (2, "a", -0.0), (None, "b", 1.5), (2, None, 1.5), (2, None, None)]
    df = spark.createDataFrame(rows, "i int, s string, d double")
    found = cl.distinct_counts(df.withColumn("empty", F.lit(None).cast("string")))
    assert {r["Column"]: r["DistinctValues"] for r in found.collect()} == {"i": 2, "s": 2, "d": 2, "empty": 0}
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()
