"""Distributed ranks, quantiles and curves against plain numpy and pandas."""

from __future__ import annotations

import golden
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillwise.functions import ranking as rk
from tillwise.operators import diagnostics as di
from tillwise.operators import metrics as me


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value."""
    rng = np.random.default_rng(7)
    n = 900
    actual = np.where(rng.random(n) < 0.4, 0.0, np.round(rng.gamma(1.5, 80, n), 1))
    predicted = np.where(rng.random(n) < 0.35, 5.0, np.round(actual * 0.7 + rng.normal(20, 30, n), 0))
    pdf = pd.DataFrame({"Customer_ID": [f"{i:05d}" for i in range(n)], "Actual": actual, "Predicted": predicted})
    pdf["Label"] = (pdf["Actual"] > 0).astype(int)
    return pdf, spark.createDataFrame(pdf)


def test_positions(skewed):
    pdf, df = skewed
    found = rk.row_positions(df, [F.col("Actual"), F.col("Customer_ID")], ["Label"]).toPandas()
    want = pdf.sort_values(["Actual", "Customer_ID"]).groupby("Label").cumcount() + 1
    merged = found.set_index("Customer_ID")["Position"]
    assert (merged.loc[pdf.loc[want.index, "Customer_ID"]].to_numpy() == want.to_numpy()).all()


def test_hash_positions(skewed):
    _, df = skewed
    found = rk.hash_positions(df, "Customer_ID", ["Label"]).toPandas()
    for _, part in found.groupby("Label"):
        assert sorted(part["Position"]) == list(range(1, len(part) + 1))
        assert (part["StratumSize"] == len(part)).all()


def test_quantiles(skewed):
    pdf, df = skewed
    found = rk.exact_quantiles(df, ["Actual", "Predicted"], {"a": 0.25, "b": 0.5, "c": 0.99}, ["Label"]).collect()
    for row in found:
        values = pdf.loc[pdf["Label"] == row["Label"], row["Measure"]]
        assert [row["a"], row["b"], row["c"]] == pytest.approx(list(values.quantile([0.25, 0.5, 0.99])))


@pytest.mark.parametrize("sketch", [10_000, 40])
def test_quantiles_inside_brackets(spark, monkeypatch, sketch):
    """Large groups: only the rows inside a bracket are sorted; a third share one value, some are null."""
    monkeypatch.setattr(rk, "FEW_ROWS", 300)
    monkeypatch.setattr(rk, "SKETCH", sketch)
    rng = np.random.default_rng(3)
    n = 9000
    pdf = pd.DataFrame({"g": rng.integers(0, 3, n), "v": rng.gamma(1.2, 50, n), "w": rng.integers(0, 9, n).astype(float)})
    pdf.loc[rng.random(n) < 0.33, "v"] = 12.5
    pdf.loc[pdf["g"] == 2, "g"] = np.where(rng.random((pdf["g"] == 2).sum()) < 0.05, 2, 1)
    df = spark.createDataFrame(pdf).withColumn("v", F.when(F.col("w") != 4, F.col("v"))).repartition(7)
    pdf.loc[pdf["w"] == 4, "v"] = np.nan
    shares = {"least": 0.0, "a": 0.01, "b": 0.25, "c": 0.5, "d": 0.999, "most": 1.0}
    for row in rk.exact_quantiles(df, ["v", "w"], shares, ["g"]).collect():
        values = pdf.loc[pdf["g"] == row["g"], row["Measure"]].dropna()
        assert row["Rows"] == len(values)
        assert [row[k] for k in shares] == pytest.approx(list(values.quantile(list(shares.values()))))
    whole = {r["Measure"]: r["c"] for r in rk.exact_quantiles(df, ["v", "w"], shares).collect()}
    assert whole == pytest.approx({c: pdf[c].median() for c in ("v", "w")})
    assert rk.exact_quantiles(df.where("g > 9"), ["v"], shares).count() == 0


def test_a_rank_outside_its_bracket_is_found_by_sorting(spark, monkeypatch):
    monkeypatch.setattr(rk, "FEW_ROWS", 10)
    wrong = F.array(F.lit(-1.0), F.lit(-1.0))
    monkeypatch.setattr(rk.F, "percentile_approx", lambda *_: F.max(wrong))
    df = spark.createDataFrame([(float(k),) for k in range(101)], "v double")
    assert rk.exact_quantiles(df, ["v"], {"m": 0.3}).first()["m"] == 30.0


def test_spearman(skewed):
    pdf, df = skewed
    want = pdf["Actual"].rank().corr(pdf["Predicted"].rank())
    found = me.spearman(df, "Actual", "Predicted", "Customer_ID").first()["Spearman"]
    assert found == pytest.approx(want)
    constant = df.withColumn("Predicted", F.lit(1.0))
    assert me.spearman(constant, "Actual", "Predicted", "Customer_ID").first()["Spearman"] is None


def test_roc_auc(skewed):
    pdf, df = skewed
    up, down = pdf.loc[pdf["Label"] == 1, "Predicted"].to_numpy(), pdf.loc[pdf["Label"] == 0, "Predicted"].to_numpy()
    wins = (up[:, None] > down[None]).mean() + 0.5 * (up[:, None] == down[None]).mean()
    assert me.roc_auc(df, "Label", "Predicted").first()["RocAuc"] == pytest.approx(wins)
    single = df.where("Label = 1")
    assert me.roc_auc(single, "Label", "Predicted").first()["RocAuc"] is None
    assert me.classification_metrics(single.withColumn("Decision", F.lit(0)), "Label", "Decision").first()["Precision"] is None


def numbered(spark, n):
    return spark.range(n).select(
        F.format_string("%05d", "id").alias("Customer_ID"), F.col("id").cast("double").alias("Actual"),
        F.col("id").cast("double").alias("Predicted"),
    )


def test_published_deciles_and_lift(spark):
    frame = di.residuals(numbered(spark, 556))
    table = di.calibration_by_predicted_decile(frame).orderBy("PredictedDecile").collect()
    assert [r["Count"] for r in table] == golden.DECILE_ROWS
    lift = di.lift_table(frame).orderBy("TopCustomer_Pct").collect()
    assert [r["CustomerCount"] for r in lift] == golden.LIFT_ROWS


def test_tiny_tables(spark):
    one = di.calibration_by_predicted_decile(di.residuals(numbered(spark, 1))).collect()
    assert [r["PredictedDecile"] for r in one] == [1]
    few = di.lift_table(numbered(spark, 3)).orderBy("TopCustomer_Pct").collect()
    assert [r["CustomerCount"] for r in few] == [0, 0, 0, 0, 1]


def test_zero_predictions_keep_their_scale(spark):
    frame = spark.createDataFrame([("1", 0.0, 0.0)], "Customer_ID string, Actual double, Predicted double")
    assert di.calibration_factor(frame).first()["Factor"] == 1.0
