"""Replay of published series results."""

from __future__ import annotations

import datetime

import golden
import pytest
from pyspark.sql import functions as F

from tillwise.functions.lineage import cut_lineage
from tillwise.operators import autoregression as ar
from tillwise.operators import metrics as me
from tillwise.operators import series as se
from tillwise.operators import smoothing as sm


@pytest.fixture(scope="module")
def parts(spark):
    first = datetime.date.fromisoformat(golden.FIRST_WEEK)
    rows = [
        (first + datetime.timedelta(weeks=i), v, 1, 1, v) for i, v in enumerate(golden.WEEKLY_REVENUE)
    ]
    series = spark.createDataFrame(
        rows, "Date date, Revenue double, OrderCount bigint, UniqueCustomers bigint, AvgOrderValue double"
    )
    marked = cut_lineage(se.holdout_rows(series, golden.HORIZON))
    return marked.where(F.col("Split") == "train"), marked.where(F.col("Split") == "test")


def error(parts, forecast):
    matched = se.match_actuals(forecast, parts[1])
    return me.forecast_metrics(matched).first()


def test_total_revenue():
    assert sum(golden.WEEKLY_REVENUE) == pytest.approx(17237799.867, abs=0.01)


def test_constant_models(parts):
    found = {r["Model"]: r["Forecast"] for r in se.baselines(parts[0], golden.HORIZON).where("Step = 1").collect()}
    assert found == pytest.approx(golden.FIRST_FORECAST, abs=1e-3)
    naive = error(parts, se.naive_forecast(parts[0], golden.HORIZON))
    assert naive["RMSE"] == pytest.approx(golden.NAIVE_RMSE, abs=0.01)
    assert naive["WAPE_Pct"] == pytest.approx(golden.NAIVE_WAPE, abs=0.01)


def test_autoregressive_fits(parts):
    train, test = parts
    one = ar.autoregressive_forecast(train, golden.HORIZON, 1, 1).withColumn("Model", F.lit("AR"))
    assert error(parts, one)["RMSE"] == pytest.approx(golden.AR_RMSE, rel=2e-3)
    best = ar.best_order(ar.seasonal_candidates(train, golden.HORIZON), test).first()
    assert best["Order"] == "(1,1,0)x(1,1,0,4)"
    assert best["RMSE"] == pytest.approx(golden.SEASONAL_RMSE, rel=1e-3)


@pytest.mark.parametrize(
    "name,fit",
    [
        ("SES", lambda t: sm.simple_smoothing(t, golden.HORIZON)),
        ("Holt", lambda t: sm.trend_smoothing(t, golden.HORIZON)),
        ("HoltWinters_s4", lambda t: sm.seasonal_smoothing(t, golden.HORIZON, 4)),
        ("HoltWinters_s13", lambda t: sm.seasonal_smoothing(t, golden.HORIZON, 13)),
    ],
)
def test_smoothing_fits(parts, name, fit):
    assert error(parts, fit(parts[0]))["RMSE"] == pytest.approx(golden.SMOOTHING_RMSE[name], rel=1e-3)


def test_forecast_cleaning(spark):
    rows = [("m", 1, 5.0), ("m", 2, float("inf")), ("m", 3, -4.0), ("m", 4, float("nan")), ("m", 5, 7.0)]
    frame = spark.createDataFrame(rows, "Model string, Step int, Forecast double")
    found = {r["Step"]: r["Forecast"] for r in se.clean_forecast(frame, 7).collect()}
    assert found == {1: 5.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 7.0, 6: 7.0, 7: 7.0}
    assert se.clean_forecast(frame, 2).count() == 2


def test_short_series_is_refused(spark, parts):
    with pytest.raises(ValueError):
        se.require_long_series(parts[1], golden.HORIZON)
    assert se.require_long_series(parts[0], golden.HORIZON) is parts[0]


def test_all_zero_actuals(spark):
    frame = spark.createDataFrame([("m", 0.0, 3.0), ("m", 0.0, 0.0)], "Model string, Actual double, Forecast double")
    row = me.forecast_metrics(frame).first()
    assert row["WAPE_Pct"] is None and row["RevenueError_Pct"] is None and row["R2"] is None
    assert row["sMAPE_Pct"] == pytest.approx(200.0)
