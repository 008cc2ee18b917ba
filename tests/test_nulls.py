"""Null keys, flags and labels lose no rows; tables are read as they are now."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tillwise.functions.joins import join_on
from tillwise.functions.ranking import exact_quantiles, row_positions
from tillwise.operators import series as se
from tillwise.operators import viewer as vi
from tillwise.operators.autoregression import autoregressive_forecast
from tillwise.operators.cleaning import clean_lines, genuine_purchases
from tillwise.operators.models import LABEL, train_rows
from tillwise.operators.preparation import split_rows
from tillwise.operators.smoothing import simple_smoothing
from tillwise.sources.readers import RAW_LINE, read_table


def test_rows_of_a_null_group_stay(spark):
    rows = spark.createDataFrame([(k, None if k % 3 == 0 else k % 3, float(k)) for k in range(12)], "id long, L int, v double")
    assert split_rows(rows, 0.5, ["L"], "id").count() == 12
    assert split_rows(rows, 0.5, ["L"], "id").where("L is null").select("Split").distinct().count() == 2
    placed = row_positions(rows, [F.col("id")], by=["L"])
    assert sorted(r["Position"] for r in placed.where("L is null").collect()) == [1, 2, 3, 4]
    middle = {r["L"]: r["median"] for r in exact_quantiles(rows, ["v"], {"median": 0.5}, by=["L"]).collect()}
    assert middle == {None: 4.5, 1: 5.5, 2: 6.5}
    joined = join_on(rows, rows.groupBy("L").count(), ["L"])
    assert joined.count() == 12 and joined.columns == ["id", "L", "v", "count"]


def weekly(spark):
    start = dt.date(2020, 1, 6)
    rows = [
        (country, start + dt.timedelta(weeks=k), 100.0 + 7 * k % 13, 3, 2, 30.0)
        for country, weeks in (("A", 40), (None, 40), ("short", 5))
        for k in range(weeks)
    ]
    return spark.createDataFrame(
        rows, "Country string, Date date, Revenue double, OrderCount long, UniqueCustomers long, AvgOrderValue double"
    )


def test_a_series_without_a_name_is_forecast(spark):
    series, by = weekly(spark), ["Country"]
    parts = se.holdout_rows(series, 4, by)
    train, test = (parts.where(F.col("Split") == name) for name in ("train", "test"))
    for forecast in (se.naive_forecast(train, 4, by), autoregressive_forecast(train, 4, 1, 1, by).withColumn("Model", F.lit("AR"))):
        matched = se.match_actuals(forecast, test, by)
        assert matched.where("Country is null").count() == 4
        dated = se.future_dates(forecast, series, by)
        assert dated.where("Country is null").count() == 4
    assert simple_smoothing(train, 4, by).where("Country is null").count() == 4
    cleaned = se.clean_forecast(se.naive_forecast(train, 4, by), 6, by)
    assert cleaned.where("Country is null").count() == 6


def test_short_series_are_reported(spark):
    kept, rejected = se.split_by_length(weekly(spark), 4, ["Country"])
    assert {r["Country"] for r in kept.select("Country").distinct().collect()} == {"A", None}
    assert [tuple(r) for r in rejected.collect()] == [("short", 5, 25)]


def test_missing_codes_and_quantities_carry_no_flag(spark):
    day = dt.datetime(2020, 1, 1)
    rows = [
        ("1", None, "a", 1, day, 2.0, 5.0, "france"),
        ("1", "P1", "a", None, day, 2.0, 5.0, None),
        (None, "P1", "a", 1, day, 2.0, 5.0, "france"),
        ("C1", "P1", "a", 1, day, 2.0, 5.0, "france"),
        ("2", "POST", "a", 1, day, 2.0, 5.0, "france"),
        ("3", "P1", "a", -1, day, 2.0, 5.0, "france"),
    ]
    clean = clean_lines(spark.createDataFrame(rows, RAW_LINE))
    assert clean.where("IsCancelled is null or IsReturn is null or IsNonProduct is null").count() == 0
    assert clean.count() == 6 and genuine_purchases(clean).count() == 3


def test_unlabelled_rows_are_not_fitted_on(spark):
    rows = spark.createDataFrame([("train", 1), ("train", None), ("test", None)], f"Split string, {LABEL} int")
    assert train_rows(rows).count() == 1


def test_a_rewritten_table_shows_its_new_column(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(path)
    assert read_table(spark, str(tmp_path), "t").columns == ["id"]
    spark.range(3).withColumn("more", F.lit(1)).write.mode("overwrite").parquet(path)
    assert read_table(spark, str(tmp_path), "t").columns == ["id", "more"]


def test_only_finite_decimal_numbers_are_numbers(spark):
    texts = ["12", " 3.5 ", "-1e3", ".5", "7.", "85123D", "84997F", "NaN", "Infinity", "1e999", "", " ", None, "0x1F", "1_000"]
    rows = spark.createDataFrame([(t,) for t in texts], "code string")
    assert [r["code"] for r in vi.rows_with_numbers(rows, ["code"]).collect()] == [12.0, 3.5, -1000.0, 0.5, 7.0]
    kind = vi.column_kinds(rows).first()
    assert (kind["NumericRows"], kind["TextRows"], kind["IsNumeric"], kind["IsText"]) == (5, 7, True, True)
