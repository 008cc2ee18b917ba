"""Revenue series per week and month, baselines, lag features and decomposition.

Every function takes the columns that identify a series in ``by`` (none: one series). The
rows of one series are calendar weeks or months, so a window per series stays small however
many invoice lines there are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwise.functions.columns import from_money, money, ratio
from tillwise.functions.joins import join_on

REVENUE_LAGS = (1, 2, 4, 8, 12)
ROLLING = (4, 8, 12)
OTHER_LAGS = (1, 4)
OTHERS = ("OrderCount", "UniqueCustomers", "AvgOrderValue")


def per_series(by: Sequence[str]) -> W:
    return W.partitionBy(*(by or [F.lit(0)]))


def week_label(when: str = "InvoiceDate") -> Column:
    """The Sunday that ends the week."""
    return F.date_add(F.trunc(F.to_date(when), "week"), 6)


def month_label(when: str = "InvoiceDate") -> Column:
    return F.trunc(F.to_date(when), "month")


def _series(purchases: DataFrame, label: Column, by: Sequence[str], before: Callable, step: str) -> DataFrame:
    """Sums per calendar step. A gap before the next row is filled from the row ahead of it,
    so the lines are read once and nothing is joined."""
    invoices = purchases.groupBy(*by, label.alias("Date"), "Customer_ID", "Invoice").agg(
        F.sum(money(F.col("TransactionValue"))).alias("Value")
    )
    found = invoices.groupBy(*by, "Date").agg(
        from_money(F.sum("Value")).alias("Revenue"),
        F.countDistinct("Invoice").alias("OrderCount"),
        F.countDistinct("Customer_ID").alias("UniqueCustomers"),
    )
    following = F.lead("Date").over(per_series(by).orderBy("Date"))
    until = found.withColumn("_until", F.coalesce(before(following), F.col("Date")))
    filled = until.withColumn("_day", F.explode(F.expr(f"sequence(Date, _until, interval {step})")))
    sold = F.col("_day") == F.col("Date")
    return filled.select(
        *by,
        F.col("_day").alias("Date"),
        F.when(sold, F.col("Revenue")).otherwise(0.0).alias("Revenue"),
        F.when(sold, F.col("OrderCount")).otherwise(0).alias("OrderCount"),
        F.when(sold, F.col("UniqueCustomers")).otherwise(0).alias("UniqueCustomers"),
        F.when(sold, F.coalesce(ratio(F.col("Revenue"), F.col("OrderCount")), F.lit(0.0)))
        .otherwise(0.0)
        .alias("AvgOrderValue"),
    )


def weekly_series(purchases: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per week from the first to the last sale; weeks without a sale hold zeros."""
    return _series(purchases, week_label(), list(by), lambda day: F.date_sub(day, 7), "7 days")


def monthly_series(purchases: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _series(purchases, month_label(), list(by), lambda day: F.add_months(day, -1), "1 month")


def holdout_rows(series: DataFrame, horizon: int, by: Sequence[str] = ()) -> DataFrame:
    """Mark the last ``horizon`` rows of each series as test."""
    back = F.row_number().over(per_series(by).orderBy(F.col("Date").desc()))
    return series.withColumn("Split", F.when(back <= horizon, "test").otherwise("train"))


def long_enough(series: DataFrame, horizon: int, by: Sequence[str] = ()) -> DataFrame:
    """Per series: rows, and whether there are more than horizon + 20 of them."""
    counts = series.groupBy(*by).agg(F.count(F.lit(1)).alias("Rows"))
    return counts.withColumn("LongEnough", F.col("Rows") > horizon + 20)



def split_by_length(
    series: DataFrame, horizon: int, by: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """The series that are long enough for a forecast, and one row per series that is not.

    A rejected row has the keys, its ``Rows`` and the ``RowsNeeded``.
    """
    size = F.count(F.lit(1)).over(per_series(by))
    kept = series.withColumn("_rows", size).where(F.col("_rows") > horizon + 20).drop("_rows")
    rejected = (
        long_enough(series, horizon, by)
        .where(~F.col("LongEnough"))
        .select(*by, "Rows", F.lit(horizon + 21).cast("bigint").alias("RowsNeeded"))
    )
    return kept, rejected


def require_long_series(series: DataFrame, horizon: int, by: Sequence[str] = ()) -> DataFrame:
    """Raise when a series is too short; one row comes to the driver."""
    if not split_by_length(series, horizon, by)[1].isEmpty():
        raise ValueError(f"a series has no more than {horizon + 20} rows")
    return series


def steps(horizon: int) -> Column:
    return F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("Step")


def naive_forecast(train: DataFrame, horizon: int, by: Sequence[str] = ()) -> DataFrame:
    last = train.groupBy(*by).agg(F.max_by("Revenue", "Date").alias("Forecast"))
    return last.select(*by, F.lit("Naive").alias("Model"), steps(horizon), "Forecast")


def moving_average_forecast(
    train: DataFrame, horizon: int, window: int, by: Sequence[str] = ()
) -> DataFrame:
    back = F.row_number().over(per_series(by).orderBy(F.col("Date").desc()))
    mean = (
        train.withColumn("_back", back)
        .where(F.col("_back") <= window)
        .groupBy(*by)
        .agg(F.avg("Revenue").alias("Forecast"))
    )
    return mean.select(
        *by, F.lit(f"MovingAverage_{window}").alias("Model"), steps(horizon), "Forecast"
    )


def baselines(train: DataFrame, horizon: int, by: Sequence[str] = ()) -> DataFrame:
    frame = naive_forecast(train, horizon, by)
    for window in ROLLING:
        frame = frame.unionByName(moving_average_forecast(train, horizon, window, by))
    return frame


def clean_value(value: Column) -> Column:
    """Undefined and infinite forecasts become 0, negative ones too."""
    number = value.cast("double")
    bad = number.isNull() | F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
    return F.when(bad, 0.0).otherwise(F.greatest(number, F.lit(0.0)))


def clean_forecast(forecast: DataFrame, horizon: int, by: Sequence[str] = ()) -> DataFrame:
    """Cleaned values, cut to the horizon and padded with the last value when too short."""
    keys = [*by, "Model"]
    cleaned = forecast.where(F.col("Step") <= horizon).withColumn(
        "Forecast", clean_value(F.col("Forecast"))
    )
    grid = forecast.select(*keys).distinct().select(*keys, steps(horizon))
    order = W.partitionBy(*keys).orderBy("Step").rowsBetween(W.unboundedPreceding, 0)
    last = F.last("Forecast", ignorenulls=True).over(order)
    return (
        join_on(grid, cleaned.select(*keys, "Step", "Forecast"), [*keys, "Step"], "left")
        .withColumn("Forecast", F.coalesce(last, F.lit(0.0)))
    )


def back_transform(log_value: Column) -> Column:
    return clean_value(F.expm1(log_value))


def match_actuals(forecast: DataFrame, test: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Forecast steps next to the dates and revenue of the test rows."""
    numbered = test.select(
        *by,
        F.row_number().over(per_series(by).orderBy("Date")).alias("Step"),
        "Date",
        F.col("Revenue").alias("Actual"),
    )
    return join_on(forecast, numbered, [*by, "Step"]).select(
        *by, "Model", "Step", "Date", "Actual", "Forecast"
    )


def future_dates(forecast: DataFrame, series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Date the steps of a forecast past the last week of each series."""
    last = series.groupBy(*by).agg(F.max("Date").alias("_last"))
    joined = join_on(forecast, last, by) if by else forecast.join(F.broadcast(last))
    return joined.withColumn("Date", F.date_add("_last", F.col("Step") * 7)).drop("_last")


def calendar_parts(frame: DataFrame) -> DataFrame:
    return frame.withColumns(
        {
            "Month": F.month("Date"),
            "Quarter": F.quarter("Date"),
            "WeekOfYear": F.weekofyear("Date"),
        }
    )


def lag_names() -> list[str]:
    names = ["TimeIndex", "Month", "Quarter", "WeekOfYear"]
    names += [f"Revenue_Lag_{k}" for k in REVENUE_LAGS]
    for k in ROLLING:
        names += [f"Revenue_RollingMean_{k}", f"Revenue_RollingStd_{k}"]
    return names + [f"{c}_Lag_{k}" for k in OTHER_LAGS for c in OTHERS]


def lag_features(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Calendar parts, lags and rolling moments of the previous rows; incomplete rows dropped."""
    order = per_series(by).orderBy("Date")
    added: dict[str, Column] = {
        "TimeIndex": (F.row_number().over(order) - 1),
    }
    for k in REVENUE_LAGS:
        added[f"Revenue_Lag_{k}"] = F.lag("Revenue", k).over(order)
    for k in ROLLING:
        past = order.rowsBetween(-k, -1)
        full = F.count("Revenue").over(past) == k
        added[f"Revenue_RollingMean_{k}"] = F.when(full, F.avg("Revenue").over(past))
        added[f"Revenue_RollingStd_{k}"] = F.when(full, F.stddev_samp("Revenue").over(past))
    for k in OTHER_LAGS:
        for c in OTHERS:
            added[f"{c}_Lag_{k}"] = F.lag(c, k).over(order)
    return calendar_parts(series).withColumns(added).dropna(subset=lag_names())


def decompose(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Additive trend, seasonal and residual parts.

    The period is 52 for two years of weeks or more, 13 from 26 weeks on; shorter series are
    left out. The trend is the centred moving average, the seasonal part the mean deviation
    per phase, shifted to average zero.
    """
    order = per_series(by).orderBy("Date")
    numbered = series.select(
        *by,
        "Date",
        "Revenue",
        (F.row_number().over(order) - 1).alias("_t"),
        F.count(F.lit(1)).over(per_series(by)).alias("_n"),
    ).withColumn("Period", F.when(F.col("_n") >= 104, 52).when(F.col("_n") >= 26, 13))

    def centred(first: int, last: int) -> Column:
        frame = order.rowsBetween(first, last)
        whole = F.count("Revenue").over(frame) == last - first + 1
        return F.when(whole, F.avg("Revenue").over(frame))

    trend = F.when(
        F.col("Period") == 52, (centred(-26, 25) + centred(-25, 26)) / F.lit(2.0)
    ).when(F.col("Period") == 13, centred(-6, 6))
    parts = (
        numbered.where(F.col("Period").isNotNull())
        .withColumn("Trend", trend)
        .withColumn("_phase", F.pmod(F.col("_t"), F.col("Period")))
    )
    phase = W.partitionBy(*by, "_phase")
    means = parts.withColumn("_mean", F.avg(F.col("Revenue") - F.col("Trend")).over(phase))
    first_cycle = F.when(F.col("_t") < F.col("Period"), F.col("_mean"))
    centre = F.avg(first_cycle).over(per_series(by))
    return means.withColumn("Seasonal", F.col("_mean") - centre).select(
        *by,
        "Date",
        "Revenue",
        "Period",
        "Trend",
        "Seasonal",
        (F.col("Revenue") - F.col("Trend") - F.col("Seasonal")).alias("Residual"),
    )


def forecast_residuals(matched: DataFrame, best: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Actual minus forecast of the best model, finite values only."""
    keys = [*by, "Model"]
    rows = join_on(matched, F.broadcast(best.select(*keys)) if not by else best.select(*keys), keys)
    residual = F.col("Actual") - F.col("Forecast")
    finite = ~F.isnan(residual) & (F.abs(residual) < F.lit(float("inf")))
    return rows.withColumn("Residual", residual).where(residual.isNotNull() & finite)


def series_summary(
    weekly: DataFrame, monthly: DataFrame, horizon: int, by: Sequence[str] = ()
) -> DataFrame:
    """Train and test spans, counts, totals and the latest values."""
    parts = holdout_rows(weekly, horizon, by)
    train, test = F.col("Split") == "train", F.col("Split") == "test"
    weeks = parts.groupBy(*by).agg(
        F.min(F.when(train, F.col("Date"))).alias("TrainStart"),
        F.max(F.when(train, F.col("Date"))).alias("TrainEnd"),
        F.min(F.when(test, F.col("Date"))).alias("TestStart"),
        F.max(F.when(test, F.col("Date"))).alias("TestEnd"),
        F.count(F.lit(1)).alias("WeeklyObservations"),
        F.sum("Revenue").alias("TotalHistoricalRevenue"),
        F.avg("Revenue").alias("AverageWeeklyRevenue"),
        F.max_by("Revenue", "Date").alias("LatestWeeklyRevenue"),
    )
    months = monthly.groupBy(*by).agg(
        F.count(F.lit(1)).alias("MonthlyObservations"),
        F.max_by("Revenue", "Date").alias("LatestMonthlyRevenue"),
    )
    return join_on(weeks, months, by) if by else weeks.join(F.broadcast(months))
