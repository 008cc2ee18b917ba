"""Tree models on lag features, the recursive forecast, and the choice of the best model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.joins import join_on
from tillwise.functions.lineage import cut_lineage
from tillwise.operators import autoregression as ar
from tillwise.operators import moving_average as ma
from tillwise.operators import smoothing as sm
from tillwise.operators.metrics import forecast_metrics
from tillwise.operators.series import (
    OTHER_LAGS,
    OTHERS,
    REVENUE_LAGS,
    ROLLING,
    back_transform,
    baselines,
    calendar_parts,
    future_dates,
    holdout_rows,
    lag_features,
    lag_names,
    match_actuals,
    per_series,
    require_long_series,
    split_by_length,
)

#: Rows that one task of a fit takes: many rounds over few rows are few tasks.
ROWS_PER_TASK = 50_000

MODELS = {
    "RandomForest_Lag": lambda: RandomForestRegressor(
        featuresCol="vector", labelCol="LogRevenue", numTrees=500, maxDepth=5,
        minInstancesPerNode=3, seed=42,
    ),
    "Boosted_Lag": lambda: GBTRegressor(
        featuresCol="vector", labelCol="LogRevenue", maxIter=300, maxDepth=2, stepSize=0.03,
        subsamplingRate=0.8, seed=42,
    ),
}


def assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=lag_names(), outputCol="vector")


def fit_lag_model(lagged: DataFrame, model: str) -> PipelineModel:
    """One model over the lag rows of all series, on log revenue."""
    rows = assembler().transform(lagged).select("vector", F.log1p("Revenue").alias("LogRevenue"))
    rows = cut_lineage(rows)
    fitted = MODELS[model]().fit(rows.coalesce(max(1, -(-rows.count() // ROWS_PER_TASK))))
    return PipelineModel([assembler(), fitted])


def lag_model_forecast(series: DataFrame, horizon: int, model: str, by: Sequence[str] = ()) -> DataFrame:
    """Train on the lag rows before the test weeks, predict the test weeks one step ahead."""
    marked = holdout_rows(series, horizon, by).select(*by, "Date", "Split")
    lagged = join_on(lag_features(series, by), marked, [*by, "Date"])
    fitted = fit_lag_model(lagged.where(F.col("Split") == "train"), model)
    test = fitted.transform(lagged.where(F.col("Split") == "test"))
    return test.select(
        *by,
        F.lit(model).alias("Model"),
        "Date",
        F.col("Revenue").alias("Actual"),
        back_transform(F.col("prediction")).alias("Forecast"),
    )


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values)


def _std(values: Column) -> Column:
    centre = _mean(values)
    squares = F.aggregate(F.transform(values, lambda v: F.pow(v - centre, F.lit(2.0))), F.lit(0.0), lambda s, v: s + v)
    return F.sqrt(squares / F.nullif(F.size(values) - 1, F.lit(0)))


def _field(name: str):
    return lambda row: row[name].cast("double")


def recursive_forecast(series: DataFrame, fitted: PipelineModel, horizon: int, by: Sequence[str] = ()) -> DataFrame:
    """Forecast step by step, each forecast feeding the lags of the next.

    The state is one row per series with its last values; all series advance together, in
    one plan, and no row comes to the driver.
    """
    recent = {"Revenue": max(*REVENUE_LAGS, *ROLLING), **{c: max(OTHER_LAGS) for c in OTHERS}}
    rows = F.array_sort(F.collect_list(F.struct("Date", "Revenue", *OTHERS)))
    state = series.groupBy(*by).agg(
        F.count(F.lit(1)).cast("int").alias("TimeIndex"), F.max("Date").alias("Date"), rows.alias("_rows")
    )
    state = state.select(
        *by,
        "TimeIndex",
        "Date",
        *[
            F.transform(
                F.slice("_rows", F.greatest(F.size("_rows") - k + 1, F.lit(1)), k),
                _field(c),
            ).alias(f"_{c}")
            for c, k in recent.items()
        ],
    )
    whole = None
    for step in range(1, horizon + 1):
        nxt = calendar_parts(state.withColumn("Date", F.date_add("Date", 7)))

        def back(name: str, k: int) -> Column:
            values = F.col(f"_{name}")
            return F.coalesce(F.when(F.size(values) >= k, F.try_element_at(values, F.lit(-k))), F.lit(0.0))

        def tail(name: str, k: int) -> Column:
            values = F.col(f"_{name}")
            return F.slice(values, F.greatest(F.size(values) - k + 1, F.lit(1)), k)

        added = {f"Revenue_Lag_{k}": back("Revenue", k) for k in REVENUE_LAGS}
        for k in ROLLING:
            added[f"Revenue_RollingMean_{k}"] = _mean(tail("Revenue", k))
            added[f"Revenue_RollingStd_{k}"] = F.coalesce(_std(tail("Revenue", k)), F.lit(0.0))
        for k in OTHER_LAGS:
            added.update({f"{c}_Lag_{k}": back(c, k) for c in OTHERS})
        predicted = fitted.transform(nxt.withColumns(added)).withColumns(
            {
                "Revenue": back_transform(F.col("prediction")),
                "OrderCount": _mean(tail("OrderCount", 4)),
                "UniqueCustomers": _mean(tail("UniqueCustomers", 4)),
            }
        )
        orders = F.col("OrderCount")
        predicted = predicted.withColumn(
            "AvgOrderValue",
            F.when(orders > 0, F.col("Revenue") / F.nullif(orders, F.lit(0.0))).otherwise(0.0),
        )
        state = cut_lineage(
            predicted.select(
                *by,
                (F.col("TimeIndex") + 1).alias("TimeIndex"),
                "Date",
                *[
                    F.slice(
                        F.concat(F.col(f"_{c}"), F.array(F.col(c))),
                        F.greatest(F.size(f"_{c}") + 2 - k, F.lit(1)),
                        k,
                    ).alias(f"_{c}")
                    for c, k in recent.items()
                ],
            )
        )
        row = state.select(
            *by,
            F.lit(step).alias("Step"),
            "Date",
            *[F.element_at(F.col(f"_{c}"), -1).alias(c) for c in recent],
        )
        whole = row if whole is None else whole.unionByName(row)
    return whole


def fitted_forecasts(
    train: DataFrame,
    horizon: int,
    orders: dict[str, DataFrame],
    by: Sequence[str] = (),
    wanted: set[str] | None = None,
) -> DataFrame:
    """Baselines, smoothing and autoregressive models on the same training rows.

    ``orders`` holds the chosen order per series of the two autoregressive models; models
    that are not ``wanted`` are not fitted.
    """
    columns = [*by, "Model", "Step", "Forecast"]
    fits = {
        "SES": lambda: sm.simple_smoothing(train, horizon, by),
        "Holt": lambda: sm.trend_smoothing(train, horizon, by),
        "HoltWinters_s4": lambda: sm.seasonal_smoothing(train, horizon, 4, by),
        "HoltWinters_s13": lambda: sm.seasonal_smoothing(train, horizon, 13, by),
        "AR": lambda: ar.keep_order(
            ar.autoregressive_candidates(train, horizon, by), orders["AR"], "AR", by
        ),
        "SeasonalAR": lambda: ar.keep_order(
            ar.seasonal_candidates(train, horizon, by), orders["SeasonalAR"], "SeasonalAR", by
        ),
        "ARIMA": lambda: ar.keep_order(ma.forecasts(train, horizon, ma.ORDERS, by), orders["ARIMA"], "ARIMA", by),
        "SARIMA": lambda: ar.keep_order(
            ma.forecasts(train, horizon, ma.SEASONAL_ORDERS, by), orders["SARIMA"], "SARIMA", by
        ),
    }
    whole = baselines(train, horizon, by).select(*columns)
    for name, fit in fits.items():
        if wanted is None or name in wanted:
            whole = whole.unionByName(fit().select(*columns))
    return whole


def choose_orders(train: DataFrame, test: DataFrame, horizon: int, by: Sequence[str] = ()) -> dict[str, DataFrame]:
    return {
        "AR": cut_lineage(ar.best_order(ar.autoregressive_candidates(train, horizon, by), test, by)),
        "SeasonalAR": cut_lineage(ar.best_order(ar.seasonal_candidates(train, horizon, by), test, by)),
        "ARIMA": cut_lineage(ar.best_order(ma.forecasts(train, horizon, ma.ORDERS, by), test, by)),
        "SARIMA": cut_lineage(ar.best_order(ma.forecasts(train, horizon, ma.SEASONAL_ORDERS, by), test, by)),
    }


def evaluate_models(series: DataFrame, horizon: int, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, dict]:
    """All models on the holdout: matched rows, metric rows, chosen orders.

    A single series that is too short is an error; of several, those that are too short are left
    out (``split_by_length`` lists them).
    """
    series = split_by_length(series, horizon, by)[0] if by else require_long_series(series, horizon)
    parts = cut_lineage(holdout_rows(series, horizon, by))
    train, test = parts.where(F.col("Split") == "train"), parts.where(F.col("Split") == "test")
    orders = choose_orders(train, test, horizon, by)
    columns = [*by, "Model", "Date", "Actual", "Forecast"]
    matched = match_actuals(fitted_forecasts(train, horizon, orders, by), test, by).select(*columns)
    for model in MODELS:
        matched = matched.unionByName(lag_model_forecast(parts.drop("Split"), horizon, model, by).select(*columns))
    matched = cut_lineage(matched)
    return matched, forecast_metrics(matched, [*by, "Model"]), orders


def best_model(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return metrics.groupBy(*by).agg(F.min_by("Model", F.struct("RMSE", "Model")).alias("Model"))


def future_forecast(series: DataFrame, horizon: int, by: Sequence[str] = ()) -> DataFrame:
    """Weeks past the end of each series by its best model, refitted on all rows."""
    rows = cut_lineage(series)
    _, metrics, orders = evaluate_models(rows, horizon, by)
    best = cut_lineage(best_model(metrics, by))
    columns = [*by, "Model", "Date", "Step", "Forecast"]
    wanted = {row["Model"] for row in best.select("Model").distinct().collect()}
    dated = future_dates(fitted_forecasts(rows, horizon, orders, by, wanted), rows, by).select(*columns)
    lagged = lag_features(rows, by)
    for model in MODELS:
        if model not in wanted:
            continue
        ahead = recursive_forecast(rows, fit_lag_model(lagged, model), horizon, by)
        dated = dated.unionByName(
            ahead.select(*by, F.lit(model).alias("Model"), "Date", "Step", F.col("Revenue").alias("Forecast"))
        )
    return join_on(dated, best, [*by, "Model"]).select(
        *by, "Model", "Date", "Step", F.col("Forecast").alias("ForecastRevenue")
    )


def rolling_origin_rows(series: DataFrame, horizon: int, folds: int, by: Sequence[str] = ()) -> DataFrame:
    """The series once per earlier cut-off, with ``Fold`` as one more key: fold f ends f horizons earlier."""
    back = F.row_number().over(per_series(by).orderBy(F.desc("Date")))
    cuts = F.filter(F.sequence(F.lit(1), F.lit(folds)), lambda f: F.col("_back") > f * horizon)
    return series.withColumn("_back", back).withColumn("Fold", F.explode(cuts)).drop("_back")


def rolling_model_errors(series: DataFrame, horizon: int, folds: int, by: Sequence[str] = ()) -> DataFrame:
    """RMSE per series, fold and model over earlier cut-offs; all folds are fitted in one plan.

    Baselines, smoothing, autoregressive and moving-average models take part; orders are chosen within a fold. Series
    that are too short in a fold are left out of it, see ``split_by_length``.
    """
    keys = [*by, "Fold"]
    kept, _ = split_by_length(rolling_origin_rows(series, horizon, folds, by), horizon, keys)
    parts = cut_lineage(holdout_rows(kept, horizon, keys))
    train, test = parts.where(F.col("Split") == "train"), parts.where(F.col("Split") == "test")
    orders = choose_orders(train, test, horizon, keys)
    matched = match_actuals(fitted_forecasts(train, horizon, orders, keys), test, keys)
    return forecast_metrics(cut_lineage(matched), [*keys, "Model"]).select(*keys, "Model", "RMSE")


def rolling_origin_error(series: DataFrame, horizon: int, folds: int, by: Sequence[str] = ()) -> DataFrame:
    """Error of the cheap models over earlier cut-offs, so that no test week steers the choice."""
    rows = cut_lineage(holdout_rows(series, horizon, by)).where(F.col("Split") == "train").drop("Split")
    whole = None
    for _ in range(folds):
        rows = cut_lineage(holdout_rows(rows, horizon, by))
        train, test = rows.where(F.col("Split") == "train"), rows.where(F.col("Split") == "test")
        fold = match_actuals(baselines(train, horizon, by), test, by)
        whole = fold if whole is None else whole.unionByName(fold)
        rows = train.drop("Split")
    return forecast_metrics(whole, [*by, "Model"]).select(*by, "Model", F.col("RMSE").alias("RollingRMSE"))
