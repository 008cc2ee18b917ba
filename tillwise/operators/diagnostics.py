"""Residuals, deciles, lift and calibration of a spend model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.columns import ratio
from tillwise.functions.lineage import cut_lineage
from tillwise.functions.ranking import exact_quantiles, row_positions
from tillwise.operators.cleaning import describe

LIFT_SHARES = (0.05, 0.10, 0.20, 0.30, 0.50)


def clip_at_zero(prediction: Column) -> Column:
    return F.greatest(prediction.cast("double"), F.lit(0.0))


def calibration_factor(scored: DataFrame) -> DataFrame:
    """One row: total actual over total predicted; 1 when nothing is predicted."""
    return scored.agg(
        F.coalesce(ratio(F.sum("Actual"), F.sum("Predicted")), F.lit(1.0)).alias("Factor")
    )


def calibrate(scored: DataFrame, factor: DataFrame) -> DataFrame:
    return (
        scored.join(F.broadcast(factor))
        .withColumn("Predicted", clip_at_zero(F.col("Predicted") * F.col("Factor")))
        .drop("Factor")
    )


def smearing_factor(scored_logs: DataFrame) -> DataFrame:
    """One row: the mean of exp(actual log - predicted log) over the training rows."""
    return scored_logs.agg(F.avg(F.exp(F.col("LogActual") - F.col("LogPredicted"))).alias("Smearing"))


def smear(scored_logs: DataFrame, factor: DataFrame) -> DataFrame:
    """Back from the log scale with the retransformation factor, next to the plain way."""
    return (
        scored_logs.join(F.broadcast(factor))
        .withColumn("Predicted", clip_at_zero(F.exp("LogPredicted") * F.col("Smearing") - 1))
        .withColumn("PredictedPlain", clip_at_zero(F.expm1("LogPredicted")))
        .drop("Smearing")
    )


def residuals(scored: DataFrame) -> DataFrame:
    frame = scored.withColumn("Predicted", clip_at_zero(F.col("Predicted")))
    error = F.col("Actual") - F.col("Predicted")
    return frame.withColumns(
        {
            "Residual": error,
            "AbsResidual": F.abs(error),
            "LogActual": F.log1p("Actual"),
            "LogPredicted": F.log1p("Predicted"),
            "LogResidual": F.log1p("Actual") - F.log1p("Predicted"),
            "ActualZeroFlag": (F.col("Actual") == 0).cast("int"),
        }
    )


def residual_summary(frame: DataFrame) -> DataFrame:
    return describe(frame, ["Actual", "Predicted", "Residual", "AbsResidual", "LogResidual"])


def largest_misses(frame: DataFrame, rows: int = 10) -> DataFrame:
    """The most under- and the most over-predicted customers."""
    under = frame.orderBy(F.col("Residual").desc(), "Customer_ID").limit(rows)
    over = frame.orderBy(F.col("Residual").asc(), "Customer_ID").limit(rows)
    return under.withColumn("Side", F.lit("under")).unionByName(
        over.withColumn("Side", F.lit("over"))
    )


def decile_of(position: Column, size: Column) -> Column:
    """Equal-frequency decile of a 1-based position, edges where a quantile cut puts them."""
    inner = F.floor(((position - 1) * 10 + size - 2) / F.nullif(size - 1, F.lit(0)))
    return F.when(size <= 1, F.lit(1)).otherwise(F.greatest(F.lit(1), inner)).cast("int")


def with_deciles(frame: DataFrame, value: str, name: str, identifier: str = "Customer_ID") -> DataFrame:
    """Deciles over the whole table, ties in the order of the id."""
    placed = row_positions(frame, [F.col(value), F.col(identifier)], name="_position")
    size = frame.agg(F.count(F.lit(1)).alias("_size"))
    return (
        placed.join(F.broadcast(size))
        .withColumn(name, decile_of(F.col("_position"), F.col("_size")))
        .drop("_position", "_size")
    )


def _decile_sums(frame: DataFrame, name: str, *more: Column) -> DataFrame:
    actual, predicted = F.sum("Actual"), F.sum("Predicted")
    return frame.groupBy(name).agg(
        F.count(F.lit(1)).alias("Count"),
        F.avg("Actual").alias("MeanActual"),
        F.avg("Predicted").alias("MeanPredicted"),
        actual.alias("ActualRevenue"),
        predicted.alias("PredictedRevenue"),
        *more,
        (ratio(F.abs(actual - predicted), actual) * 100).alias("RevenueError_Pct"),
    )


def error_by_actual_decile(frame: DataFrame) -> DataFrame:
    rows = cut_lineage(with_deciles(frame, "Actual", "ActualDecile"))
    sums = _decile_sums(rows, "ActualDecile", F.avg("AbsResidual").alias("MAE"))
    middle = exact_quantiles(rows, ["AbsResidual"], {"MedianAE": 0.5}, ["ActualDecile"])
    return sums.join(middle.select("ActualDecile", "MedianAE"), "ActualDecile")


def calibration_by_predicted_decile(frame: DataFrame) -> DataFrame:
    return _decile_sums(with_deciles(frame, "Predicted", "PredictedDecile"), "PredictedDecile")


def lift_table(frame: DataFrame, shares: Sequence[float] = LIFT_SHARES) -> DataFrame:
    """Revenue caught by the customers with the highest predictions, one pass for all shares."""
    placed = row_positions(frame, [F.col("Predicted").desc(), F.col("Customer_ID")], name="_position")
    size = frame.agg(F.count(F.lit(1)).alias("_size"))
    rows = placed.join(F.broadcast(size))
    taken = {i: F.floor(F.col("_size") * F.lit(float(p))) for i, p in enumerate(shares)}
    sums = rows.agg(
        F.sum("Actual").alias("_total"),
        *[F.max(taken[i]).alias(f"_n{i}") for i in taken],
        *[
            F.coalesce(F.sum(F.when(F.col("_position") <= taken[i], F.col("Actual"))), F.lit(0.0)).alias(f"_r{i}")
            for i in taken
        ],
    )
    lines = [
        F.struct(
            F.lit(float(round(p * 100, 10))).alias("TopCustomer_Pct"),
            F.col(f"_n{i}").alias("CustomerCount"),
            F.col(f"_r{i}").alias("ActualRevenueCaptured"),
        )
        for i, p in enumerate(shares)
    ]
    capture = ratio(F.col("ActualRevenueCaptured"), F.col("_total")) * 100
    return sums.select("_total", F.inline(F.array(*lines))).select(
        "TopCustomer_Pct",
        "CustomerCount",
        "ActualRevenueCaptured",
        capture.alias("RevenueCapture_Pct"),
        (capture / F.col("TopCustomer_Pct")).alias("LiftVsRandom"),
    )


def zero_spenders(frame: DataFrame) -> DataFrame:
    return frame.where(F.col("Actual") == 0)


def zero_spender_summary(frame: DataFrame) -> DataFrame:
    """Predictions given to customers who then spent nothing."""
    zero = F.col("Actual") == 0
    given = F.coalesce(F.sum(F.when(zero, F.col("Predicted"))), F.lit(0.0))
    sums = frame.agg(
        F.count_if(zero).alias("ZeroSpenders"),
        F.avg(F.when(zero, F.col("Predicted"))).alias("MeanPredicted"),
        given.alias("PredictedRevenue"),
        (ratio(given, F.sum("Predicted")) * 100).alias("PredictedShare_Pct"),
    )
    middle = exact_quantiles(zero_spenders(frame), ["Predicted"], {"MedianPredicted": 0.5})
    return sums.join(F.broadcast(middle.select("MedianPredicted")), how="left")
