"""Model quality measures, each from one or two aggregates over the scored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.columns import correlation, ratio, unpivot
from tillwise.functions.lineage import cut_lineage
from tillwise.functions.ranking import (
    average_ranks,
    exact_quantiles,
    join_ranks,
    running_totals,
)


def _share(part: Column, whole: Column) -> Column:
    """Percentage, null when the whole is zero."""
    return F.when(whole != 0, part / F.nullif(whole, F.lit(0.0)) * 100)


def error_aggregates(actual: Column, predicted: Column) -> list[Column]:
    """The error measures that need nothing but sums; usable in any group-by."""
    error = actual - predicted
    n = F.count(error)
    squares = F.sum(error * error)
    spread = n * F.var_pop(actual)
    log_error = F.log1p(actual) - F.log1p(predicted)
    total, forecast = F.sum(actual), F.sum(predicted)
    return [
        n.alias("Rows"),
        (squares / n).alias("MSE"),
        F.sqrt(squares / n).alias("RMSE"),
        F.avg(F.abs(error)).alias("MAE"),
        F.when(spread > 0, 1 - squares / F.nullif(spread, F.lit(0.0))).alias("R2"),
        F.sqrt(F.avg(log_error * log_error)).alias("RMSLE"),
        _share(F.sum(F.abs(error)), total).alias("WMAPE_Pct"),
        _share(F.abs(total - forecast), total).alias("RevenueError_Pct"),
        (_share(forecast, total) / 100).alias("PredictedToActual"),
        total.alias("ActualTotal"),
        forecast.alias("PredictedTotal"),
    ]


def spearman(scored: DataFrame, actual: str, predicted: str, identifier: str) -> DataFrame:
    """Rank correlation on average ranks; null when either side is constant."""
    rows = scored.select(identifier, actual, predicted)
    long = unpivot(rows, [], [actual, predicted], "Measure", "Value").where(F.col("Value").isNotNull())
    ranks = cut_lineage(average_ranks(long, "Value", "Rank", ["Measure"]))  # one sort for both sides
    for value, name in ((actual, "_rank_a"), (predicted, "_rank_p")):
        own = ranks.where(F.col("Measure") == value).select(F.col("Value").alias(value), "Copies", F.col("Rank").alias(name))
        rows = join_ranks(rows, own, value, name, identifier)
    return rows.agg(correlation(F.col("_rank_a"), F.col("_rank_p")).alias("Spearman"))


def regression_metrics(
    scored: DataFrame,
    actual: str = "Actual",
    predicted: str = "Predicted",
    identifier: str = "Customer_ID",
) -> DataFrame:
    """One row of spend-model measures; predictions below zero count as zero."""
    rows = cut_lineage(
        scored.select(
            identifier,
            F.col(actual).cast("double").alias("Actual"),
            F.greatest(F.col(predicted).cast("double"), F.lit(0.0)).alias("Predicted"),
        )
    )
    sums = rows.agg(*error_aggregates(F.col("Actual"), F.col("Predicted")))
    errors = rows.select(F.abs(F.col("Actual") - F.col("Predicted")).alias("AbsError"))
    median = exact_quantiles(errors, ["AbsError"], {"MedianAE": 0.5}).select("MedianAE")
    rank = spearman(rows, "Actual", "Predicted", identifier)
    return sums.join(F.broadcast(median)).join(F.broadcast(rank))


def log_scale_metrics(scored: DataFrame, actual: str = "Actual", predicted: str = "Predicted") -> DataFrame:
    return scored.agg(
        *error_aggregates(F.log1p(actual), F.log1p(F.greatest(F.col(predicted), F.lit(0.0))))
    ).select(F.col("RMSE").alias("LogRMSE"), F.col("R2").alias("LogR2"))


def confusion_counts(label: Column, decision: Column) -> dict[str, Column]:
    return {
        "TruePositives": F.count_if((label == 1) & (decision == 1)),
        "FalsePositives": F.count_if((label == 0) & (decision == 1)),
        "FalseNegatives": F.count_if((label == 1) & (decision == 0)),
        "TrueNegatives": F.count_if((label == 0) & (decision == 0)),
    }


def _classification(frame: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    tp, fp = F.col("TruePositives"), F.col("FalsePositives")
    fn, tn = F.col("FalseNegatives"), F.col("TrueNegatives")
    return frame.select(
        *keep,
        ratio(tp + tn, tp + fp + fn + tn).alias("Accuracy"),
        ratio(tp, tp + fp).alias("Precision"),
        ratio(tp, tp + fn).alias("Recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("F1"),
    )


def classification_metrics(scored: DataFrame, label: str, decision: str) -> DataFrame:
    counts = confusion_counts(F.col(label), F.col(decision))
    return _classification(scored.agg(*[c.alias(n) for n, c in counts.items()]))


def confusion_matrix(scored: DataFrame, label: str, decision: str) -> DataFrame:
    """All four cells, empty ones as 0."""
    counts = confusion_counts(F.col(label), F.col(decision))
    one = scored.agg(*[c.alias(n) for n, c in counts.items()])

    def cell(actual: int, predicted: int, name: str) -> Column:
        return F.struct(
            F.lit(actual).alias("Label"), F.lit(predicted).alias("Decision"), F.col(name).alias("Rows")
        )

    return one.select(
        F.inline(
            F.array(
                cell(0, 0, "TrueNegatives"),
                cell(0, 1, "FalsePositives"),
                cell(1, 0, "FalseNegatives"),
                cell(1, 1, "TruePositives"),
            )
        )
    )


def score_counts(scored: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score: all later curves start from this."""
    return scored.groupBy(F.col(score).alias("Score")).agg(
        F.count_if(F.col(label) == 1).alias("Positives"),
        F.count_if(F.col(label) == 0).alias("Negatives"),
    )


def _cumulated(scored: DataFrame, label: str, score: str) -> DataFrame:
    counts = score_counts(scored, label, score)
    return running_totals(
        counts,
        [F.col("Score").desc()],
        {"TP": F.col("Positives"), "FP": F.col("Negatives")},
    )


def roc_auc(scored: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve with ties at half weight; null for one class only."""
    rows = _cumulated(scored, label, score)
    behind = F.col("FP") - F.col("Negatives") / F.lit(2.0)
    positives, negatives = F.sum("Positives"), F.sum("Negatives")
    area = F.sum(F.col("Positives") * behind)
    return rows.agg((1 - ratio(area, positives * negatives)).alias("RocAuc"))


def pr_auc_and_brier(scored: DataFrame, label: str, score: str) -> DataFrame:
    rows = _cumulated(scored, label, score)
    precision = F.col("TP") / (F.col("TP") + F.col("FP")).cast("double")
    area = rows.agg(
        ratio(F.sum(F.col("Positives") * precision), F.sum("Positives")).alias("PrAuc")
    )
    miss = F.col(score) - F.col(label)
    return area.join(F.broadcast(scored.agg(F.avg(miss * miss).alias("Brier"))))


def curve_points(scored: DataFrame, label: str, score: str) -> DataFrame:
    """ROC and precision-recall coordinates at every distinct score."""
    rows = _cumulated(scored, label, score)
    totals = rows.agg(F.sum("Positives").alias("P"), F.sum("Negatives").alias("N"))
    return rows.join(F.broadcast(totals)).select(
        F.col("Score").alias("Threshold"),
        ratio(F.col("FP"), F.col("N")).alias("FalsePositiveRate"),
        ratio(F.col("TP"), F.col("P")).alias("TruePositiveRate"),
        ratio(F.col("TP"), F.col("TP") + F.col("FP")).alias("Precision"),
    )


def rescale_scores(scored: DataFrame, score: str) -> DataFrame:
    limits = scored.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    return (
        scored.join(F.broadcast(limits))
        .withColumn(score, ratio(F.col(score) - F.col("_lo"), F.col("_hi") - F.col("_lo")))
        .drop("_lo", "_hi")
    )


def threshold_sweep(scored: DataFrame, label: str, score: str, thresholds: Sequence[float]) -> DataFrame:
    """Precision, recall and F1 at each threshold.

    Scores are counted first; a distinct score goes into the slot of the thresholds that it
    reaches, and the slots, one more than there are thresholds, are added up.
    """
    rising = sorted(set(map(float, thresholds)))
    marks = F.lit(rising)
    slot = F.size(F.filter(marks, lambda mark: mark <= F.col("Score")))
    slots = score_counts(scored, label, score).groupBy(slot.alias("Slot")).agg(
        F.sum("Positives").alias("Positives"), F.sum("Negatives").alias("Negatives")
    )
    held = slots.agg(F.collect_list(F.struct("Slot", "Positives", "Negatives")).alias("slots"))

    def total(side: str, reached: bool, at: Column) -> Column:
        mine = F.filter("slots", lambda s: (s["Slot"] > at) if reached else (s["Slot"] <= at))
        return F.aggregate(mine, F.lit(0).cast("bigint"), lambda t, s: t + s[side])

    at = F.col("_at")
    hits = held.select("slots", F.posexplode(marks).alias("_at", "Threshold")).select(
        "Threshold",
        total("Positives", True, at).alias("TruePositives"),
        total("Negatives", True, at).alias("FalsePositives"),
        total("Positives", False, at).alias("FalseNegatives"),
        total("Negatives", False, at).alias("TrueNegatives"),
    )
    return _classification(hits, ["Threshold"])


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The lowest threshold with the highest F1."""
    return sweep.orderBy(F.col("F1").desc_nulls_last(), "Threshold").limit(1)


def tweedie_deviance(actual: Column, predicted: Column, power: float) -> Column:
    """Deviance of one row for a variance power between 1 and 2."""
    a, b = 1 - power, 2 - power
    mu = F.greatest(predicted.cast("double"), F.lit(1e-9))
    return 2 * (
        F.pow(actual, F.lit(b)) / (a * b) - actual * F.pow(mu, F.lit(a)) / a + F.pow(mu, F.lit(b)) / b
    )


def deviance_metrics(scored: DataFrame, baseline: DataFrame, power: float = 1.5) -> DataFrame:
    """Mean deviance of the model and of the constant baseline, and the explained share.

    ``baseline`` is one row with a ``Mean`` of the training target.
    """
    rows = scored.join(F.broadcast(baseline.select("Mean")))
    model = F.avg(tweedie_deviance(F.col("Actual"), F.col("Predicted"), power))
    constant = F.avg(tweedie_deviance(F.col("Actual"), F.col("Mean"), power))
    return rows.agg(model.alias("ModelDeviance"), constant.alias("BaselineDeviance")).withColumn(
        "DevianceR2", 1 - ratio(F.col("ModelDeviance"), F.col("BaselineDeviance"))
    )


def smape(actual: Column, predicted: Column) -> Column:
    """Aggregate: symmetric percentage error over the rows with a non-zero denominator."""
    size = F.abs(actual) + F.abs(predicted)
    return F.avg(F.when(size != 0, 2 * F.abs(predicted - actual) / F.nullif(size, F.lit(0.0)))) * 100


def wape(actual: Column, predicted: Column) -> Column:
    """Aggregate: absolute error as a percentage of the absolute actuals."""
    return _share(F.sum(F.abs(actual - predicted)), F.sum(F.abs(actual)))


def forecast_metrics(forecasts: DataFrame, by: Sequence[str] = ("Model",)) -> DataFrame:
    """One metric row per model from rows of Actual and Forecast."""
    actual = F.col("Actual")
    finite = F.col("Forecast").isNotNull() & ~F.isnan("Forecast") & (
        F.abs(F.col("Forecast")) < F.lit(float("inf"))
    )
    forecast = F.when(finite, F.greatest(F.col("Forecast"), F.lit(0.0))).otherwise(0.0)
    error = actual - forecast
    n, squares = F.count(actual), F.sum(error * error)
    spread = n * F.var_pop(actual)
    return forecasts.groupBy(*by).agg(
        F.sqrt(squares / n).alias("RMSE"),
        F.avg(F.abs(error)).alias("MAE"),
        (squares / n).alias("MSE"),
        F.when(spread > 0, 1 - squares / F.nullif(spread, F.lit(0.0))).alias("R2"),
        wape(actual, forecast).alias("WAPE_Pct"),
        smape(actual, forecast).alias("sMAPE_Pct"),
        F.sum(actual).alias("ActualTotal"),
        F.sum(forecast).alias("PredictedTotal"),
        _share(F.abs(F.sum(actual) - F.sum(forecast)), F.sum(actual)).alias("RevenueError_Pct"),
    )


def compare_models(metrics: DataFrame, by: str = "RMSE") -> DataFrame:
    """Models from best to worst, the best one marked. One row per model."""
    best = metrics.agg(F.min_by("Model", F.struct(by, "Model")).alias("BestModel"))
    return (
        metrics.join(F.broadcast(best))
        .withColumn("IsBest", F.col("Model") == F.col("BestModel"))
        .drop("BestModel")
        .orderBy(by, "Model")
    )
