"""Registered queries: evaluation and spend-model diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwise.functions.columns import settled
from tillwise.operators import diagnostics as di
from tillwise.operators import metrics as me
from tillwise.operators import preparation as pr
from tillwise.plans.inputs import features, kept_features, scored
from tillwise.plans.oracle import r, ra, rounded, with_tables
from tillwise.plans.preparation import split_sql

# The grid of decision thresholds.
THRESHOLDS = [i / 100 for i in range(10, 90)]
POWER = 1.5
NEEDED = ("RetentionLabel", "FutureSpend90Days", "SpendLast90Days")


def deviance(spark, folder):
    parts = pr.split_rows(kept_features(spark, folder, *NEEDED), 0.2, ["RetentionLabel"])
    baseline = parts.where(F.col("Split") == "train").agg(F.avg("FutureSpend90Days").alias("Mean"))
    test = parts.where(F.col("Split") == "test").select(
        F.col("FutureSpend90Days").alias("Actual"), F.col("SpendLast90Days").alias("Predicted")
    )
    return settled(me.deviance_metrics(test, baseline, POWER), 4)


def log_model(spark, folder):
    """A line through the logs of the last spend and of the spend to come, and its factor, from train buyers; test buyers are scored."""
    parts = pr.split_rows(kept_features(spark, folder, *NEEDED), 0.2, ["RetentionLabel"])
    logs = parts.where(F.col("FutureSpend90Days") > 0).select(
        "Customer_ID",
        "Split",
        F.log1p("FutureSpend90Days").alias("LogActual"),
        F.log1p(F.greatest(F.col("SpendLast90Days"), F.lit(0.0))).alias("_x"),
    )
    train = F.col("Split") == "train"
    line = logs.where(train).agg(
        F.regr_slope("LogActual", "_x").alias("_slope"), F.regr_intercept("LogActual", "_x").alias("_start")
    )
    fitted = logs.join(F.broadcast(line)).withColumn("LogPredicted", F.col("_start") + F.col("_slope") * F.col("_x"))
    found = di.smear(fitted.where(~train), di.smearing_factor(fitted.where(train)))
    return settled(found.drop("Split", "_x", "_slope", "_start"), 4, Predicted=2, PredictedPlain=2)


def calibrated(spark, folder):
    rows = scored(spark, folder)
    return settled(
        di.calibrate(rows, di.calibration_factor(rows)).select("Customer_ID", "Actual", "Predicted"), 4
    )


def mean_baseline(spark, folder):
    parts = pr.split_rows(kept_features(spark, folder, *NEEDED), 0.2, ["RetentionLabel"])
    mean = parts.where(F.col("Split") == "train").agg(F.avg("FutureSpend90Days").alias("Predicted"))
    test = parts.where(F.col("Split") == "test").select(
        "Customer_ID", F.col("FutureSpend90Days").alias("Actual")
    )
    return settled(test.join(F.broadcast(mean)))


def majority_baseline(spark, folder):
    from tillwise.operators.models import majority_class

    return settled(majority_class(features(spark, folder).select("RetentionLabel"), "RetentionLabel"))


def clipped(spark, folder):
    rows = scored(spark, folder)
    shifted = F.col("Predicted") - 100
    return settled(rows.select("Customer_ID", di.clip_at_zero(shifted).alias("Predicted")), 4)


def _forecast_errors(expr, name):
    def query(spark, folder):
        from tillwise.plans.series import baseline_forecasts

        rows = baseline_forecasts(spark, folder)
        return settled(
            rows.groupBy("Model").agg(expr(F.col("Actual"), F.col("Forecast")).alias(name))
        )

    return query


def forecast_rows(spark, folder):
    from tillwise.plans.series import baseline_forecasts

    return settled(me.forecast_metrics(baseline_forecasts(spark, folder)), 4, MSE=0)


def comparison(spark, folder):
    from tillwise.plans.series import baseline_forecasts

    return settled(
        me.compare_models(me.forecast_metrics(baseline_forecasts(spark, folder))), 4, MSE=0
    )


QUERIES = {
    "mod01_majority_baseline": majority_baseline,
    "mod08_mean_baseline": mean_baseline,
    "mod16_smearing": log_model,
    "mod17_calibration": calibrated,
    "mod18_clip_predictions": clipped,
    "met01_regression_metrics": lambda s, d: settled(
        me.regression_metrics(scored(s, d)), 4, MSE=2
    ),
    "met02_spearman": lambda s, d: settled(
        me.spearman(scored(s, d), "Actual", "Predicted", "Customer_ID")
    ),
    "met03_classification": lambda s, d: settled(
        me.classification_metrics(scored(s, d), "Label", "Decision")
    ),
    "met04_roc_auc": lambda s, d: settled(me.roc_auc(scored(s, d), "Label", "Score")),
    "met05_pr_auc_brier": lambda s, d: settled(me.pr_auc_and_brier(scored(s, d), "Label", "Score")),
    "met06_confusion_matrix": lambda s, d: me.confusion_matrix(scored(s, d), "Label", "Decision"),
    "met07_curve_points": lambda s, d: settled(me.curve_points(scored(s, d), "Label", "Score")),
    "met08_rescaled_scores": lambda s, d: settled(
        me.rescale_scores(scored(s, d), "Score").select("Customer_ID", "Score")
    ),
    "met09_threshold_sweep": lambda s, d: settled(
        me.threshold_sweep(scored(s, d), "Label", "Score", THRESHOLDS)
    ),
    "met10_tweedie_deviance": deviance,
    "met11_log_scale_metrics": lambda s, d: settled(me.log_scale_metrics(scored(s, d))),
    "met12_smape": _forecast_errors(me.smape, "sMAPE_Pct"),
    "met13_wape": _forecast_errors(me.wape, "WAPE_Pct"),
    "met14_forecast_metrics": forecast_rows,
    "met15_model_comparison": comparison,
    "dia01_residuals": lambda s, d: settled(
        di.residuals(scored(s, d)).drop("Label", "Score", "Decision")
    ),
    "dia02_residual_summary": lambda s, d: settled(
        di.residual_summary(di.residuals(scored(s, d))), 5
    ),
    "dia02_largest_misses": lambda s, d: settled(
        di.largest_misses(di.residuals(scored(s, d))).select(
            "Side", "Customer_ID", "Actual", "Predicted", "Residual"
        ),
        4,
    ),
    "dia03_error_by_actual_decile": lambda s, d: settled(
        di.error_by_actual_decile(di.residuals(scored(s, d))), 4
    ),
    "dia04_calibration_by_decile": lambda s, d: settled(
        di.calibration_by_predicted_decile(di.residuals(scored(s, d))), 4
    ),
    "dia05_lift_table": lambda s, d: settled(di.lift_table(scored(s, d)), 4),
    "dia06_zero_spenders": lambda s, d: settled(
        di.zero_spenders(di.residuals(scored(s, d))).select("Customer_ID", "Predicted", "LogPredicted"), 4
    ),
    "dia06_zero_spender_summary": lambda s, d: settled(di.zero_spender_summary(scored(s, d)), 4),
}

_ERRORS = {
    "Rows": "count(*)",
    "MSE": "avg((y - p) * (y - p))",
    "RMSE": "sqrt(avg((y - p) * (y - p)))",
    "MAE": "avg(abs(y - p))",
    "R2": "case when var_pop(y) > 0 then 1 - sum((y - p) * (y - p)) / (count(*) * var_pop(y)) end",
    "RMSLE": "sqrt(avg((ln(1 + y) - ln(1 + p)) * (ln(1 + y) - ln(1 + p))))",
    "WMAPE_Pct": "sum(abs(y - p)) / nullif(sum(y), 0) * 100",
    "RevenueError_Pct": "abs(sum(y) - sum(p)) / nullif(sum(y), 0) * 100",
    "PredictedToActual": "sum(p) / nullif(sum(y), 0)",
    "ActualTotal": "sum(y)",
    "PredictedTotal": "sum(p)",
    "MedianAE": "median(abs(y - p))",
}


def _error(name, digits=4):
    if name == "Rows":
        return "count(*) as Rows"
    return f"{r(_ERRORS[name], 2 if name == 'MSE' else digits)} as {name}"


RANKED = """
ranked as (
  select *, rank() over (order by Actual) + (count(*) over (partition by Actual) - 1) / 2.0::double as ra,
            rank() over (order by Predicted) + (count(*) over (partition by Predicted) - 1) / 2.0::double as rp
  from scored)
"""
CURVE = """
by_score as (
  select Score, count(*) filter (Label = 1) as pos, count(*) filter (Label = 0) as neg from scored group by 1),
cumulated as (
  select *, sum(pos) over w as tp, sum(neg) over w as fp,
    sum(pos) over () as allpos, sum(neg) over () as allneg
  from by_score window w as (order by Score desc))
"""
COUNTS = """
counts as (
  select count(*) filter (Label = 1 and Decision = 1) as tp, count(*) filter (Label = 0 and Decision = 1) as fp,
    count(*) filter (Label = 1 and Decision = 0) as fn, count(*) filter (Label = 0 and Decision = 0) as tn
  from scored)
"""


def _decile(value):
    return f"""placed as (
      select *, row_number() over (order by {value}, Customer_ID) as rn, count(*) over () as n from diagnosed),
    deciled as (
      select *, cast(greatest(1, ((rn - 1) * 10 + n - 2) // (n - 1)) as int) as Decile from placed)"""


def _decile_sums(name, more=""):
    return f"""select Decile as {name}, count(*) as Count, {r('avg(Actual)', 4)} as MeanActual,
      {r('avg(Predicted)', 4)} as MeanPredicted, {r('sum(Actual)', 4)} as ActualRevenue,
      {r('sum(Predicted)', 4)} as PredictedRevenue, {more}
      {r('abs(sum(Actual) - sum(Predicted)) / nullif(sum(Actual), 0) * 100', 4)} as RevenueError_Pct
      from deciled group by 1"""


def _deviance(mu):
    a, b = 1 - POWER, 2 - POWER
    mu = f"greatest({mu}, 1e-9)"
    return f"2 * (pow(Actual, {b}) / ({a * b}) - Actual * pow({mu}, {a}) / ({a}) + pow({mu}, {b}) / {b})"


_SUMMARY = " union all ".join(
    f"""select '{c}' as Measure, count({c}) as Count, {r(f'avg({c})', 5)} as Mean, {r(f'stddev_samp({c})', 5)} as Std,
    {r(f'min({c})', 5)} as Min, {r(f'quantile_cont({c}, 0.25)', 5)} as P25, {r(f'quantile_cont({c}, 0.5)', 5)} as P50,
    {r(f'quantile_cont({c}, 0.75)', 5)} as P75, {r(f'max({c})', 5)} as Max from diagnosed"""
    for c in ("Actual", "Predicted", "Residual", "AbsResidual", "LogResidual")
)

_PARTS = f"parts as ({split_sql('RetentionLabel')})"
_TRAIN_MEAN = "(select avg(FutureSpend90Days) from parts where Split = 'train')"

ORACLES = {
    "mod01_majority_baseline": with_tables(
        "features",
        f"""select cast(RetentionLabel as bigint) as RetentionLabel, count(*) as Rows,
              {r('count(*) / cast((select count(*) from features) as double)')} as Accuracy
            from features group by 1 order by 2 desc, 1 limit 1""",
    ),
    "mod08_mean_baseline": with_tables(
        "features",
        f"""select Customer_ID, {r('FutureSpend90Days')} as Actual, {r(_TRAIN_MEAN)} as Predicted
            from parts where Split = 'test'""",
        _PARTS,
    ),
    "mod16_smearing": with_tables(
        "features",
        f"""select Customer_ID, {ra('LogActual', 4)}, {ra('LogPredicted', 4)},
              {r('greatest(exp(LogPredicted) * f - 1, 0)', 2)} as Predicted,
              {r('greatest(exp(LogPredicted) - 1, 0)', 2)} as PredictedPlain
            from fitted, (select avg(exp(LogActual - LogPredicted)) as f from fitted where Split = 'train')
            where Split = 'test'""",
        f"parts as ({split_sql('RetentionLabel')})",
        """logs as (select Customer_ID, Split, ln(1 + FutureSpend90Days) as LogActual, ln(1 + greatest(SpendLast90Days, 0)) as x
             from parts where FutureSpend90Days > 0)""",
        """fitted as (select *, a + b * x as LogPredicted from logs,
             (select regr_slope(LogActual, x) as b, regr_intercept(LogActual, x) as a from logs where Split = 'train'))""",
    ),
    "mod17_calibration": with_tables(
        "scored",
        f"""select Customer_ID, {ra('Actual', 4)}, {r('greatest(Predicted * f, 0)', 4)} as Predicted
            from scored, (select coalesce(sum(Actual) / nullif(sum(Predicted), 0), 1) as f from scored)""",
    ),
    "mod18_clip_predictions": with_tables(
        "scored", f"select Customer_ID, {r('greatest(Predicted - 100, 0)', 4)} as Predicted from scored"
    ),
    "met01_regression_metrics": with_tables(
        "scored",
        "select " + ", ".join(_error(n) for n in _ERRORS)
        + f", (select {r('corr(ra, rp)', 4)} from ranked) as Spearman "
        "from (select Actual as y, Predicted as p from scored)",
        RANKED,
    ),
    "met02_spearman": with_tables("scored", f"select {r('corr(ra, rp)')} as Spearman from ranked", RANKED),
    "met03_classification": with_tables(
        "scored",
        f"""select {r('(tp + tn) / cast(tp + fp + fn + tn as double)')} as Accuracy,
              {r('tp / nullif(cast(tp + fp as double), 0)')} as "Precision", {r('tp / nullif(cast(tp + fn as double), 0)')} as Recall,
              {r('2 * tp / nullif(cast(2 * tp + fp + fn as double), 0)')} as F1 from counts""",
        COUNTS,
    ),
    "met04_roc_auc": with_tables(
        "scored",
        f"""select {r('sum(case when Label = 1 then rk end) / (p * n) - (p + 1) / (2.0::double * n)')} as RocAuc from (
              select Label, rank() over (order by Score) + (count(*) over (partition by Score) - 1) / 2.0::double as rk,
                count(*) filter (Label = 1) over () as p, count(*) filter (Label = 0) over () as n from scored)
            group by p, n""",
    ),
    "met05_pr_auc_brier": with_tables(
        "scored",
        f"""select (select {r('sum(pos * (tp / cast(tp + fp as double))) / sum(pos)')} from cumulated) as PrAuc,
              {r('avg((Score - Label) * (Score - Label))')} as Brier from scored""",
        CURVE,
    ),
    "met06_confusion_matrix": with_tables(
        "scored",
        """select cast(l as int) as Label, cast(d as int) as Decision,
             (select count(*) from scored where Label = l and Decision = d) as Rows
           from (select unnest([0, 1]) as l), (select unnest([0, 1]) as d)""",
    ),
    "met07_curve_points": with_tables(
        "scored",
        f"""select {r('Score')} as Threshold, {r('fp / cast(allneg as double)')} as FalsePositiveRate,
              {r('tp / cast(allpos as double)')} as TruePositiveRate, {r('tp / cast(tp + fp as double)')} as "Precision"
            from cumulated""",
        CURVE,
    ),
    "met08_rescaled_scores": with_tables(
        "scored",
        f"""select Customer_ID, {r('(Score - lo) / (hi - lo)')} as Score
            from scored, (select min(Score) as lo, max(Score) as hi from scored)""",
    ),
    "met09_threshold_sweep": with_tables(
        "scored",
        f"""select {r('t')} as Threshold, {r('(tp + tn) / cast(tp + fp + fn + tn as double)')} as Accuracy,
              {r('tp / nullif(cast(tp + fp as double), 0)')} as "Precision", {r('tp / nullif(cast(tp + fn as double), 0)')} as Recall,
              {r('2 * tp / nullif(cast(2 * tp + fp + fn as double), 0)')} as F1
            from (select t, count(*) filter (Label = 1 and Score >= t) as tp, count(*) filter (Label = 0 and Score >= t) as fp,
                    count(*) filter (Label = 1 and Score < t) as fn, count(*) filter (Label = 0 and Score < t) as tn
                  from scored, (select cast(i as double) / 100 as t from range(10, 90) g(i)) group by t)""",
    ),
    "met10_tweedie_deviance": with_tables(
        "features",
        f"""select {r('m', 4)} as ModelDeviance, {r('b', 4)} as BaselineDeviance, {r('1 - m / b', 4)} as DevianceR2
            from (select avg({_deviance('Predicted')}) as m, avg({_deviance('Mean')}) as b
                  from (select FutureSpend90Days as Actual, SpendLast90Days as Predicted, {_TRAIN_MEAN} as Mean
                        from parts where Split = 'test'))""",
        _PARTS,
    ),
    "met11_log_scale_metrics": with_tables(
        "scored",
        f"""select {r(_ERRORS['RMSE'])} as LogRMSE, {r(_ERRORS['R2'])} as LogR2
            from (select ln(1 + Actual) as y, ln(1 + Predicted) as p from scored)""",
    ),
    "dia01_residuals": with_tables(
        "scored",
        f"""select Customer_ID, {rounded('Actual Predicted Residual AbsResidual LogActual LogPredicted LogResidual')},
            ActualZeroFlag from diagnosed""",
    ),
    "dia02_residual_summary": with_tables("scored", _SUMMARY),
    "dia02_largest_misses": with_tables(
        "scored",
        f"""select Side, Customer_ID, {rounded('Actual Predicted Residual', 4)} from (
              (select 'under' as Side, * from diagnosed order by Residual desc, Customer_ID limit 10)
              union all (select 'over' as Side, * from diagnosed order by Residual, Customer_ID limit 10))""",
    ),
    "dia03_error_by_actual_decile": with_tables(
        "scored",
        _decile_sums(
            "ActualDecile",
            f"{r('avg(AbsResidual)', 4)} as MAE, {r('median(AbsResidual)', 4)} as MedianAE,",
        ),
        _decile("Actual"),
    ),
    "dia04_calibration_by_decile": with_tables(
        "scored", _decile_sums("PredictedDecile"), _decile("Predicted")
    ),
    "dia05_lift_table": with_tables(
        "scored",
        f"""select {r('pct', 4)} as TopCustomer_Pct, k as CustomerCount, {r('captured', 4)} as ActualRevenueCaptured,
              {r('captured / total * 100', 4)} as RevenueCapture_Pct, {r('captured / total * 100 / pct', 4)} as LiftVsRandom
            from (select pct, k, coalesce(sum(Actual) filter (rn <= k), 0) as captured, sum(Actual) as total
                  from (select *, row_number() over (order by Predicted desc, Customer_ID) as rn,
                          count(*) over () as n from scored)
                  cross join (select unnest([5.0, 10.0, 20.0, 30.0, 50.0])::double as pct)
                  cross join lateral (select cast(floor(n * (pct / 100)) as bigint) as k) group by pct, k)""",
    ),
    "dia06_zero_spenders": with_tables(
        "scored",
        f"select Customer_ID, {rounded('Predicted LogPredicted', 4)} from diagnosed where Actual = 0",
    ),
    "dia06_zero_spender_summary": with_tables(
        "scored",
        f"""select count(*) filter (Actual = 0) as ZeroSpenders, {r('avg(Predicted) filter (Actual = 0)', 4)} as MeanPredicted,
              {r('median(Predicted) filter (Actual = 0)', 4)} as MedianPredicted,
              {r('sum(Predicted) filter (Actual = 0)', 4)} as PredictedRevenue,
              {r('sum(Predicted) filter (Actual = 0) / nullif(sum(Predicted), 0) * 100', 4)} as PredictedShare_Pct
            from scored""",
    ),
}
