"""Registered queries: retention and spend models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwise.functions.columns import settled
from tillwise.operators import boosting as bo
from tillwise.operators import metrics as me
from tillwise.operators import models as mo
from tillwise.operators import neighbours as ne
from tillwise.operators import search as se
from tillwise.plans.inputs import kept_features
from tillwise.plans.oracle import r, ra, with_tables
from tillwise.plans.preparation import matrix_sql, split_sql

COLUMNS = mo.MODEL_FEATURES
# Settings of a rule model that needs no fit: buys again after at least this many purchases.
MINIMUM_PURCHASES = (1, 2, 3, 4, 5)
FOLDS = 5


def rows(spark, folder):
    return mo.model_rows(kept_features(spark, folder))


def classifier(name, **options):
    return lambda spark, folder: mo.classify(rows(spark, folder), name, **options)


def regressor(name, **options):
    return lambda spark, folder: mo.regress(rows(spark, folder), name, **options)


def knn(fit, target, **options):
    """Neighbours on the scaled features, from training to test rows."""

    def query(spark, folder):
        prepared = rows(spark, folder)
        found = fit(mo.train_rows(prepared), mo.test_rows(prepared), COLUMNS, target, **options)
        return settled(found)

    return query


def rule_trials(spark, folder):
    """Fold scores of simple rules: one row per rule and setting, like a parameter search."""
    return trial_rows(kept_features(spark, folder))


def trial_rows(features):
    folds = mo.with_folds(features, FOLDS)
    settings = F.array(
        *[
            F.struct(F.lit(name).alias("Model"), F.lit(k).alias("Minimum"), (F.col(c) >= k).cast("int").alias("Decision"))
            for name, c in (("Recent", "PurchasesLast90Days"), ("Prior", "PurchasesPrior90Days"))
            for k in MINIMUM_PURCHASES
        ]
    )
    long = folds.select("Fold", F.col("RetentionLabel").alias("Label"), F.inline(settings))
    counts = {n: c.alias(n) for n, c in me.confusion_counts(F.col("Label"), F.col("Decision")).items()}
    per_fold = long.groupBy("Model", "Minimum", "Fold").agg(*counts.values())
    tp, fp, fn = F.col("TruePositives"), F.col("FalsePositives"), F.col("FalseNegatives")
    f1 = F.coalesce(F.try_divide(2.0 * tp, (2 * tp + fp + fn).cast("double")), F.lit(0.0))
    return per_fold.groupBy("Model", "Minimum").agg(
        F.avg(f1).alias("MeanScore"), F.stddev_pop(f1).alias("StdScore")
    ).withColumn("Params", F.format_string("minimum=%d", F.col("Minimum")))


def searched(*models):
    return lambda spark, folder: se.classifier_search(rows(spark, folder), models=models or se.MODELS)


def shown(search):
    return lambda spark, folder: search(spark, folder).withColumn("Params", F.to_json("Params"))


def best_settings(spark, folder, *models):
    return se.best_trials(searched(*models)(spark, folder)).withColumn("BestParams", F.to_json("BestParams"))


def neighbour_trials(spark, folder):
    """Trials of the neighbour classifier, with their parameter as a column."""
    return se.flat_trials(searched("KNN")(spark, folder)).select("Model", F.col("k").cast("int").alias("k"), "MeanScore", "StdScore")


QUERIES = {
    "mod02_logistic_regression": classifier("LogisticRegression"),
    "mod03_knn_classifier": knn(ne.knn_classify, "RetentionLabel", k=5),
    "mod03_knn_classifier_weighted": knn(ne.knn_classify, "RetentionLabel", k=7, weights="distance"),
    "mod04_decision_tree": classifier("DecisionTree"),
    "mod05_linear_svc": classifier("LinearSVC"),
    "mod06_random_forest": classifier("RandomForest"),
    "mod07_boosted_trees": classifier("BoostedTrees"),
    "mod09_ridge_on_log": lambda s, d: mo.ridge_on_log(rows(s, d)),
    "mod10_knn_regressor": knn(ne.knn_regress, "FutureSpend90Days", k=5),
    "mod10_knn_regressor_manhattan": knn(ne.knn_regress, "FutureSpend90Days", k=5, power=1),
    "mod11_decision_tree_regressor": regressor("DecisionTree"),
    "mod12_random_forest_regressor": regressor("RandomForest"),
    "mod13_boosted_regressor": regressor("BoostedTrees"),
    "mod14_tweedie": lambda s, d: mo.tweedie_spend(rows(s, d)),
    "mod14_tweedie_power_search": lambda s, d: mo.tweedie_search(rows(s, d)).select(
        "Model", F.col("Params")["variancePower"].alias("VariancePower"), "MeanScore", "StdScore"
    ),
    "mod14_tweedie_boosted": lambda s, d: bo.boosted_spend(rows(s, d)),
    "mod15_two_stage": lambda s, d: mo.two_stage_spend(rows(s, d)),
    "mod16_log_stage": lambda s, d: mo.log_stage(rows(s, d)),
    "mod19_search": shown(searched()),
    "mod19_search_boosted_trees": shown(searched("BoostedTrees")),
    "mod19_search_random_forest": shown(searched("RandomForest")),
    "mod19_search_logistic": shown(searched("LogisticRegression")),
    "mod19_search_svc": shown(searched("LinearSVC")),
    "mod19_search_tree": shown(searched("DecisionTree")),
    "mod19_search_neighbours": lambda s, d: settled(neighbour_trials(s, d)),
    "mod19_rule_trials": lambda s, d: settled(rule_trials(s, d)),
    "mod19_flat_trials": lambda s, d: se.flat_trials(searched("DecisionTree", "LinearSVC", "KNN")(s, d)),
    "mod20_best_trials": lambda s, d: settled(best_settings(s, d, "KNN")),
    "mod20_best_of_models": lambda s, d: best_settings(s, d, "DecisionTree", "LinearSVC", "KNN"),
}

FILLED = f"""
filled as (select * replace (coalesce(AvgGapDays, 999) as AvgGapDays) from features),
parts as ({split_sql('RetentionLabel', table='filled')}),
train as (select * from parts where Split = 'train')
"""
VECTORS = f"""
vectors as (select Customer_ID, Split, RetentionLabel, FutureSpend90Days, [{', '.join(COLUMNS)}] as v from matrix)
"""


def nearest_sql(k, target, power=2):
    apart = "list_distance(a.v, b.v)" if power == 2 else "list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2])))"
    return f"""
    nearest as (
      select Customer_ID, Distance, Target from (
        select *, row_number() over (partition by Customer_ID order by Distance, Neighbour) as k from (
          select a.Customer_ID, b.Customer_ID as Neighbour, cast(b.{target} as double) as Target, {r(apart, 9)} as Distance
          from vectors a, vectors b where a.Split = 'test' and b.Split = 'train'))
      where k <= {k})"""


def knn_sql(select, k, target, power=2):
    return with_tables(
        "features", select, FILLED, matrix_sql(fit="train", source="parts"), VECTORS, nearest_sql(k, target, power)
    )


# Neighbour search: every training row is held out once, the other folds are its neighbours.
NEIGHBOUR_TRIALS = f"""
folded as (
  select Customer_ID, RetentionLabel as Label, v,
    row_number() over (partition by RetentionLabel order by md5(Customer_ID), Customer_ID) % {se.FOLDS} as Fold
  from vectors where Split = 'train'),
close_rows as (
  select Customer_ID, Label, Fold, Target, row_number() over (partition by Customer_ID order by Distance, Neighbour) as Place
  from (select a.Customer_ID, a.Label, a.Fold, b.Customer_ID as Neighbour, cast(b.Label as double) as Target,
          {r('list_distance(a.v, b.v)', 9)} as Distance
        from folded a join folded b on a.Fold <> b.Fold)
  qualify Place <= {max(se.NEIGHBOUR_COUNTS)}),
decided as (
  select Customer_ID, any_value(Label) as Label, any_value(Fold) as Fold, n.k, avg(Target) > 0.5 as Decision
  from close_rows, (select unnest([{', '.join(map(str, se.NEIGHBOUR_COUNTS))}]) as k) n where Place <= n.k group by Customer_ID, n.k),
fold_scores as (
  select k, Fold, coalesce(2.0::double * count(*) filter (Label = 1 and Decision) / nullif(
      2 * count(*) filter (Label = 1 and Decision) + count(*) filter (Label = 0 and Decision)
      + count(*) filter (Label = 1 and not Decision), 0), 0) as f1
  from decided group by 1, 2),
trials as (select 'KNN' as Model, cast(k as int) as k, avg(f1) as MeanScore, stddev_pop(f1) as StdScore from fold_scores group by 2)
"""


def neighbour_trials_sql(select):
    return with_tables("features", select, FILLED, matrix_sql(fit="train", source="parts"), VECTORS, NEIGHBOUR_TRIALS)


RULE_TRIALS = f"""
folded as (
  select *, row_number() over (partition by RetentionLabel order by md5(Customer_ID), Customer_ID) % {FOLDS} as Fold from features),
fold_scores as (
  select Model, Minimum, Fold, coalesce(2.0::double * count(*) filter (Label = 1 and Decision) / nullif(
      2 * count(*) filter (Label = 1 and Decision) + count(*) filter (Label = 0 and Decision)
      + count(*) filter (Label = 1 and not Decision), 0), 0) as f1
  from (select Fold, RetentionLabel as Label, 'Recent' as Model, m as Minimum, PurchasesLast90Days >= m as Decision
        from folded, (select unnest([{', '.join(map(str, MINIMUM_PURCHASES))}]) as m)
        union all
        select Fold, RetentionLabel, 'Prior', m, PurchasesPrior90Days >= m
        from folded, (select unnest([{', '.join(map(str, MINIMUM_PURCHASES))}]) as m))
  group by 1, 2, 3),
trials as (
  select Model, Minimum, avg(f1) as MeanScore, stddev_pop(f1) as StdScore, 'minimum=' || Minimum as Params
  from fold_scores group by 1, 2)
"""

ORACLES = {
    "mod03_knn_classifier": knn_sql(
        f"""select Customer_ID, {r('avg(Target)')} as Score, cast(avg(Target) > 0.5 as int) as Decision
            from nearest group by 1""",
        5,
        "RetentionLabel",
    ),
    "mod03_knn_classifier_weighted": knn_sql(
        f"""select Customer_ID, {r('v')} as Score, cast(v > 0.5 as int) as Decision from (
              select Customer_ID, coalesce(avg(Target) filter (Distance = 0),
                sum(Target / Distance) filter (Distance > 0) / sum(1 / Distance) filter (Distance > 0)) as v
              from nearest group by 1)""",
        7,
        "RetentionLabel",
    ),
    "mod10_knn_regressor": knn_sql(
        f"select Customer_ID, {r('avg(Target)')} as Predicted from nearest group by 1", 5, "FutureSpend90Days"
    ),
    "mod10_knn_regressor_manhattan": knn_sql(
        f"select Customer_ID, {r('avg(Target)')} as Predicted from nearest group by 1", 5, "FutureSpend90Days", 1
    ),
    "mod19_search_neighbours": neighbour_trials_sql(f"select Model, k, {ra('MeanScore')}, {ra('StdScore')} from trials"),
    "mod19_rule_trials": with_tables(
        "features",
        f"select Model, cast(Minimum as int) as Minimum, {ra('MeanScore')}, {ra('StdScore')}, Params from trials",
        RULE_TRIALS,
    ),
    "mod20_best_trials": neighbour_trials_sql(
        f"""select Model, {r('MeanScore')} as BestScore, '{{"k":"' || k || '"}}' as BestParams from trials
            qualify row_number() over (order by MeanScore desc, k) = 1"""
    ),
}
