"""Registered queries: what must hold for results that SQL cannot compute.

Fits, projections and forecasts have no SQL. Each check reduces such a result to counts that do: the
rows and totals it must cover, taken from the tables, and how often a property of the method fails.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tillwise.functions.columns import settled
from tillwise.functions.lineage import cut_lineage
from tillwise.operators import boosting as bo
from tillwise.operators import models as mo
from tillwise.operators import segments as sg
from tillwise.operators.centroids import vector_rows

from tillwise.plans import models as pm
from tillwise.plans import preparation as pp
from tillwise.plans import reports as pr
from tillwise.plans import segments as ps
from tillwise.plans import series as pt
from tillwise.plans.oracle import r, rounded, with_tables

KS = range(2, 11)


def failures(condition, name):
    return F.count_if(~F.coalesce(condition, F.lit(False))).alias(name)


def classifier(query):
    """Every test customer is scored once, in range, and no decision crosses the order of the scores."""

    def check(spark, folder):
        scored = cut_lineage(query(spark, folder))
        edge = scored.agg(F.min(F.when(F.col("Decision") == 1, F.col("Score")))).first()[0]
        crossed = F.count_if((F.col("Decision") == 0) & (F.col("Score") > F.lit(edge).cast("double")))
        return scored.agg(
            F.count(F.lit(1)).alias("Rows"),
            F.countDistinct("Customer_ID").alias("Customers"),
            F.sum(F.col("Label")).cast("bigint").alias("Positives"),
            failures(F.col("Score").between(0, 1), "OutOfRange"),
            crossed.alias("Crossed"),
        )

    return check


def slopes_of(train, fitted, miss, weight, strength):
    """The slope of a penalised loss at the fitted coefficients, per feature: zero at the minimum and nowhere else.

    ``miss`` maps the linear predictor to prediction minus target; coefficients are penalised in
    multiples of their feature's deviation.
    """
    values = vector_to_array("vector")
    sides = [(name, float(fitted.coefficients[k])) for k, name in enumerate(pm.COLUMNS)]
    linear = sum((values[k] * c for k, (_, c) in enumerate(sides)), F.lit(float(fitted.intercept)))
    off, total = weight * miss(linear), F.sum(weight)
    slopes = [
        (F.sum(off * values[k]) / total + strength * F.var_samp(values[k]) * c).alias(name)
        for k, (name, c) in enumerate(sides)
    ]
    found = train.agg((F.sum(off) / total).alias("Intercept"), *slopes)
    long = found.unpivot([], ["Intercept", *pm.COLUMNS], "Feature", "Slope")
    return settled(long.withColumn("Slope", F.abs("Slope")), 3)


def logistic_gradient(spark, folder):
    model = mo.CLASSIFIERS["LogisticRegression"]()
    train = cut_lineage(mo.train_rows(pm.rows(spark, folder)))
    return slopes_of(
        train, model.fit(train), lambda x: 1 / (1 + F.exp(-x)) - F.col(mo.LABEL), F.col("Weight"), model.getRegParam()
    )


def ridge_gradient(spark, folder):
    """Spark penalises the coefficients of the target in multiples of its deviation."""
    model = mo.ridge()
    train = cut_lineage(mo.train_rows(pm.rows(spark, folder)).withColumn("LogSpend", F.log1p(mo.SPEND)))
    spread = train.agg(F.stddev_samp("LogSpend")).first()[0]
    strength = model.getRegParam() / spread if spread else 0.0
    return slopes_of(train, model.fit(train), lambda x: x - F.col("LogSpend"), F.lit(1.0), strength)


def regressor(query):
    """Every test customer has a prediction that is a finite number and not negative."""

    def check(spark, folder):
        predicted = F.col("Predicted")
        found = query(spark, folder).agg(
            F.count(F.lit(1)).alias("Rows"),
            F.countDistinct("Customer_ID").alias("Customers"),
            F.sum("Actual").alias("ActualTotal"),
            failures((predicted >= 0) & (predicted < F.lit(float("inf"))), "Undefined"),
            (F.countDistinct("Predicted") > 1).alias("Varies"),
        )
        return settled(found, 2)

    return check


def components(spark, folder):
    """Components are centred, uncorrelated, of falling variance, and their share adds up."""
    found = cut_lineage(pp.pca(spark, folder))
    share = sum((F.var_pop(f"PCA{k}") for k in (1, 2, 3)), F.lit(0.0)) / F.lit(float(len(pp.MATRIX)))
    out = found.agg(
        F.count(F.lit(1)).alias("Rows"),
        F.abs(F.avg("PCA1")).alias("Centre"),
        F.abs(F.corr("PCA1", "PCA2")).alias("Correlation12"),
        F.abs(F.corr("PCA2", "PCA3")).alias("Correlation23"),
        (F.var_pop("PCA1") >= F.var_pop("PCA2")).alias("Falling"),
        F.abs(share - F.max("ExplainedVariance")).alias("ShareError"),
    )
    return settled(out, 6)


def kmeans(spark, folder):
    """Every customer has a cluster and is nearest to the mean of its own cluster."""
    matrix = ps.matrix(spark, folder)
    placed = cut_lineage(matrix.join(sg.kmeans_labels(matrix), "Customer_ID"))
    means = placed.groupBy("Cluster").agg(*[F.avg(c).alias(c) for c in sg.CLUSTER_FEATURES]).collect()
    apart = {
        row["Cluster"]: sum(((F.col(c) - F.lit(row[c])) ** 2 for c in sg.CLUSTER_FEATURES), F.lit(0.0)) for row in means
    }
    own = F.coalesce(*[F.when(F.col("Cluster") == k, d) for k, d in apart.items()])
    nearest = own <= F.least(*apart.values()) + 1e-6
    return placed.agg(
        F.count(F.lit(1)).alias("Rows"), F.countDistinct("Cluster").alias("Clusters"), failures(nearest, "Misplaced")
    )


def search(spark, folder):
    """More clusters never cost more, and the variance ratio follows from the cost."""
    matrix = ps.matrix(spark, folder)
    rows = vector_rows(matrix, sg.CLUSTER_FEATURES)
    n, found = matrix.count(), {row["K"]: row for row in sg.k_search(matrix, KS, 20).collect()}
    total = rows.agg(sum((F.var_pop(F.col("Vector")[i]) for i in range(len(sg.CLUSTER_FEATURES))), F.lit(0.0))).first()[0] * n
    lines = []
    for k in KS:
        cost = found[k]["Inertia"]
        ratio = (total - cost) / (k - 1) / (cost / (n - k))
        worse = k > KS[0] and cost > found[k - 1]["Inertia"] * (1 + 1e-9)
        lines.append((k, n, worse, abs(ratio - found[k]["CalinskiHarabasz"]) > 1e-3 * ratio))
    return spark.createDataFrame(lines, "K int, Rows long, Worse boolean, Mismatch boolean")


def labels(query):
    def check(spark, folder):
        return query(spark, folder).agg(
            F.count(F.lit(1)).alias("Rows"),
            F.countDistinct("Customer_ID").alias("Customers"),
            failures(F.col("Cluster").isNotNull(), "Unplaced"),
            (F.countDistinct("Cluster") > 1).alias("Split"),
        )

    return check


def forecast(query):
    """The weeks and actual values a forecast covers, and how many of its values are undefined."""

    def check(spark, folder):
        bad = ~F.coalesce((F.col("Forecast") >= 0) & (F.col("Forecast") < F.lit(float("inf"))), F.lit(False))
        found = query(spark, folder)
        return settled(found.select("Model", "Date", "Actual", bad.alias("Undefined")), 2)

    return check


def ahead(query, value):
    def check(spark, folder):
        found = query(spark, folder)
        bad = ~F.coalesce((F.col(value) >= 0) & (F.col(value) < F.lit(float("inf"))), F.lit(False))
        return found.select(F.col("Step").cast("int").alias("Step"), "Date", bad.alias("Undefined"))

    return check


def tree_importances(spark, folder):
    found = pr.tree_importances(spark, folder)
    names = ("ForestImportance", "TreeImportance")
    out = found.agg(
        F.count(F.lit(1)).alias("Features"),
        *[F.sum(c).alias(c) for c in names],
        *[failures(F.col(c) >= 0, f"{c}Negative") for c in names],
    )
    return settled(out, 6)


def permutation(spark, folder):
    found = pr.permuted(spark, folder)
    return found.agg(
        F.count(F.lit(1)).alias("Features"),
        failures(F.col("RocAuc").between(0, 1), "OutOfRange"),
        F.countDistinct(F.round(F.col("RocAuc") + F.col("AucLoss"), 9)).alias("Bases"),
    )


def boosting(spark, folder):
    """The train deviance of the boosted trees falls from step to step, and the calibrated train total is right."""
    prepared = pm.rows(spark, folder)
    state, path = bo.boosted_margin(prepared)
    falls = [later < before for (_, before), (_, later) in zip(path, path[1:])]
    train = F.col("Split") == "train"
    guess, spend = F.exp("Margin") * F.col("SpendMean"), F.col(mo.SPEND)
    factor = state.where(train).agg(F.sum(spend) / F.sum(guess)).first()[0]
    out = state.where(train).agg(
        F.count(F.lit(1)).alias("Rows"),
        F.sum(spend).alias("ActualTotal"),
        F.sum(guess * F.lit(factor)).alias("PredictedTotal"),
    )
    return settled(out.withColumns({"Steps": F.lit(len(falls)), "Falls": F.lit(sum(falls))}), 2)


def attributed(spark, folder):
    """One line per feature; no mean contribution is negative in size."""
    found = pr.logistic_attribution(spark, folder)
    return found.agg(F.count(F.lit(1)).alias("Lines"), F.countDistinct("Feature").alias("Features"))


def importance_columns():
    return len(pr.COLUMNS)


CLASSIFIERS = {
    "mod02_scores_checked": "mod02_logistic_regression",
    "mod04_scores_checked": "mod04_decision_tree",
    "mod05_scores_checked": "mod05_linear_svc",
    "mod06_scores_checked": "mod06_random_forest",
    "mod07_scores_checked": "mod07_boosted_trees",
}
REGRESSORS = {
    "mod09_spend_checked": "mod09_ridge_on_log",
    "mod11_spend_checked": "mod11_decision_tree_regressor",
    "mod12_spend_checked": "mod12_random_forest_regressor",
    "mod13_spend_checked": "mod13_boosted_regressor",
    "mod14_spend_checked": "mod14_tweedie",
    "mod15_spend_checked": "mod15_two_stage",
}
SMOOTHED = {
    "tsr06_forecast_checked": ("tsr06_simple_smoothing", "'SES'"),
    "tsr07_forecast_checked": ("tsr07_trend_smoothing", "'Holt'"),
    "tsr08_forecast_checked": ("tsr08_seasonal_smoothing", "'HoltWinters_s4', 'HoltWinters_s13'"),
    "tsr12_forecast_checked": ("tsr12_lag_models", "'RandomForest_Lag', 'Boosted_Lag'"),
}

QUERIES = {
    **{name: classifier(pm.QUERIES[fit]) for name, fit in CLASSIFIERS.items()},
    **{name: regressor(pm.QUERIES[fit]) for name, fit in REGRESSORS.items()},
    **{name: forecast(pt.QUERIES[fit]) for name, (fit, _) in SMOOTHED.items()},
    "mod02_gradient_checked": logistic_gradient,
    "mod09_gradient_checked": ridge_gradient,
    "mod14_boosting_checked": boosting,
    "pre11_components_checked": components,
    "seg02_kmeans_checked": kmeans,
    "seg03_search_checked": search,
    "seg09_mixture_checked": labels(ps.QUERIES["seg09_gaussian_mixture"]),
    "seg10_divisive_checked": labels(ps.QUERIES["seg10_divisive"]),
    "tsr13_forecast_checked": ahead(pt.QUERIES["tsr13_recursive_forecast"], "Revenue"),
    "tsr17_forecast_checked": ahead(pt.QUERIES["tsr17_future_forecast"], "ForecastRevenue"),
    "att02_attribution_checked": attributed,
    "att05_importances_checked": tree_importances,
    "att06_importances_checked": permutation,
}

TESTED = """select count(*) as Rows, count(distinct Customer_ID) as Customers, cast(sum(RetentionLabel) as bigint) as Positives,
  cast(0 as bigint) as OutOfRange, cast(0 as bigint) as Crossed from parts where Split = 'test'"""
SPENT = f"""select count(*) as Rows, count(distinct Customer_ID) as Customers, {r('sum(FutureSpend90Days)', 2)} as ActualTotal,
  cast(0 as bigint) as Undefined, true as Varies from parts where Split = 'test'"""
PLACED = """select count(*) as Rows, count(distinct Customer_ID) as Customers, cast(0 as bigint) as Unplaced,
  true as Split from features"""
AHEAD = f"""select cast(k as int) as Step, cast((select max(Date) from weekly) + cast(7 * k as int) as date) as Date,
  false as Undefined from (select unnest(range(1, {pt.HORIZON} + 1)) as k)"""


def held_out(models):
    return pt.week_sql(
        f"""select Model, Date, {r('Revenue', 2)} as Actual, false as Undefined
            from test, (select unnest([{models}]) as Model)""",
        pt.SPLIT,
    )


NO_SLOPE = f"select unnest({['Intercept', *pm.COLUMNS]}) as Feature, 0.0::double as Slope"

ORACLES = {
    **{name: with_tables("features", TESTED, pm.FILLED) for name in CLASSIFIERS},
    **{name: with_tables("features", SPENT, pm.FILLED) for name in REGRESSORS},
    **{name: held_out(models) for name, (_, models) in SMOOTHED.items()},
    "mod02_gradient_checked": NO_SLOPE,
    "mod09_gradient_checked": NO_SLOPE,
    "mod14_boosting_checked": with_tables(
        "features",
        f"""select count(*) as Rows, {r('sum(FutureSpend90Days)', 2)} as ActualTotal, {r('sum(FutureSpend90Days)', 2)} as PredictedTotal,
            cast(10 as int) as Steps, cast(10 as int) as Falls from parts where Split = 'train'""",
        pm.FILLED,
    ),
    "pre11_components_checked": with_tables(
        "features",
        """select count(*) as Rows, 0.0::double as Centre, 0.0::double as Correlation12, 0.0::double as Correlation23,
           true as Falling, 0.0::double as ShareError from features""",
    ),
    "seg02_kmeans_checked": with_tables(
        "features", "select count(*) as Rows, cast(4 as bigint) as Clusters, cast(0 as bigint) as Misplaced from features"
    ),
    "seg03_search_checked": with_tables(
        "features",
        f"""select cast(K as int) as K, (select count(*) from features) as Rows, false as Worse, false as Mismatch
            from (select unnest(range({KS[0]}, {KS[-1] + 1})) as K)""",
    ),
    "seg09_mixture_checked": with_tables("features", PLACED),
    "seg10_divisive_checked": with_tables("features", PLACED),
    "tsr13_forecast_checked": pt.week_sql(AHEAD),
    "tsr17_forecast_checked": pt.week_sql(AHEAD),
    "att02_attribution_checked": f"select cast({importance_columns()} as bigint) as Lines, cast({importance_columns()} as bigint) as Features",
    "att05_importances_checked": f"""select cast({importance_columns()} as bigint) as Features, 1.0::double as ForestImportance,
        1.0::double as TreeImportance, cast(0 as bigint) as ForestImportanceNegative, cast(0 as bigint) as TreeImportanceNegative""",
    "att06_importances_checked": f"""select cast({importance_columns()} as bigint) as Features, cast(0 as bigint) as OutOfRange,
        cast(1 as bigint) as Bases""",
    "src04_csv_sink": pt.week_sql(
        f"select Date, OrderCount, UniqueCustomers, {rounded('Revenue AvgOrderValue', 4)} from weekly"
    ),
    "src05_json_sink": pt.week_sql(
        f"select Date, OrderCount, UniqueCustomers, {rounded('Revenue AvgOrderValue', 4)} from weekly"
    ),
    "tsr20_rolling_origin": pt.week_sql(
        "select Model, " + r("sqrt(avg(pow(Actual - Forecast, 2)))", 2) + " as RollingRMSE from folds group by 1",
        f"""numbered as (select *, row_number() over (order by Date desc) as back from weekly),
        cuts as (select unnest([2, 3, 4]) * {pt.HORIZON} as cut),
        guesses as (
          select cut, 'Naive' as Model, max_by(Revenue, Date) as Forecast from numbered, cuts where back > cut group by 1
          union all
          select cut, 'MovingAverage_' || w, avg(Revenue) from numbered, cuts, (select unnest([4, 8, 12]) as w)
          where back > cut and back <= cut + w group by 1, w, 2),
        folds as (
          select Model, Revenue as Actual, Forecast from numbered, guesses
          where back <= cut and back > cut - {pt.HORIZON})""",
    ),
}
