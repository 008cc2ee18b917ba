"""Registered queries: attribution, viewer queries and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwise.functions.columns import settled
from tillwise.functions.lineage import cut_lineage
from tillwise.operators import attribution as at
from tillwise.operators import behaviour as be
from tillwise.operators import diagnostics as di
from tillwise.operators import metrics as me
from tillwise.operators import models as mo
from tillwise.operators import report as rp
from tillwise.operators import segments as sg
from tillwise.operators import viewer as vi
from tillwise.operators.cleaning import trim_headers
from tillwise.operators.preparation import scaled_matrix
from tillwise.plans import models as pm
from tillwise.plans import segments as ps
from tillwise.plans import series as pt
from tillwise.plans.inputs import kept_features, lines, raw, scored, scored_rows
from tillwise.plans.oracle import r, ra, rounded, with_tables
from tillwise.plans.preparation import matrix_sql

COLUMNS = mo.MODEL_FEATURES


def attributed(spark, folder):
    return attributed_rows(kept_features(spark, folder))


def attributed_rows(features):
    """Scaled features with contributions weighted by each feature's correlation to the label."""
    matrix = cut_lineage(scaled_matrix(features, keep=["Customer_ID", "RetentionLabel"]))
    weights = matrix.agg(
        *[F.coalesce(be.pearson(c, "RetentionLabel"), F.lit(0.0)).alias(c) for c in COLUMNS]
    )
    return cut_lineage(at.contributions(matrix, weights, COLUMNS))


def logistic_attribution(spark, folder):
    """Mean contributions of the fitted logistic model over the test customers."""
    rows = pm.rows(spark, folder)
    model = mo.CLASSIFIERS["LogisticRegression"]().fit(mo.train_rows(rows))
    weights = at.model_weights(spark, COLUMNS, model.coefficients.toArray())
    return at.mean_attribution(at.contributions(mo.test_rows(rows), weights, COLUMNS), COLUMNS)


def tree_importances(spark, folder):
    """Importances of two tree models side by side."""
    train = mo.train_rows(pm.rows(spark, folder))
    forest = mo.CLASSIFIERS["RandomForest"]().fit(train)
    tree = mo.CLASSIFIERS["DecisionTree"]().fit(train)
    return at.importances(spark, COLUMNS, forest, "ForestImportance").join(
        at.importances(spark, COLUMNS, tree, "TreeImportance"), "Feature"
    )


def permuted(spark, folder):
    rows = pm.rows(spark, folder)
    forest = mo.CLASSIFIERS["RandomForest"]().fit(mo.train_rows(rows))
    return at.permutation_importance(forest, mo.test_rows(rows), COLUMNS, "RetentionLabel")


def by_setting(spark, folder):
    """Mean score per setting value, best five first."""
    means = pm.neighbour_trials(spark, folder).groupBy("k").agg(F.avg("MeanScore").alias("MeanScore"))
    return settled(vi.top_rows(means, "MeanScore", ["k"], 5))


def text_lines(spark, folder):
    return trim_headers(raw(spark, folder)).select("Invoice", "StockCode", "Description", "Country")


def forecast_metrics(spark, folder):
    return cut_lineage(me.forecast_metrics(pt.baseline_forecasts(spark, folder)))


def picked_cases(spark, folder):
    """The contributions of the picked customers; cases and contributions come from the same feature rows."""
    features = kept_features(spark, folder)
    cases = at.pick_cases(scored_rows(features))
    return settled(at.case_contributions(attributed_rows(features), cases, COLUMNS), 5)


def clv_row(features):
    rows = cut_lineage(scored_rows(features))
    errors = me.regression_metrics(rows).select("RMSE", "R2")
    top = di.lift_table(rows).where(F.col("TopCustomer_Pct") == 10).select("RevenueCapture_Pct")
    return errors.join(F.broadcast(top)).withColumn("Model", F.lit("Last 90 days"))


def best_segment(features):
    return rp.segment_rows(ps.named_segments(cut_lineage(sg.rule_clusters(features)))).limit(1)


def best_forecast(spark, folder):
    return rp.best_model_row(forecast_metrics(spark, folder))


def kpis(spark, folder):
    features = kept_features(spark, folder)
    return settled(
        rp.kpi_cards(
            [
                rp.cards(
                    clv_row(features),
                    "CLV Prediction",
                    {"Model": "Final CLV Model", "R2": "CLV R2", "RMSE": "CLV RMSE", "RevenueCapture_Pct": "Top 10% Revenue Capture"},
                ),
                rp.cards(
                    best_segment(features),
                    "Customer Segmentation",
                    {
                        "SegmentName": "High-Value Segment",
                        "FutureRevenueShare_Pct": "High-Value Segment Revenue Share",
                        "CustomerShare_Pct": "High-Value Segment Customer Share",
                    },
                ),
                rp.cards(
                    best_forecast(spark, folder),
                    "Revenue Forecasting",
                    {"Model": "Best Forecast Model", "WAPE_Pct": "Forecast WAPE"},
                ),
            ]
        ),
        4,
    )


def report_metrics(spark, folder):
    features = kept_features(spark, folder)
    return settled(
        rp.kpi_cards(
            [
                rp.report_row(clv_row(features), "CLV Prediction", "Model", ("RMSE", "RMSE"), ("R2", "R2")),
                rp.report_row(
                    best_segment(features),
                    "Customer Segmentation",
                    "SegmentName",
                    ("High-value customer share", "CustomerShare_Pct"),
                    ("High-value future revenue share", "FutureRevenueShare_Pct"),
                ),
                rp.report_row(
                    best_forecast(spark, folder), "Revenue Forecasting", "Model", ("WAPE", "WAPE_Pct"), ("RMSE", "RMSE")
                ),
            ]
        ),
        4,
    )


def first_lines(spark, folder):
    order = ["InvoiceDate", "Invoice", "StockCode", "Quantity", "Price", "Description"]
    frame = lines(spark, folder).select("Customer_ID", *order)
    return vi.first_per_key(frame, "Customer_ID", order)


def lift_row(spark, folder):
    table = di.lift_table(scored(spark, folder))
    return settled(table.where(F.col("TopCustomer_Pct") == 20), 4)


QUERIES = {
    "att01_feature_frame": lambda s, d: settled(at.feature_frame(kept_features(s, d))),
    "att02_mean_attribution": lambda s, d: settled(at.mean_attribution(attributed(s, d), COLUMNS)),
    "att02_logistic_attribution": logistic_attribution,
    "att03_case_contributions": picked_cases,
    "att04_dependence": lambda s, d: settled(at.dependence(attributed(s, d), COLUMNS), 5),
    "att05_tree_importances": tree_importances,
    "att06_permutation_importance": permuted,
    "vue01_systematic_sample": lambda s, d: settled(
        vi.systematic_sample(
            kept_features(s, d, "Recency", "Monetary"), [F.col("Customer_ID")], 300
        )
    ),
    "vue02_rows_with_numbers": lambda s, d: vi.rows_with_numbers(text_lines(s, d), ["Invoice"]),
    "vue02_codes_are_no_numbers": lambda s, d: vi.rows_with_numbers(
        text_lines(s, d).withColumn("StockCode", F.regexp_replace("StockCode", "^p([0-9]*[02468])$", "$1")), ["StockCode"]
    ),
    "vue03_first_per_key": first_lines,
    "vue04_average_categories": lambda s, d: settled(
        vi.average_categories(trim_headers(raw(s, d)), "Country", ["Customer_ID", "Quantity", "Price"]), 4
    ),
    "vue05_search_any_column": lambda s, d: vi.search(text_lines(s, d), "GEAR"),
    "vue05_search_one_column": lambda s, d: vi.search(text_lines(s, d), "post", ["StockCode"]),
    "vue06_filter_customers": lambda s, d: settled(
        vi.filter_customers(ps.segmented(s, d), sg.BEST, 1000.0, 60).select(
            "Customer_ID", "SegmentName", "Monetary", "Recency"
        )
    ),
    "vue07_top_trials": lambda s, d: settled(
        vi.top_rows(pm.neighbour_trials(s, d).where(F.col("Model") == "KNN"), "MeanScore", ["k"], 5)
    ),
    "vue09_lift_row": lift_row,
    "vue10_column_kinds": lambda s, d: vi.column_kinds(text_lines(s, d)),
    "vue11_score_by_setting": by_setting,
    "rep01_best_model_row": lambda s, d: settled(best_forecast(s, d), 4, MSE=0),
    "rep02_segment_rows": lambda s, d: settled(rp.segment_rows(ps.named(s, d)), 4),
    "rep03_kpi_cards": kpis,
    "rep04_report_metrics": report_metrics,
}

ATTRIBUTED = ",\n".join(
    [
        matrix_sql(name="matrix"),
        "weights as (select "
        + ", ".join(
            f"avg({c}) as m_{c}, coalesce(case when isnan(corr({c}, RetentionLabel)) then 0 else corr({c}, RetentionLabel) end, 0) as b_{c}"
            for c in COLUMNS
        )
        + " from matrix)",
        "given as (select Customer_ID, "
        + ", ".join(f"{c}, b_{c} * ({c} - m_{c}) as a_{c}" for c in COLUMNS)
        + " from matrix, weights)",
        "mean_given as ("
        + " union all ".join(f"select '{c}' as Feature, avg(abs(a_{c})) as m from given" for c in COLUMNS)
        + ")",
        "long_given as ("
        + " union all ".join(
            f"select Customer_ID, '{c}' as Feature, {c} as Value, a_{c} as Attribution from given" for c in COLUMNS
        )
        + ")",
    ]
)
CASES = """
cases as (
  select 'highest_score' as "Case", (select Customer_ID from scored order by Score desc, Customer_ID limit 1) as Customer_ID
  union all select 'lowest_score', (select Customer_ID from scored order by Score, Customer_ID limit 1)
  union all select 'false_positive', (select min(Customer_ID) from scored where Decision = 1 and Label = 0)
  union all select 'false_negative', (select min(Customer_ID) from scored where Decision = 0 and Label = 1))
"""
_FRAME_INTS = "Frequency UniqueProducts Recency LifetimeDays IsNewCustomer PurchasesLast30Days PurchasesLast90Days PurchasesPrior90Days"
_FRAME = [
    "Monetary", "AvgBasketValue", "AvgQuantity", "PurchaseRate", "RecencyFrequency", "RevenuePerDay",
    "AvgSpendPerProduct", "ProductDiversityRate", "StdGapDays", "SpendLast30Days", "SpendLast90Days",
    "SpendPrior90Days", "SpendTrendRatio", "FrequencyLast90DaysRatio", "ReturnRate", "CancellationRate",
]
_SEGMENT_DOUBLES = (
    "CustomerShare_Pct FutureRevenueShare_Pct RetentionRate_Pct ZeroFutureSpendRate_Pct AvgFutureSpend90Days "
    "AvgRecency AvgFrequency AvgMonetary"
)
BEST_FORECAST = f"""
best_forecast as (
  select {pt._METRICS} from matched group by Model order by sqrt(avg(pow(Actual - Forecast, 2))), Model limit 1)
"""
CLV = """
clv as (
  select sqrt(avg((Actual - Predicted) * (Actual - Predicted))) as RMSE,
    1 - sum((Actual - Predicted) * (Actual - Predicted)) / (count(*) * var_pop(Actual)) as R2,
    (select sum(Actual) filter (rn <= cast(floor(n * 0.1::double) as bigint)) / sum(Actual) * 100
     from (select Actual, row_number() over (order by Predicted desc, Customer_ID) as rn, count(*) over () as n from scored)) as Capture
  from scored),
best_segment as (select * from named order by AvgFutureSpend90Days desc, Cluster limit 1)
"""


def report_sql(body):
    return with_tables(
        "scored", body, ps.MARKED, ps.RULED, ps.PROFILE, ps.NAMED, CLV, pt.WEEKLY, pt.SPLIT, pt.BASELINES, BEST_FORECAST
    )


ORACLES = {
    "att01_feature_frame": with_tables(
        "features",
        "select Customer_ID, "
        + ", ".join(f"{r(c)} as {c}" for c in [*_FRAME_INTS.split(), *_FRAME])
        + f", {r('coalesce(AvgGapDays, (select median(AvgGapDays) from features), 0)')} as AvgGapDays from features",
    ),
    "att02_mean_attribution": with_tables(
        "features", f"select Feature, {r('m')} as MeanAbsAttribution from mean_given", ATTRIBUTED
    ),
    "att03_case_contributions": with_tables(
        "scored",
        f"""select "Case", Customer_ID, Feature, {rounded('Value Attribution', 5)}
            from long_given join cases using (Customer_ID)""",
        ATTRIBUTED,
        CASES,
    ),
    "att04_dependence": with_tables(
        "features",
        f"""select Customer_ID, Feature, {rounded('Value Attribution', 5)} from long_given
            where Feature in (select Feature from mean_given order by m desc, Feature limit 5)""",
        ATTRIBUTED,
    ),
    "vue01_systematic_sample": with_tables(
        "features",
        f"""select Customer_ID, Recency, {ra('Monetary')} from (
              select *, row_number() over (order by Customer_ID) - 1 as place, count(*) over () as n from features)
            where place % greatest(1, cast(ceil(n / 300.0) as bigint)) = 0""",
    ),
    "vue02_rows_with_numbers": with_tables(
        "raw",
        """select try_cast(Invoice as double) as Invoice, StockCode, Description, Country from raw
           where try_cast(Invoice as double) is not null""",
    ),
    "vue02_codes_are_no_numbers": with_tables(
        "raw",
        """select Invoice, try_cast(Code as double) as StockCode, Description, Country from (
             select *, regexp_replace(StockCode, '^p([0-9]*[02468])$', '\\1') as Code from raw)
           where regexp_full_match(Code, '[0-9]+')""",
    ),
    "vue03_first_per_key": with_tables(
        "clean",
        """select Customer_ID, InvoiceDate, Invoice, StockCode, Quantity, Price, Description from (
             select *, row_number() over (partition by Customer_ID order by InvoiceDate, Invoice, StockCode nulls first, Quantity nulls first, Price, Description) as k
             from clean) where k = 1""",
    ),
    "vue04_average_categories": with_tables(
        "raw",
        f"""select Country, {r('avg(coalesce("Customer ID", 0))', 4)} as Customer_ID, {r('avg(coalesce(Quantity, 0))', 4)} as Quantity,
              {r('avg(coalesce(Price, 0))', 4)} as Price from raw where Country <> '' group by 1""",
    ),
    "vue05_search_any_column": with_tables(
        "raw",
        """select Invoice, StockCode, Description, Country from raw
           where contains(lower(Invoice), 'gear') or contains(lower(StockCode), 'gear')
             or contains(lower(Description), 'gear') or contains(lower(Country), 'gear')""",
    ),
    "vue05_search_one_column": with_tables(
        "raw",
        "select Invoice, StockCode, Description, Country from raw where contains(lower(StockCode), 'post')",
    ),
    "vue06_filter_customers": ps.ruled_sql(
        f"""select Customer_ID, SegmentName, {ra('Monetary')}, Recency
            from ruled join (select Cluster, SegmentName from named) using (Cluster)
            where SegmentName = '{sg.BEST}' and Monetary >= 1000 and Recency <= 60""",
        ps.PROFILE,
        ps.NAMED,
    ),
    "vue07_top_trials": pm.neighbour_trials_sql(
        f"""select Model, k, {ra('MeanScore')}, {ra('StdScore')} from (
              select * from trials where Model = 'KNN' order by MeanScore desc, k limit 5)"""
    ),
    "vue09_lift_row": with_tables(
        "scored",
        f"""select {r('20.0', 4)} as TopCustomer_Pct, k as CustomerCount, {r('c', 4)} as ActualRevenueCaptured,
              {r('c / t * 100', 4)} as RevenueCapture_Pct, {r('c / t * 100 / 20', 4)} as LiftVsRandom
            from (select k, sum(Actual) filter (rn <= k) as c, sum(Actual) as t from (
              select Actual, row_number() over (order by Predicted desc, Customer_ID) as rn,
                cast(floor(count(*) over () * 0.2::double) as bigint) as k from scored) group by k)""",
    ),
    "vue10_column_kinds": with_tables(
        "raw",
        " union all ".join(
            f"""select *, case when IsNumeric then 'numeric' else 'text' end as Kind from (
                  select *, NumericRows > 0 as IsNumeric, TextRows > 0 as IsText from (
                    select '{c}' as "Column", count(*) filter (regexp_full_match({c}, '[0-9]+')) as NumericRows,
                      count(*) filter (not regexp_full_match({c}, '[0-9]+')) as TextRows from raw))"""
            for c in ("Invoice", "StockCode", "Description", "Country")
        ),
    ),
    "vue11_score_by_setting": pm.neighbour_trials_sql(
        f"""select k, {ra('MeanScore')} from (
              select k, avg(MeanScore) as MeanScore from trials group by 1 order by 2 desc, 1 limit 5)"""
    ),
    "rep01_best_model_row": pt.week_sql(
        "select * from best_forecast", pt.SPLIT, pt.BASELINES, BEST_FORECAST
    ),
    "rep02_segment_rows": ps.ruled_sql(
        f"select Cluster, SegmentName, ClusterSize, {rounded(_SEGMENT_DOUBLES, 4)} from named", ps.PROFILE, ps.NAMED
    ),
    "rep03_kpi_cards": report_sql(
        f"""select 'CLV Prediction' as Section, 'Final CLV Model' as Title, 'Last 90 days' as Text, cast(null as double) as Number
            union all select 'CLV Prediction', 'CLV R2', null, {r('R2', 4)} from clv
            union all select 'CLV Prediction', 'CLV RMSE', null, {r('RMSE', 4)} from clv
            union all select 'CLV Prediction', 'Top 10% Revenue Capture', null, {r('Capture', 4)} from clv
            union all select 'Customer Segmentation', 'High-Value Segment', SegmentName, null from best_segment
            union all select 'Customer Segmentation', 'High-Value Segment Revenue Share', null, {r('FutureRevenueShare_Pct', 4)} from best_segment
            union all select 'Customer Segmentation', 'High-Value Segment Customer Share', null, {r('CustomerShare_Pct', 4)} from best_segment
            union all select 'Revenue Forecasting', 'Best Forecast Model', Model, null from best_forecast
            union all select 'Revenue Forecasting', 'Forecast WAPE', null, WAPE_Pct from best_forecast"""
    ),
    "rep04_report_metrics": report_sql(
        f"""select 'CLV Prediction' as Module, 'Last 90 days' as Method, 'RMSE' as Metric1, {r('RMSE', 4)} as Value1,
              'R2' as Metric2, {r('R2', 4)} as Value2 from clv
            union all select 'Customer Segmentation', SegmentName, 'High-value customer share', {r('CustomerShare_Pct', 4)},
              'High-value future revenue share', {r('FutureRevenueShare_Pct', 4)} from best_segment
            union all select 'Revenue Forecasting', Model, 'WAPE', WAPE_Pct, 'RMSE', RMSE from best_forecast"""
    ),
}
