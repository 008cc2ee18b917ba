"""Registered queries: customer features and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwise.functions.columns import settled
from tillwise.operators import features as fe
from tillwise.operators.preparation import impute_median
from tillwise.plans.inputs import PERIODS, features, kept_features, lines
from tillwise.plans.oracle import ra, rounded, with_tables

COUNTS = (
    "Frequency UniqueProducts Recency LifetimeDays IsNewCustomer PurchasesLast30Days "
    "PurchasesLast90Days PurchasesPrior90Days"
)
DOUBLES = (
    "Monetary AvgBasketValue AvgQuantity PurchaseRate RecencyFrequency RevenuePerDay AvgSpendPerProduct "
    "ProductDiversityRate AvgGapDays StdGapDays SpendLast30Days SpendLast90Days SpendPrior90Days "
    "SpendTrendRatio FrequencyLast90DaysRatio ReturnRate"
)


def some(*names):
    def query(spark, folder):
        return settled(features(spark, folder).select("Customer_ID", *names))

    return query


def some_sql(ints="", doubles=""):
    parts = ["Customer_ID", *ints.split()]
    if doubles:
        parts.append(rounded(doubles))
    return with_tables("features", f"select {', '.join(parts)} from features")


def history_and_future(spark, folder):
    when = F.col("InvoiceDate")
    side = F.when(PERIODS.in_history(when), "history").when(PERIODS.in_future(when), "future")
    return (
        lines(spark, folder)
        .where(fe.is_purchase())
        .withColumn("Period", side)
        .where(F.col("Period").isNotNull())
        .groupBy("Customer_ID", "Period")
        .agg(F.count(F.lit(1)).alias("Lines"), F.max("InvoiceDate").alias("LastDate"))
    )


def gap_stats(spark, folder):
    return settled(features(spark, folder).select("Customer_ID", "AvgGapDays", "StdGapDays"))


def invoice_lag(spark, folder):
    invoices = fe.purchase_invoices(lines(spark, folder), PERIODS)
    return fe.previous_invoices(invoices).select(
        "Customer_ID", "Invoice", "InvoiceDate", "PrevInvoiceDate"
    )


def invoice_gap_days(spark, folder):
    invoices = fe.purchase_invoices(lines(spark, folder), PERIODS)
    return fe.invoice_gaps(invoices).select("Customer_ID", "Invoice", "GapDays")


def active(spark, folder):
    """The two line sets of the recently active customers, by semi join."""
    bought = lines(spark, folder)
    keep = fe.active_customers(bought, PERIODS)
    when = F.col("InvoiceDate")
    return (
        bought.where(fe.is_purchase() & (when < PERIODS.day(PERIODS.prediction_days)))
        .join(keep, "Customer_ID", "left_semi")
        .groupBy("Customer_ID")
        .agg(
            F.count_if(PERIODS.in_history(when)).alias("HistoryLines"),
            F.count_if(PERIODS.in_future(when)).alias("FutureLines"),
        )
    )


QUERIES = {
    "fea01_period_bounds": lambda s, d: fe.period_bounds(lines(s, d), PERIODS),
    "fea02_history_and_future": history_and_future,
    "fea03_recently_active": active,
    "fea04_invoice_rollup": lambda s, d: settled(
        fe.active_invoices(lines(s, d), PERIODS),
        4,
    ),
    "fea05_customer_rollup": some(
        "Frequency", "Monetary", "AvgBasketValue", "AvgQuantity", "UniqueProducts"
    ),
    "fea06_recency": some("Recency"),
    "fea07_lifetime_days": some("LifetimeDays"),
    "fea08_is_new_customer": some("IsNewCustomer"),
    "fea09_purchase_rate": some("PurchaseRate"),
    "fea10_recency_frequency": some("RecencyFrequency"),
    "fea11_revenue_per_day": some("RevenuePerDay"),
    "fea12_avg_spend_per_product": some("AvgSpendPerProduct"),
    "fea13_product_diversity_rate": some("ProductDiversityRate"),
    "fea14_previous_invoice": invoice_lag,
    "fea15_invoice_gap": invoice_gap_days,
    "fea16_gap_stats": gap_stats,
    "fea17_last_30_days": some("PurchasesLast30Days", "SpendLast30Days"),
    "fea18_last_90_days": some("PurchasesLast90Days", "SpendLast90Days"),
    "fea19_prior_90_days": some("PurchasesPrior90Days", "SpendPrior90Days"),
    "fea20_spend_trend_ratio": some("SpendTrendRatio"),
    "fea21_frequency_ratio": some("FrequencyLast90DaysRatio"),
    "fea22_return_rate": some("ReturnRate"),
    "fea23_cancellation_rate": some("CancellationRate"),
    "fea24_future_spend": some("FutureSpend90Days"),
    "fea25_retention_label": some("RetentionLabel"),
    "fea26_customer_features": lambda s, d: settled(features(s, d)),
    "fea27_gap_sentinel": lambda s, d: settled(
        fe.fill_gap_with_sentinel(features(s, d)).select("Customer_ID", "AvgGapDays")
    ),
    "fea28_gap_indicator": lambda s, d: settled(
        impute_median(fe.mark_missing_gap(kept_features(s, d, "AvgGapDays")), ["AvgGapDays"]).select(
            "Customer_ID", "AvgGapDays", "AvgGapDaysMissing"
        )
    ),
    "fea29_required_columns": lambda s, d: fe.require_columns(
        fe.mark_missing_gap(features(s, d)), [*fe.FEATURES, "AvgGapDaysMissing"]
    ).select("Customer_ID", "AvgGapDaysMissing"),
    "fea30_target_summary": lambda s, d: settled(fe.target_summary(features(s, d))),
}

ORACLES = {
    "fea01_period_bounds": with_tables(
        "features",
        """select active_start as ActiveStart, cutoff as Cutoff, prediction_end as PredictionEnd,
           (select count(*) from history_all) as HistoryLines, (select count(*) from future) as FutureLines
           from periods""",
    ),
    "fea02_history_and_future": with_tables(
        "features",
        """select Customer_ID, 'history' as Period, count(*) as Lines, max(InvoiceDate) as LastDate
           from history_all group by 1
           union all
           select Customer_ID, 'future', count(*), max(InvoiceDate) from future group by 1""",
    ),
    "fea03_recently_active": with_tables(
        "features",
        """select a.Customer_ID, (select count(*) from history h where h.Customer_ID = a.Customer_ID) as HistoryLines,
           (select count(*) from future f where f.Customer_ID = a.Customer_ID) as FutureLines from active a""",
    ),
    "fea04_invoice_rollup": with_tables(
        "features",
        f"""select Customer_ID, Invoice, InvoiceDate, {ra('InvoiceValue', 4)}, InvoiceQuantity, InvoiceProducts
            from invoices""",
    ),
    "fea05_customer_rollup": some_sql("Frequency UniqueProducts", "Monetary AvgBasketValue AvgQuantity"),
    "fea06_recency": some_sql("Recency"),
    "fea07_lifetime_days": some_sql("LifetimeDays"),
    "fea08_is_new_customer": some_sql("IsNewCustomer"),
    "fea09_purchase_rate": some_sql("", "PurchaseRate"),
    "fea10_recency_frequency": some_sql("", "RecencyFrequency"),
    "fea11_revenue_per_day": some_sql("", "RevenuePerDay"),
    "fea12_avg_spend_per_product": some_sql("", "AvgSpendPerProduct"),
    "fea13_product_diversity_rate": some_sql("", "ProductDiversityRate"),
    "fea14_previous_invoice": with_tables(
        "features",
        """select Customer_ID, Invoice, InvoiceDate, lag(InvoiceDate) over
             (partition by Customer_ID order by InvoiceDate, Invoice) as PrevInvoiceDate
           from (select Customer_ID, Invoice, min(InvoiceDate) as InvoiceDate from history_all group by 1, 2)""",
    ),
    "fea15_invoice_gap": with_tables(
        "features",
        """select Customer_ID, Invoice, cast(floor(date_diff('second', lag(InvoiceDate) over
             (partition by Customer_ID order by InvoiceDate, Invoice), InvoiceDate) / 86400.0) as bigint) as GapDays
           from (select Customer_ID, Invoice, min(InvoiceDate) as InvoiceDate from history_all group by 1, 2)""",
    ),
    "fea16_gap_stats": some_sql("", "AvgGapDays StdGapDays"),
    "fea17_last_30_days": some_sql("PurchasesLast30Days", "SpendLast30Days"),
    "fea18_last_90_days": some_sql("PurchasesLast90Days", "SpendLast90Days"),
    "fea19_prior_90_days": some_sql("PurchasesPrior90Days", "SpendPrior90Days"),
    "fea20_spend_trend_ratio": some_sql("", "SpendTrendRatio"),
    "fea21_frequency_ratio": some_sql("", "FrequencyLast90DaysRatio"),
    "fea22_return_rate": some_sql("", "ReturnRate"),
    "fea23_cancellation_rate": some_sql("", "CancellationRate"),
    "fea24_future_spend": some_sql("", "FutureSpend90Days"),
    "fea25_retention_label": some_sql("RetentionLabel"),
    "fea26_customer_features": some_sql(
        f"{COUNTS} RetentionLabel", f"{DOUBLES} CancellationRate FutureSpend90Days"
    ),
    "fea27_gap_sentinel": with_tables(
        "features", f"select Customer_ID, {ra('AvgGapDays')} from "
        "(select Customer_ID, coalesce(AvgGapDays, 999) as AvgGapDays from features)"
    ),
    "fea28_gap_indicator": with_tables(
        "features",
        f"""select Customer_ID, {ra('AvgGapDays')}, AvgGapDaysMissing from (
              select Customer_ID, coalesce(AvgGapDays, (select median(AvgGapDays) from features)) as AvgGapDays,
                cast(AvgGapDays is null as int) as AvgGapDaysMissing from features)""",
    ),
    "fea29_required_columns": with_tables(
        "features",
        "select Customer_ID, cast(AvgGapDays is null as int) as AvgGapDaysMissing from features",
    ),
    "fea30_target_summary": with_tables(
        "features",
        f"""select Customers, Spenders, ZeroSpenders, {ra('MeanFutureSpend')} from (
              select count(*) as Customers, count(*) filter (FutureSpend90Days > 0) as Spenders,
                count(*) filter (FutureSpend90Days = 0) as ZeroSpenders,
                avg(FutureSpend90Days) as MeanFutureSpend from features)""",
    ),
}
