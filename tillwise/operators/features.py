"""One leakage-safe feature row per customer, with retention and future-spend labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwise.functions.columns import from_money, money, ratio, whole_days
from tillwise.functions.lineage import cut_lineage
from tillwise.operators.cleaning import require_columns

# Names and order of the columns.
FEATURES = (
    "Frequency",
    "Monetary",
    "AvgBasketValue",
    "AvgQuantity",
    "UniqueProducts",
    "Recency",
    "LifetimeDays",
    "IsNewCustomer",
    "PurchaseRate",
    "RecencyFrequency",
    "RevenuePerDay",
    "AvgSpendPerProduct",
    "ProductDiversityRate",
    "AvgGapDays",
    "StdGapDays",
    "PurchasesLast30Days",
    "SpendLast30Days",
    "PurchasesLast90Days",
    "SpendLast90Days",
    "SpendPrior90Days",
    "PurchasesPrior90Days",
    "SpendTrendRatio",
    "FrequencyLast90DaysRatio",
    "ReturnRate",
)
LABELS = ("FutureSpend90Days", "RetentionLabel")
NEW_CUSTOMER_DAYS = 60
MISSING_GAP = 999.0


@dataclass(frozen=True)
class Periods:
    """The dates that separate history, future and recent activity."""

    cutoff: str
    prediction_days: int = 90
    active_days: int = 180

    def day(self, offset: int = 0) -> Column:
        return F.lit(self.cutoff).cast("timestamp_ntz") + F.make_dt_interval(F.lit(offset))

    def in_history(self, when: Column) -> Column:
        return when < self.day()

    def in_future(self, when: Column) -> Column:
        return (when >= self.day()) & (when < self.day(self.prediction_days))

    def in_last(self, when: Column, days: int) -> Column:
        return (when >= self.day(-days)) & (when < self.day())

    def in_prior_90(self, when: Column) -> Column:
        return (when >= self.day(-180)) & (when < self.day(-90))


def is_purchase() -> Column:
    return ~F.col("IsCancelled") & ~F.col("IsReturn") & ~F.col("IsNonProduct")


def period_bounds(lines: DataFrame, periods: Periods) -> DataFrame:
    """The period limits next to the number of purchase lines on either side."""
    when = F.col("InvoiceDate")
    return lines.where(is_purchase()).agg(
        F.first(periods.day(-periods.active_days)).alias("ActiveStart"),
        F.first(periods.day()).alias("Cutoff"),
        F.first(periods.day(periods.prediction_days)).alias("PredictionEnd"),
        F.count_if(periods.in_history(when)).alias("HistoryLines"),
        F.count_if(periods.in_future(when)).alias("FutureLines"),
    )


def invoice_rollup(lines: DataFrame, periods: Periods) -> DataFrame:
    """One row per customer and invoice, carrying every measure the customer row needs.

    All time windows are conditional sums of this one pass. Lines that were dealt by customer
    and invoice stay where they are; the lines of a customer never meet in one task. A product is
    counted at its first bought line in the order of the codes, which clean lines already have.
    """
    when, value, count = F.col("InvoiceDate"), money(F.col("TransactionValue")), F.lit(1)
    bought = is_purchase() & periods.in_history(when)
    same_code = W.partitionBy("Customer_ID", "Invoice", "StockCode")
    earlier = F.max(F.when(bought, 1)).over(same_code.rowsBetween(W.unboundedPreceding, -1))
    product = bought & F.col("StockCode").isNotNull() & F.col("_earlier").isNull()
    ahead = is_purchase() & periods.in_future(when)

    def spend(condition: Column) -> Column:
        return F.sum(F.coalesce(F.when(condition, value), F.lit(0).cast("bigint")))

    def seen(condition: Column) -> Column:
        return F.max(F.when(condition, 1).otherwise(0)).cast("bigint")

    last30 = bought & periods.in_last(when, 30)
    last90 = bought & periods.in_last(when, 90)
    prior90 = bought & periods.in_prior_90(when)
    return (
        lines.where(when < periods.day(periods.prediction_days))
        .withColumn("_earlier", earlier)
        .groupBy("Customer_ID", "Invoice")
        .agg(
            F.min(F.when(bought, when)).alias("InvoiceDate"),
            F.max(F.when(bought, when)).alias("LastLine"),
            spend(bought).alias("InvoiceValue"),
            F.sum(F.coalesce(F.when(bought, F.col("Quantity")), F.lit(0))).alias("InvoiceQuantity"),
            F.count_if(product).alias("InvoiceProducts"),
            seen(last30).alias("In30"),
            spend(last30).alias("Spend30"),
            seen(last90).alias("In90"),
            spend(last90).alias("Spend90"),
            seen(prior90).alias("InPrior90"),
            spend(prior90).alias("SpendPrior90"),
            F.count(F.when(periods.in_history(when), count)).alias("HistoryLines"),
            F.count_if(periods.in_history(when) & F.col("IsReturn")).alias("ReturnedLines"),
            F.count_if(periods.in_history(when) & F.col("IsCancelled")).alias("CancelledLines"),
            spend(ahead).alias("FutureSpend"),
            seen(ahead).alias("FutureBought"),
        )
    )


def purchase_invoices(lines: DataFrame, periods: Periods) -> DataFrame:
    """Invoice rollup of the history: first date, value, quantity and distinct products."""
    return _shown(invoice_rollup(lines, periods).where(F.col("InvoiceDate").isNotNull()))


def active_invoices(lines: DataFrame, periods: Periods) -> DataFrame:
    """The purchase invoices of recently active customers."""
    invoices = cut_lineage(invoice_rollup(lines, periods).where(F.col("InvoiceDate").isNotNull()))
    active = (
        invoices.where(F.col("LastLine") >= periods.day(-periods.active_days))
        .select("Customer_ID")
        .distinct()
    )
    return _shown(invoices.join(active, "Customer_ID", "left_semi"))


def _shown(invoices: DataFrame) -> DataFrame:
    return invoices.select(
        "Customer_ID",
        "Invoice",
        "InvoiceDate",
        from_money(F.col("InvoiceValue")).alias("InvoiceValue"),
        "InvoiceQuantity",
        "InvoiceProducts",
    )


def gaps_between(invoices: DataFrame) -> DataFrame:
    """Every inter-purchase gap, counted: one row per customer, day and gap length.

    Invoices of one day are never a whole day apart, so a day with n invoices holds n-1
    gaps of zero; only the step from the previous purchase day needs an ordered window, and
    that window has at most one row per calendar day however many invoices a customer has.
    """
    days = (
        invoices.where(F.col("InvoiceDate").isNotNull())
        .groupBy("Customer_ID", F.to_date("InvoiceDate").alias("Day"))
        .agg(
            F.count(F.lit(1)).alias("Invoices"),
            F.min("InvoiceDate").alias("FirstTime"),
            F.max("InvoiceDate").alias("LastTime"),
        )
    )
    by_day = W.partitionBy("Customer_ID").orderBy("Day")
    step = whole_days(F.lag("LastTime").over(by_day), F.col("FirstTime"))
    return (
        days.withColumn("Step", step)
        .select(
            "Customer_ID",
            "Day",
            F.explode(
                F.array(
                    F.struct(F.lit(0).cast("bigint").alias("GapDays"), (F.col("Invoices") - 1).alias("Gaps")),
                    F.struct(
                        F.col("Step").alias("GapDays"),
                        F.when(F.col("Step").isNull(), 0).otherwise(1).cast("bigint").alias("Gaps"),
                    ),
                )
            ).alias("Gap"),
        )
        .select("Customer_ID", "Day", "Gap.*")
        .where(F.col("Gaps") > 0)
    )


def previous_invoices(invoices: DataFrame) -> DataFrame:
    """Each invoice with the previous invoice date of its customer.

    The order within a day is kept by a window per customer and day; the first invoice of a
    day takes the last time of the customer's previous purchase day.
    """
    keyed = invoices.withColumn("Day", F.to_date("InvoiceDate"))
    by_day = W.partitionBy("Customer_ID").orderBy("Day")
    days = (
        keyed.groupBy("Customer_ID", "Day")
        .agg(F.max("InvoiceDate").alias("LastTime"))
        .select("Customer_ID", "Day", F.lag("LastTime").over(by_day).alias("Earlier"))
    )
    inside = W.partitionBy("Customer_ID", "Day").orderBy("InvoiceDate", "Invoice")
    return (
        keyed.withColumn("_previous", F.lag("InvoiceDate").over(inside))
        .join(days, ["Customer_ID", "Day"])
        .withColumn("PrevInvoiceDate", F.coalesce("_previous", "Earlier"))
        .drop("_previous", "Earlier", "Day")
    )


def invoice_gaps(invoices: DataFrame) -> DataFrame:
    return previous_invoices(invoices).withColumn(
        "GapDays", whole_days(F.col("PrevInvoiceDate"), F.col("InvoiceDate"))
    )


def customer_rollup(lines: DataFrame, periods: Periods) -> DataFrame:
    """Plain sums per recently active customer, before any ratio is taken.

    The invoices of a customer are summed per purchase day first; the day rows give the
    gaps and then the customer row, so one customer with a third of all invoices costs no
    task more than one row per day.
    """
    invoices = invoice_rollup(lines, periods)
    bought = F.col("InvoiceDate").isNotNull()
    added = (
        "InvoiceValue",
        "InvoiceQuantity",
        "InvoiceProducts",
        "In30",
        "Spend30",
        "In90",
        "Spend90",
        "InPrior90",
        "SpendPrior90",
        "HistoryLines",
        "ReturnedLines",
        "CancelledLines",
        "FutureSpend",
    )
    days = invoices.groupBy("Customer_ID", F.to_date("InvoiceDate").alias("Day")).agg(
        F.count_if(bought).alias("Invoices"),
        F.min("InvoiceDate").alias("FirstTime"),
        F.max("InvoiceDate").alias("LastTime"),
        F.max("LastLine").alias("LastLine"),
        *[F.sum(c).alias(c) for c in added],
        F.max("FutureBought").alias("FutureBought"),
    )
    by_day = W.partitionBy("Customer_ID").orderBy("Day")
    step = whole_days(F.lag("LastTime").over(by_day), F.col("FirstTime"))
    customers = (
        days.withColumn("Step", step)
        .groupBy("Customer_ID")
        .agg(
            F.sum("Invoices").alias("Invoices"),
            F.min("FirstTime").alias("FirstPurchase"),
            F.max("LastTime").alias("LastPurchase"),
            F.max("LastLine").alias("LastLine"),
            *[F.sum(c).alias(c) for c in added],
            F.max("FutureBought").alias("FutureBought"),
            F.sum("Step").alias("GapSum"),
            F.sum(F.col("Step") * F.col("Step")).alias("GapSquares"),
        )
    )
    return customers.where(F.col("LastLine") >= periods.day(-periods.active_days))


def active_customers(lines: DataFrame, periods: Periods) -> DataFrame:
    """Customers with a purchase in the last active days before the cutoff."""
    when = F.col("InvoiceDate")
    return (
        lines.where(is_purchase() & periods.in_last(when, periods.active_days))
        .select("Customer_ID")
        .distinct()
    )


def customer_features(lines: DataFrame, periods: Periods) -> DataFrame:
    """The full feature row and both labels from clean lines, one row per active customer."""
    customers = customer_rollup(lines, periods)
    col = F.col
    orders, gaps = col("Invoices"), col("Invoices") - 1
    monetary = from_money(col("InvoiceValue"))
    lifetime = F.greatest(F.lit(1), whole_days(col("FirstPurchase"), col("LastPurchase")))
    spread = (gaps * col("GapSquares") - col("GapSum") * col("GapSum")).cast("double")
    rows = customers.select(
        "Customer_ID",
        orders.alias("Frequency"),
        monetary.alias("Monetary"),
        ratio(monetary, orders).alias("AvgBasketValue"),
        ratio(col("InvoiceQuantity"), orders).alias("AvgQuantity"),
        col("InvoiceProducts").alias("UniqueProducts"),
        whole_days(col("LastPurchase"), periods.day()).alias("Recency"),
        lifetime.alias("LifetimeDays"),
        ratio(col("GapSum"), gaps).alias("AvgGapDays"),
        F.coalesce(F.sqrt(ratio(spread, gaps * (gaps - 1))), F.lit(0.0)).alias("StdGapDays"),
        col("In30").alias("PurchasesLast30Days"),
        from_money(col("Spend30")).alias("SpendLast30Days"),
        col("In90").alias("PurchasesLast90Days"),
        from_money(col("Spend90")).alias("SpendLast90Days"),
        from_money(col("SpendPrior90")).alias("SpendPrior90Days"),
        col("InPrior90").alias("PurchasesPrior90Days"),
        ratio(col("ReturnedLines"), col("HistoryLines")).alias("ReturnRate"),
        ratio(col("CancelledLines"), col("HistoryLines")).alias("CancellationRate"),
        from_money(col("FutureSpend")).alias("FutureSpend90Days"),
        col("FutureBought").alias("RetentionLabel"),
    )
    return rows.withColumns(
        {
            "IsNewCustomer": (col("LifetimeDays") <= NEW_CUSTOMER_DAYS).cast("int"),
            "PurchaseRate": ratio(col("Frequency"), col("LifetimeDays")),
            "RecencyFrequency": ratio(col("Recency"), col("Frequency")),
            "RevenuePerDay": ratio(col("Monetary"), col("LifetimeDays")),
            "AvgSpendPerProduct": ratio(col("Monetary"), col("UniqueProducts")),
            "ProductDiversityRate": ratio(col("UniqueProducts"), col("Frequency")),
            "SpendTrendRatio": ratio(col("SpendLast90Days"), col("SpendPrior90Days") + 1),
            "FrequencyLast90DaysRatio": ratio(
                col("PurchasesLast90Days"), col("PurchasesPrior90Days") + 1
            ),
        }
    ).select("Customer_ID", *FEATURES, "CancellationRate", *LABELS)


def retention_dataset(lines: DataFrame, periods: Periods) -> DataFrame:
    return customer_features(lines, periods).select("Customer_ID", *FEATURES, "RetentionLabel")


def spend_dataset(lines: DataFrame, periods: Periods) -> DataFrame:
    return customer_features(lines, periods).select("Customer_ID", *FEATURES, "FutureSpend90Days")


def fill_gap_with_sentinel(features: DataFrame) -> DataFrame:
    return features.withColumn("AvgGapDays", F.coalesce("AvgGapDays", F.lit(MISSING_GAP)))


def mark_missing_gap(features: DataFrame) -> DataFrame:
    require_columns(features, ["AvgGapDays"])
    return features.withColumn("AvgGapDaysMissing", F.col("AvgGapDays").isNull().cast("int"))


def target_summary(features: DataFrame) -> DataFrame:
    spend = F.col("FutureSpend90Days")
    return features.agg(
        F.count(F.lit(1)).alias("Customers"),
        F.count_if(spend > 0).alias("Spenders"),
        F.count_if(spend == 0).alias("ZeroSpenders"),
        F.avg(spend).alias("MeanFutureSpend"),
    )
