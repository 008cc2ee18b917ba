"""Registered queries: behaviour and exploratory aggregates."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tillwise.functions.columns import settled
from tillwise.operators import behaviour as be
from tillwise.operators.features import FEATURES
from tillwise.plans.inputs import features, kept_features, lines, purchases
from tillwise.plans.oracle import r, ra, rounded, with_tables

ALL_GAPS = """
first_dates as (select Customer_ID, Invoice, min(InvoiceDate) as InvoiceDate from purchases group by 1, 2),
all_gaps as (
  select * from (
    select cast(floor(date_diff('second', lag(InvoiceDate) over (partition by Customer_ID order by InvoiceDate, Invoice),
                                InvoiceDate) / 86400.0) as bigint) as GapDays from first_dates)
  where GapDays is not null)
"""
SPREAD = ("Recency", "Frequency", "Monetary", "RevenuePerDay")


def line_sample(column):
    """Lines have no id, so the sample is ordered by the md5 of the whole line."""

    def query(spark, folder):
        keyed = lines(spark, folder).select(
            F.concat_ws(
                "|", "Invoice", "StockCode", F.col("Quantity").cast("string"),
                F.col("Description"), F.date_format("InvoiceDate", "yyyyMMddHHmmss"),
            ).alias("LineKey"),
            column,
        )
        return be.trimmed_sample(keyed, column, 10000, "LineKey")

    return query


def line_sample_sql(column):
    return with_tables(
        "clean",
        f"""select LineKey, {column} from (
              select concat_ws('|', Invoice, StockCode, cast(Quantity as varchar), Description,
                               strftime(InvoiceDate, '%Y%m%d%H%M%S')) as LineKey, {column} from clean
              where {column} < (select quantile_cont({column}, 0.99) from clean))
            order by md5(LineKey), LineKey, {column} limit 10000""",
    )


QUERIES = {
    "eda01_repeat_rate": lambda s, d: settled(be.repeat_rate(purchases(s, d))),
    "eda02_gap_distribution": lambda s, d: settled(be.gap_distribution(purchases(s, d))),
    "eda03_gap_shares": lambda s, d: settled(be.gap_shares(purchases(s, d))),
    "eda04_invoices_per_month": lambda s, d: be.invoices_per_month(lines(s, d)),
    "eda05_top_countries": lambda s, d: be.top_values(lines(s, d), "Country", 10),
    "eda06_quantity_sample": line_sample("Quantity"),
    "eda06_price_sample": line_sample("Price"),
    "eda07_top_products": lambda s, d: be.top_values(lines(s, d), "Description", 10, "Product"),
    "eda08_feature_samples": lambda s, d: settled(
        be.feature_samples(kept_features(s, d, *be.EXPLORED), be.EXPLORED, 5000)
    ),
    "eda09_correlation_matrix": lambda s, d: be.correlation_matrix(kept_features(s, d, *be.EXPLORED), be.EXPLORED),
    "eda10_revenue_per_month": lambda s, d: settled(be.revenue_per_month(lines(s, d)), 2),
    "eda11_top_50_products": lambda s, d: be.top_values(lines(s, d), "Description", 50, "Product"),
    "eda12_lines_per_hour": lambda s, d: be.lines_per_hour(lines(s, d)),
    "eda13_lines_per_weekday": lambda s, d: be.lines_per_weekday(lines(s, d)),
    "eda14_label_correlations": lambda s, d: settled(
        be.label_correlations(features(s, d), FEATURES, "RetentionLabel")
    ),
    "eda15_value_counts": lambda s, d: settled(be.value_counts(features(s, d), "ReturnRate")),
    "eda16_label_profile": lambda s, d: settled(
        be.label_profile(kept_features(s, d, *SPREAD, "RetentionLabel"), SPREAD, "RetentionLabel"), 4
    ),
    "eda17_target_quantiles": lambda s, d: settled(
        be.quantiles_and_skew(kept_features(s, d, "FutureSpend90Days"), "FutureSpend90Days"), 4
    ),
    "eda18_target_histogram": lambda s, d: settled(
        be.histogram(kept_features(s, d, "FutureSpend90Days"), F.col("FutureSpend90Days"), 100), 2
    ),
    "eda18_log_target_histogram": lambda s, d: settled(
        be.histogram(kept_features(s, d, "FutureSpend90Days"), F.log1p("FutureSpend90Days"), 100), 4
    ),
    "eda19_negative_value_lines": lambda s, d: settled(
        be.negative_value_lines(lines(s, d)).select(
            "Invoice", "StockCode", "Quantity", "Price", "TransactionValue"
        ),
        4,
    ),
    "eda19_recent_customers": lambda s, d: settled(
        be.recent_customers(features(s, d)).select("Customer_ID", "Recency", "Monetary")
    ),
}


def _matrix():
    parts = []
    for a, b in combinations(be.EXPLORED, 2):
        for x, y in ((a, b), (b, a)):
            parts.append(f"{{'X': '{x}', 'Y': '{y}', 'c': corr({a}, {b})}}")
    for c in be.EXPLORED:
        parts.append(f"{{'X': '{c}', 'Y': '{c}', 'c': case when stddev_pop({c}) > 0 then 1.0::double end}}")
    return f"""select p.X as X, p.Y as Y,
        coalesce(case when not isnan(p.c) then {r('p.c', 2)} end, 0) as Correlation
        from (select unnest([{', '.join(parts)}]) as p from features)"""


def _hist(value, digits):
    return with_tables(
        "features",
        f"""select cast(Bin as int) as Bin, {r('lo + Bin * w', digits)} as BinStart, coalesce(n, 0) as Count
            from (select unnest(range(0, 100)) as Bin, lo, w from limits)
            left join (select cast(least(floor((x - lo) / w), 99) as bigint) as Bin, count(*) as n
                       from x, limits group by 1) using (Bin)""",
        f"""x as (select {value} as x from features),
            limits as (select min(x) as lo, (max(x) - min(x)) / 100.0::double as w from x)""",
    )


ORACLES = {
    "eda01_repeat_rate": with_tables(
        "clean",
        f"""select count(*) as Customers, count(*) filter (n > 1) as RepeatCustomers,
              {r('avg(cast(n > 1 as int))')} as RepeatRate
            from (select Customer_ID, count(distinct Invoice) as n from purchases group by 1)""",
    ),
    "eda02_gap_distribution": with_tables(
        "clean",
        f"""select count(*) as Count, {r('avg(GapDays)')} as Mean, {r('stddev_samp(GapDays)')} as Std,
              {r('min(GapDays)')} as Min, {r('quantile_cont(GapDays, 0.25)')} as P25,
              {r('quantile_cont(GapDays, 0.5)')} as Median, {r('quantile_cont(GapDays, 0.75)')} as P75,
              {r('quantile_cont(GapDays, 0.9)')} as P90, {r('max(GapDays)')} as Max from all_gaps""",
        ALL_GAPS,
    ),
    "eda03_gap_shares": with_tables(
        "clean",
        "select "
        + ", ".join(f"{r(f'avg(cast(GapDays <= {k} as int))')} as Within{k}" for k in be.GAP_LIMITS)
        + " from all_gaps",
        ALL_GAPS,
    ),
    "eda04_invoices_per_month": with_tables(
        "clean",
        "select strftime(InvoiceDate, '%Y-%m') as Month, count(distinct Invoice) as InvoiceCount from clean group by 1",
    ),
    "eda05_top_countries": with_tables(
        "clean", "select Country, count(*) as Count from clean group by 1 order by 2 desc, 1 limit 10"
    ),
    "eda06_quantity_sample": line_sample_sql("Quantity"),
    "eda06_price_sample": line_sample_sql("Price"),
    "eda07_top_products": with_tables(
        "clean",
        "select Description as Product, count(*) as Count from clean group by 1 order by 2 desc, 1 limit 10",
    ),
    "eda08_feature_samples": with_tables(
        "features",
        f"""select Measure, Customer_ID, {ra('Value')} from (
              select *, row_number() over (partition by Measure order by md5(Customer_ID), Customer_ID) as k
              from (unpivot (select Customer_ID, {', '.join(f'cast({c} as double) as {c}' for c in be.EXPLORED)} from features)
                    on {', '.join(be.EXPLORED)} into name Measure value Value))
            where k <= 5000""",
    ),
    "eda09_correlation_matrix": with_tables("features", _matrix()),
    "eda10_revenue_per_month": with_tables(
        "clean",
        f"""select strftime(InvoiceDate, '%Y-%m') as Month,
              {r('sum(cast(TransactionValue as decimal(18,4)))', 2)} as Revenue from clean group by 1""",
    ),
    "eda11_top_50_products": with_tables(
        "clean",
        "select Description as Product, count(*) as Count from clean group by 1 order by 2 desc, 1 limit 50",
    ),
    "eda12_lines_per_hour": with_tables(
        "clean", "select cast(hour(InvoiceDate) as int) as Hour, count(*) as Count from clean group by 1"
    ),
    "eda13_lines_per_weekday": with_tables(
        "clean",
        """select cast(isodow(InvoiceDate) - 1 as int) as DayIndex, dayname(InvoiceDate) as Day, count(*) as Count
           from clean group by 1, 2""",
    ),
    "eda14_label_correlations": with_tables(
        "features",
        " union all ".join(
            f"select '{c}' as Measure, (select case when isnan(c) then null else {r('c')} end "
            f"from (select corr({c}, RetentionLabel) as c from features)) as Correlation"
            for c in FEATURES
        ),
    ),
    "eda15_value_counts": with_tables(
        "features",
        f"select {ra('ReturnRate')}, Count from (select ReturnRate, count(*) as Count from features group by 1)",
    ),
    "eda16_label_profile": with_tables(
        "features",
        " union all ".join(
            f"""select RetentionLabel, '{c}' as Measure, {r(f'avg({c})', 4)} as Mean,
              {r(f'quantile_cont({c}, 0.25)', 4)} as P25, {r(f'quantile_cont({c}, 0.5)', 4)} as P50,
              {r(f'quantile_cont({c}, 0.75)', 4)} as P75 from features group by 1"""
            for c in SPREAD
        ),
    ),
    "eda17_target_quantiles": with_tables(
        "features",
        "select "
        + ", ".join(
            f"{r(f'quantile_cont(FutureSpend90Days, {p})', 4)} as P{int(p * 100)}"
            for p in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
        )
        + f", {r('skewness(FutureSpend90Days)', 4)} as Skew from features",
    ),
    "eda18_target_histogram": _hist("FutureSpend90Days", 2),
    "eda18_log_target_histogram": _hist("ln(1 + FutureSpend90Days)", 4),
    "eda19_negative_value_lines": with_tables(
        "clean",
        f"""select Invoice, StockCode, Quantity, Price, {ra('TransactionValue', 4)}
            from (select Invoice, StockCode, Quantity, {ra('Price', 4)}, TransactionValue from clean
                  where TransactionValue < 0)""",
    ),
    "eda19_recent_customers": with_tables(
        "features", f"select Customer_ID, Recency, {rounded('Monetary')} from features where Recency < 15"
    ),
}
