"""Common table expressions the comparison SQL of the queries starts from."""

from __future__ import annotations

from tillwise.functions.columns import HALF

CUTOFF = "2001-04-01"

RAW = """
base as (
  select o.o_orderkey, o.o_custkey, o.o_orderdate, l.l_partkey, l.l_quantity, l.l_extendedprice,
         l.l_returnflag, case when n.n_nationkey % 13 <> 5 then n.n_name end as n_name, p.p_name
  from lineitem l join orders o on l.l_orderkey = o.o_orderkey
  join customer c on o.o_custkey = c.c_custkey
  join nation n on c.c_nationkey = n.n_nationkey
  join part p on l.l_partkey = p.p_partkey),
raw_once as (
  select o_orderkey, o_orderdate,
    concat(case when o_orderkey % 37 = 0 then 'C' else '' end, cast(o_orderkey as varchar)) as Invoice,
    case when l_partkey % 53 = 0 then ' post ' when l_partkey % 61 = 0 then null
         when l_partkey % 59 = 0 then concat(cast(l_partkey as varchar), 'D') when l_partkey % 67 = 0 then 'NaN'
         else concat('p', cast(l_partkey as varchar)) end as StockCode,
    p_name as Description,
    cast(case when l_partkey % 89 = 0 then null when o_orderkey % 37 = 0 or (l_returnflag = 'R' and l_partkey % 11 = 0)
              then -l_quantity else l_quantity end as int) as Quantity,
    o_orderdate + to_seconds(cast(o_orderkey * 7919 % 86400 as int)) as InvoiceDate,
    case when l_partkey % 97 = 0 then cast(0 as double)
         else floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 end as Price,
    case when o_custkey % 41 = 0 then cast(null as double) else cast(o_custkey as double) end as "Customer ID",
    lower(n_name) as Country
  from base),
raw as (
  select * from raw_once
  union all
  select * from raw_once where o_orderkey % 29 = 0)
"""

TIDY = """
tidy as (
  select Invoice, upper(trim(StockCode)) as StockCode, Description, Quantity, InvoiceDate, Price,
         cast(cast("Customer ID" as bigint) as varchar) as Customer_ID,
         array_to_string(list_transform(string_split(lower(trim(Country)), ' '),
                                        lambda w: upper(w[1]) || w[2:]), ' ') as Country
  from raw)
"""

CLEAN = """
clean as (
  select *, coalesce(starts_with(Invoice, 'C'), false) as IsCancelled, coalesce(Quantity <= 0, false) as IsReturn,
         coalesce(StockCode in ('POST', 'DOT', 'BANK CHARGES', 'AMAZONFEE', 'MANUAL', 'CRUK'), false) as IsNonProduct,
         Quantity * Price as TransactionValue
  from (select distinct * from tidy where Customer_ID is not null) where Price > 0),
purchases as (
  select * from clean where not IsCancelled and not IsReturn and not IsNonProduct)
"""

FEATURES = f"""
periods as (
  select timestamp '{CUTOFF}' as cutoff, timestamp '{CUTOFF}' + interval 90 day as prediction_end,
         timestamp '{CUTOFF}' - interval 180 day as active_start),
history_all as (select p.* from purchases p, periods where InvoiceDate < cutoff),
future as (select p.* from purchases p, periods where InvoiceDate >= cutoff and InvoiceDate < prediction_end),
active as (select distinct Customer_ID from history_all, periods where InvoiceDate >= active_start),
history as (select h.* from history_all h semi join active using (Customer_ID)),
invoices as (
  select Customer_ID, Invoice, min(InvoiceDate) as InvoiceDate,
         coalesce(sum(cast(TransactionValue as decimal(18,4))), 0) as InvoiceValue,
         cast(coalesce(sum(Quantity), 0) as bigint) as InvoiceQuantity,
         count(distinct StockCode) as InvoiceProducts
  from history group by Customer_ID, Invoice),
customers as (
  select Customer_ID, max(InvoiceDate) as LastPurchase, min(InvoiceDate) as FirstPurchase,
         count(distinct Invoice) as Frequency,
         cast(sum(InvoiceValue) as double) as Monetary,
         cast(sum(InvoiceValue) as double) / count(*) as AvgBasketValue,
         cast(sum(InvoiceQuantity) as double) / count(*) as AvgQuantity,
         cast(sum(InvoiceProducts) as bigint) as UniqueProducts
  from invoices group by Customer_ID),
gaps as (
  select Customer_ID, Invoice, InvoiceDate, PrevInvoiceDate,
         cast(floor(date_diff('second', PrevInvoiceDate, InvoiceDate) / 86400.0) as bigint) as GapDays
  from (select *, lag(InvoiceDate) over (partition by Customer_ID order by InvoiceDate, Invoice) as PrevInvoiceDate
        from invoices)),
gap_stats as (
  select Customer_ID, avg(GapDays) as AvgGapDays, coalesce(stddev_samp(GapDays), 0) as StdGapDays
  from gaps group by Customer_ID),
windows as (
  select Customer_ID,
    count(distinct case when InvoiceDate >= cutoff - interval 30 day then Invoice end) as PurchasesLast30Days,
    cast(coalesce(sum(cast(TransactionValue as decimal(18,4))) filter (InvoiceDate >= cutoff - interval 30 day), 0) as double) as SpendLast30Days,
    count(distinct case when InvoiceDate >= cutoff - interval 90 day then Invoice end) as PurchasesLast90Days,
    cast(coalesce(sum(cast(TransactionValue as decimal(18,4))) filter (InvoiceDate >= cutoff - interval 90 day), 0) as double) as SpendLast90Days,
    cast(coalesce(sum(cast(TransactionValue as decimal(18,4))) filter (InvoiceDate >= cutoff - interval 180 day and InvoiceDate < cutoff - interval 90 day), 0) as double) as SpendPrior90Days,
    count(distinct case when InvoiceDate >= cutoff - interval 180 day and InvoiceDate < cutoff - interval 90 day then Invoice end) as PurchasesPrior90Days
  from history, periods group by Customer_ID),
rates as (
  select Customer_ID, cast(count(*) filter (IsReturn) as double) / count(*) as ReturnRate,
         cast(count(*) filter (IsCancelled) as double) / count(*) as CancellationRate
  from clean, periods where InvoiceDate < cutoff group by Customer_ID),
labels_future as (
  select Customer_ID, cast(sum(cast(TransactionValue as decimal(18,4))) as double) as FutureSpend90Days
  from future group by Customer_ID),
features as (
  select Customer_ID, Frequency, Monetary, AvgBasketValue, AvgQuantity, UniqueProducts,
    Recency, LifetimeDays, cast(LifetimeDays <= 60 as int) as IsNewCustomer,
    Frequency / cast(LifetimeDays as double) as PurchaseRate,
    Recency / cast(Frequency as double) as RecencyFrequency,
    Monetary / LifetimeDays as RevenuePerDay,
    Monetary / UniqueProducts as AvgSpendPerProduct,
    UniqueProducts / cast(Frequency as double) as ProductDiversityRate,
    AvgGapDays, StdGapDays, PurchasesLast30Days, SpendLast30Days, PurchasesLast90Days, SpendLast90Days,
    SpendPrior90Days, PurchasesPrior90Days,
    SpendLast90Days / (SpendPrior90Days + 1) as SpendTrendRatio,
    PurchasesLast90Days / cast(PurchasesPrior90Days + 1 as double) as FrequencyLast90DaysRatio,
    ReturnRate, CancellationRate, coalesce(FutureSpend90Days, 0) as FutureSpend90Days,
    cast(case when FutureSpend90Days is null then 0 else 1 end as bigint) as RetentionLabel
  from (
    select *,
      cast(floor(date_diff('second', LastPurchase, cutoff) / 86400.0) as bigint) as Recency,
      greatest(1, cast(floor(date_diff('second', FirstPurchase, LastPurchase) / 86400.0) as bigint)) as LifetimeDays
    from customers, periods)
  left join gap_stats using (Customer_ID) left join windows using (Customer_ID)
  left join rates using (Customer_ID) left join labels_future using (Customer_ID))
"""

SCORED = """
scored as (
  select Customer_ID, FutureSpend90Days as Actual, SpendLast90Days as Predicted,
    cast(RetentionLabel as int) as Label,
    PurchasesLast90Days / (PurchasesLast90Days + 1 + Recency / 30.0::double) as Score,
    cast(PurchasesLast90Days / (PurchasesLast90Days + 1 + Recency / 30.0::double) >= 0.5 as int) as Decision
  from features),
diagnosed as (
  select *, Actual - Predicted as Residual, abs(Actual - Predicted) as AbsResidual,
    ln(1 + Actual) as LogActual, ln(1 + Predicted) as LogPredicted,
    ln(1 + Actual) - ln(1 + Predicted) as LogResidual, cast(Actual = 0 as int) as ActualZeroFlag
  from scored)
"""

_PARTS = {"raw": RAW, "tidy": TIDY, "clean": CLEAN, "features": FEATURES, "scored": SCORED}


def with_tables(level: str, body: str, *extra: str) -> str:
    """The body behind the expressions up to ``level`` and any extra ones."""
    names = list(_PARTS)
    parts = [_PARTS[n].strip() for n in names[: names.index(level) + 1]]
    return "with " + ",\n".join([*parts, *[e.strip() for e in extra]]) + "\n" + body.strip()


def r(expression: str, digits: int = 6) -> str:
    """The rounding both sides of a comparison use."""
    scale = float(10**digits)
    return f"floor(cast({expression} as double) * {scale!r} + {HALF}) / {scale!r}"


def ra(name: str, digits: int = 6) -> str:
    """A column rounded under its own name."""
    return f'{r(name, digits)} as {name}'


def rounded(names: str, digits: int = 6) -> str:
    return ", ".join(ra(n, digits) for n in names.split())
