"""Registered queries: revenue series and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.functions.columns import settled
from tillwise.functions.lineage import cut_lineage
from tillwise.operators import autoregression as ar
from tillwise.operators import moving_average as ma
from tillwise.operators import forecasting as fo
from tillwise.operators import metrics as me
from tillwise.operators import series as se
from tillwise.operators import smoothing as sm
from tillwise.operators.cleaning import strict_purchases
from tillwise.operators.viewer import horizon_slice
from tillwise.plans.inputs import lines
from tillwise.plans.oracle import r, ra, rounded, with_tables

HORIZON = 12
LONG_HORIZON = 323  # longer than what many countries have


def weekly(spark: SparkSession, folder: str, by: tuple[str, ...] = ()) -> DataFrame:
    return se.weekly_series(strict_purchases(lines(spark, folder)), by)


def monthly(spark: SparkSession, folder: str) -> DataFrame:
    return se.monthly_series(strict_purchases(lines(spark, folder)))


def split_series(spark, folder, by=()):
    parts = cut_lineage(se.holdout_rows(weekly(spark, folder, by), HORIZON, by))
    return parts.where(F.col("Split") == "train"), parts.where(F.col("Split") == "test")


def baseline_forecasts(spark, folder):
    """Holdout weeks with the forecast of every baseline, one row per model and week."""
    train, test = split_series(spark, folder)
    return se.match_actuals(se.baselines(train, HORIZON), test)


def naive(spark, folder):
    train, _ = split_series(spark, folder)
    return settled(se.naive_forecast(train, HORIZON), 4)


def moving_averages(spark, folder):
    train, _ = split_series(spark, folder)
    frame = se.moving_average_forecast(train, HORIZON, se.ROLLING[0])
    for window in se.ROLLING[1:]:
        frame = frame.unionByName(se.moving_average_forecast(train, HORIZON, window))
    return settled(frame, 4)


def smoothed(fit):
    def query(spark, folder):
        train, test = split_series(spark, folder)
        return settled(se.match_actuals(fit(train), test), 2)

    return query


def seasonal_both(train):
    return sm.seasonal_smoothing(train, HORIZON, 4).unionByName(
        sm.seasonal_smoothing(train, HORIZON, 13)
    )


def smoothed_countries(spark, folder):
    """The same fit for one series per country, all at once."""
    by = ("Country",)
    train, test = split_series(spark, folder, by)
    return settled(se.match_actuals(sm.simple_smoothing(train, HORIZON, by), test, by), 2)


def autoregressive(spark, folder):
    train, _ = split_series(spark, folder)
    return settled(ar.autoregressive_candidates(train, HORIZON), 2)


def autoregressive_best(spark, folder):
    train, test = split_series(spark, folder)
    return settled(ar.best_order(ar.autoregressive_candidates(train, HORIZON), test), 2)


def seasonal(spark, folder):
    train, _ = split_series(spark, folder)
    return settled(ar.seasonal_candidates(train, HORIZON), 2)


def smoothing_grid(spark, folder):
    """Squared error of simple smoothing at every weight of the grid."""
    train, _ = split_series(spark, folder)
    return settled(sm.grid_errors(train, "simple").select(F.col("Weights")[0].alias("Weight"), "SSE"))


def trend_grid(spark, folder):
    """Squared error of trend smoothing at every pair of weights of the grid."""
    train, _ = split_series(spark, folder)
    weights = [F.col("Weights")[k].alias(name) for k, name in enumerate(("Level", "Trend"))]
    return settled(sm.grid_errors(train, "trend").select(*weights, "SSE"))


def smoothed_by_country(fit):
    by = ("Country",)

    def query(spark, folder):
        train, test = split_series(spark, folder, by)
        return settled(se.match_actuals(fit(train, by), test, by), 2)

    return query


def moving_average(orders):
    def query(spark, folder):
        train, _ = split_series(spark, folder)
        return settled(ma.forecasts(train, HORIZON, orders), 2)

    return query


def moving_average_best(spark, folder):
    train, test = split_series(spark, folder)
    both = ma.forecasts(train, HORIZON, ma.ORDERS).unionByName(ma.forecasts(train, HORIZON, ma.SEASONAL_ORDERS))
    return settled(ar.best_order(both, test), 2)


def moving_average_grid(spark, folder):
    """The best point of the coarse grid per order, before it is refined."""
    train, _ = split_series(spark, folder)
    shown = F.array_join(F.transform("Coefficients", lambda c: F.format_string("%.1f", c)), ",")
    return settled(ma.fits(train, HORIZON, ma.ORDERS, refine=False).select("Order", shown.alias("Coefficients"), "SSE"))


def lag_models(spark, folder):
    rows = cut_lineage(weekly(spark, folder))
    forest, boosted = fo.MODELS
    return fo.lag_model_forecast(rows, HORIZON, forest).unionByName(
        fo.lag_model_forecast(rows, HORIZON, boosted)
    )


def recursive(spark, folder):
    rows = cut_lineage(weekly(spark, folder))
    fitted = fo.fit_lag_model(se.lag_features(rows), "Boosted_Lag")
    return fo.recursive_forecast(rows, fitted, HORIZON)


def raw_forecast(spark, folder):
    """A forecast with the defects cleaning has to deal with: week-on-week growth rates.

    A zero week makes the rate infinite or undefined; falls are negative; one week is
    missing at the end.
    """
    train, _ = split_series(spark, folder)
    order = se.per_series(()).orderBy(F.col("Date").desc())
    back = train.withColumns(
        {"Step": F.row_number().over(order), "_next": F.lead("Revenue").over(order)}
    ).where(F.col("Step") <= HORIZON - 1)
    rate = F.when(F.col("_next") == 0, F.lit(float("inf"))).otherwise(
        F.col("Revenue") / F.nullif(F.col("_next"), F.lit(0.0)) - 1
    )
    return back.select(F.lit("Growth").alias("Model"), "Step", rate.alias("Forecast"))


def cleaned_forecast(spark, folder):
    return settled(se.clean_forecast(raw_forecast(spark, folder), HORIZON))


def back_transformed(spark, folder):
    rows = weekly(spark, folder)
    return settled(
        rows.select("Date", se.back_transform(F.log1p("Revenue") * 0.5).alias("Forecast")), 4
    )


def future(spark, folder):
    return fo.future_forecast(weekly(spark, folder), HORIZON)


def residual_rows(spark, folder):
    matched = cut_lineage(baseline_forecasts(spark, folder))
    best = fo.best_model(me.forecast_metrics(matched))
    return settled(se.forecast_residuals(matched, best).select("Model", "Date", "Residual"), 4)


def summary(spark, folder):
    bought = cut_lineage(strict_purchases(lines(spark, folder)).select(
        "Customer_ID", "Invoice", "InvoiceDate", "TransactionValue"
    ))
    return settled(se.series_summary(se.weekly_series(bought), se.monthly_series(bought), HORIZON), 2)


def rolling_origin(spark, folder):
    return settled(fo.rolling_origin_error(weekly(spark, folder), HORIZON, 3), 2)


def sliced(spark, folder):
    rows = cut_lineage(weekly(spark, folder))
    dated = se.future_dates(se.naive_forecast(rows, HORIZON), rows)
    return settled(horizon_slice(dated.drop("Step"), 4), 4)


QUERIES = {
    "tsr01_weekly_series": lambda s, d: settled(weekly(s, d), 4),
    "tsr01_weekly_by_country": lambda s, d: settled(weekly(s, d, ("Country",)), 4),
    "tsr02_monthly_series": lambda s, d: settled(monthly(s, d), 4),
    "tsr03_avg_order_value": lambda s, d: settled(weekly(s, d).select("Date", "AvgOrderValue"), 4),
    "tsr04_naive_forecast": naive,
    "tsr05_moving_average_forecast": moving_averages,
    "tsr06_simple_smoothing": smoothed(lambda train: sm.simple_smoothing(train, HORIZON)),
    "tsr06_smoothing_by_country": smoothed_countries,
    "tsr06_grid_errors": smoothing_grid,
    "tsr07_grid_errors": trend_grid,
    "tsr07_trend_smoothing": smoothed(lambda train: sm.trend_smoothing(train, HORIZON)),
    "tsr08_seasonal_smoothing": smoothed(seasonal_both),
    "tsr09_autoregressive": autoregressive,
    "tsr09_best_order": autoregressive_best,
    "tsr07_trend_by_country": smoothed_by_country(lambda train, by: sm.trend_smoothing(train, HORIZON, by)),
    "tsr08_seasonal_by_country": smoothed_by_country(lambda train, by: sm.seasonal_smoothing(train, HORIZON, 4, by)),
    "tsr09_moving_average": moving_average(ma.ORDERS),
    "tsr09_moving_average_grid": moving_average_grid,
    "tsr09_best_of_all_orders": moving_average_best,
    "tsr10_seasonal_autoregressive": seasonal,
    "tsr10_seasonal_moving_average": moving_average(ma.SEASONAL_ORDERS),
    "tsr20_rolling_models": lambda s, d: settled(fo.rolling_model_errors(weekly(s, d), HORIZON, 3), 2),
    "tsr11_lag_features": lambda s, d: settled(se.lag_features(weekly(s, d)), 3),
    "tsr12_lag_models": lag_models,
    "tsr13_recursive_forecast": recursive,
    "tsr14_clean_forecast": cleaned_forecast,
    "tsr15_back_transform": back_transformed,
    "tsr16_decomposition": lambda s, d: settled(se.decompose(weekly(s, d)), 3),
    "tsr17_future_forecast": future,
    "tsr18_forecast_residuals": residual_rows,
    "tsr19_series_summary": summary,
    "tsr20_long_enough": lambda s, d: se.long_enough(weekly(s, d, ("Country",)), HORIZON, ("Country",)),
    "tsr20_rolling_origin": rolling_origin,
    "tsr20_rejected": lambda s, d: se.split_by_length(weekly(s, d, ("Country",)), LONG_HORIZON, ("Country",))[1],
    "vue08_horizon_slice": sliced,
    "pre08_last_weeks_holdout": lambda s, d: settled(
        se.holdout_rows(weekly(s, d), HORIZON).select("Date", "Revenue", "Split"), 4
    ),
}


def series_sql(name, label, step, by=""):
    keys = f"{by}, " if by else ""
    same = "and g.{0} is not distinct from f.{0}".format(by) if by else ""
    return f"""{name}_found as (
      select {keys}{label} as Date, cast(sum(cast(TransactionValue as decimal(18,4))) as double) as Revenue,
        count(distinct Invoice) as OrderCount, count(distinct Customer_ID) as UniqueCustomers
      from purchases where Quantity > 0 and Price > 0 and TransactionValue > 0 group by all),
    {name} as (
      select {keys.replace(by, f"g.{by}") if by else ""}g.Date, coalesce(Revenue, 0) as Revenue, coalesce(OrderCount, 0) as OrderCount,
        coalesce(UniqueCustomers, 0) as UniqueCustomers, coalesce(Revenue / OrderCount, 0) as AvgOrderValue
      from (select {keys}cast(unnest(generate_series(min(Date), max(Date), interval {step})) as date) as Date
            from {name}_found {'group by ' + by if by else ''}) g
      left join {name}_found f on g.Date = f.Date {same})"""


WEEK = "cast(date_trunc('week', InvoiceDate) as date) + 6"
WEEKLY = series_sql("weekly", WEEK, "7 day")
COUNTRIES = series_sql("countries", WEEK, "7 day", "Country")
MONTHLY = series_sql("monthly", "cast(date_trunc('month', InvoiceDate) as date)", "1 month")
SPLIT = f"""
counted_back as (select *, row_number() over (order by Date desc) as back from weekly),
train as (select * exclude (back), row_number() over (order by Date) as t, row_number() over (order by Date desc) as tb
          from counted_back where back > {HORIZON}),
test as (select *, {HORIZON} + 1 - back as Step from counted_back where back <= {HORIZON})
"""
BASELINES = f"""
forecasts as (
  select Model, cast(Step as int) as Step, Forecast from (
    select 'Naive' as Model, (select Revenue from train where tb = 1) as Forecast
    union all select 'MovingAverage_4', (select avg(Revenue) from train where tb <= 4)
    union all select 'MovingAverage_8', (select avg(Revenue) from train where tb <= 8)
    union all select 'MovingAverage_12', (select avg(Revenue) from train where tb <= 12)),
  (select unnest(range(1, {HORIZON} + 1)) as Step)),
matched as (
  select Model, f.Step, Date, Revenue as Actual, Forecast from forecasts f join test on test.Step = f.Step)
"""

_SMAPE = """avg(case when abs(Actual) + abs(Forecast) <> 0
  then 2 * abs(Forecast - Actual) / (abs(Actual) + abs(Forecast)) end) * 100"""
_WAPE = "sum(abs(Actual - Forecast)) / nullif(sum(abs(Actual)), 0) * 100"
_METRICS = f"""Model, {r('sqrt(avg(pow(Actual - Forecast, 2)))', 4)} as RMSE, {r('avg(abs(Actual - Forecast))', 4)} as MAE,
  {r('avg(pow(Actual - Forecast, 2))', 0)} as MSE,
  {r('1 - sum(pow(Actual - Forecast, 2)) / (count(*) * var_pop(Actual))', 4)} as R2,
  {r(_WAPE, 4)} as WAPE_Pct, {r(_SMAPE, 4)} as sMAPE_Pct, {r('sum(Actual)', 4)} as ActualTotal,
  {r('sum(Forecast)', 4)} as PredictedTotal,
  {r('abs(sum(Actual) - sum(Forecast)) / nullif(sum(Actual), 0) * 100', 4)} as RevenueError_Pct"""

def week_sql(body, *extra):
    return with_tables("clean", body, WEEKLY, *extra)


def _lag_sql():
    parts = [
        "cast(row_number() over w - 1 as int) as TimeIndex",
        "cast(month(Date) as int) as Month",
        "cast(quarter(Date) as int) as Quarter",
        "cast(weekofyear(Date) as int) as WeekOfYear",
    ]
    parts += [f"lag(Revenue, {k}) over w as Revenue_Lag_{k}" for k in se.REVENUE_LAGS]
    for k in se.ROLLING:
        over = f"over (order by Date rows between {k} preceding and 1 preceding)"
        parts.append(f"case when count(*) {over} = {k} then avg(Revenue) {over} end as Revenue_RollingMean_{k}")
        parts.append(f"case when count(*) {over} = {k} then stddev_samp(Revenue) {over} end as Revenue_RollingStd_{k}")
    parts += [f"lag({c}, {k}) over w as {c}_Lag_{k}" for k in se.OTHER_LAGS for c in se.OTHERS]
    doubles = ["Revenue", "AvgOrderValue", *[f"Revenue_Lag_{k}" for k in se.REVENUE_LAGS]]
    for k in se.ROLLING:
        doubles += [f"Revenue_RollingMean_{k}", f"Revenue_RollingStd_{k}"]
    doubles += [f"AvgOrderValue_Lag_{k}" for k in se.OTHER_LAGS]
    whole = ["Date", "OrderCount", "UniqueCustomers", "TimeIndex", "Month", "Quarter", "WeekOfYear"]
    whole += [f"{c}_Lag_{k}" for k in se.OTHER_LAGS for c in se.OTHERS[:2]]
    return f"""select {', '.join(whole)}, {', '.join(ra(c, 3) for c in doubles)}
      from (select *, {', '.join(parts)} from weekly window w as (order by Date))
      where Revenue_RollingStd_12 is not null and Revenue_Lag_12 is not null"""


def _moments(differences):
    w = "ln(1 + Revenue) - avg(ln(1 + Revenue)) over ()" if differences == 0 else (
        "ln(1 + Revenue) - lag(ln(1 + Revenue)) over (order by t)"
    )
    return f"""d{differences}_rows as (
      select *, lag(w, 1) over (order by t) as w1, lag(w, 2) over (order by t) as w2
      from (select t, {w} as w, ln(1 + Revenue) as y, avg(ln(1 + Revenue)) over () as centre from train))"""


def _ar(p, d):
    """Coefficients, then the recursion over the horizon."""
    name = f"ar{p}{d}"
    rows = f"d{d}_rows"
    if p == 1:
        fit = f"select sum(w * w1) / sum(w1 * w1) as a1, 0.0::double as a2 from {rows} where w1 is not null and w is not null"
    else:
        fit = f"""select (r1 * s22 - r2 * s12) / (s11 * s22 - s12 * s12) as a1,
          (r2 * s11 - r1 * s12) / (s11 * s22 - s12 * s12) as a2 from (
          select sum(w * w1) as r1, sum(w * w2) as r2, sum(w1 * w1) as s11, sum(w1 * w2) as s12, sum(w2 * w2) as s22
          from {rows} where w2 is not null and w is not null)"""
    level = "level" if d == 0 else "level + a1 * w1 + a2 * w2"
    shown = "level + a1 * w1 + a2 * w2"
    base = "centre" if d == 0 else "y"
    return f"""{name}_fit as ({fit}),
    {name} as (
      select 0 as Step, w as w1, (select w from {rows} order by t desc limit 1 offset 1) as w2, {base} as level,
        0.0::double as shown, a1, a2 from {rows}, {name}_fit where t = (select max(t) from {rows})
      union all
      select Step + 1, a1 * w1 + a2 * w2, w1, {level}, {shown}, a1, a2 from {name} where Step < {HORIZON})"""


def _candidates():
    ctes = [_moments(0), _moments(1), *[_ar(p, d) for p, d in ar.ORDERS]]
    union = " union all ".join(
        f"""select '({p},{d},0)' as "Order", Step, greatest(exp(shown) - 1, 0) as Forecast from ar{p}{d} where Step > 0"""
        for p, d in ar.ORDERS
    )
    return [*ctes, f"candidates as ({union})"]


def _error_recursion():
    """Sums of squares of every order and grid point, by recursion over the weeks."""
    orders = ", ".join(f"('{o}', {o.lags}, {o.differences}, {o.errors})" for o in ma.ORDERS)

    def grid(name, needed):
        return f"unnest(case when {needed} then {list(ma.GRID)}::double[] else [0.0]::double[] end) as {name}"

    return f"""logs as (select t, ln(1 + Revenue) as y from train),
    orders(o, p, d, q) as (values {orders}),
    diffs as (
      select 0 as d, list(y - m order by t) as w from (select *, avg(y) over () as m from logs)
      union all select 1, list(v order by t) from (select t, y - lag(y) over (order by t) as v from logs) where v is not null),
    grid1 as (select *, {grid('a1', 'p >= 1')} from orders), grid2 as (select *, {grid('a2', 'p >= 2')} from grid1),
    grid3 as (select *, {grid('b1', 'q >= 1')} from grid2), points as (select *, {grid('b2', 'q >= 2')} from grid3),
    errors as (
      select o, p, q, a1, a2, b1, b2, w, p as t, 0.0::double as e1, 0.0::double as e2, 0.0::double as s
      from points join diffs using (d)
      union all
      select o, p, q, a1, a2, b1, b2, w, t + 1, e, e1, s + e * e from (
        select *, w[t + 1] - (case when p >= 1 then a1 * w[t] else 0 end) - (case when p >= 2 then a2 * w[t - 1] else 0 end)
          - b1 * e1 - b2 * e2 as e from errors where t < len(w)))"""


def _recursive(sql):
    return "with recursive" + sql[len("with"):]


def _seasonal(s):
    def z(k):
        return f"(y[-{k}] - y[-{k + 1}] - y[-{k + s}] + y[-{k + s + 1}])"

    return f"""z{s} as (
      select *, lag(z0, 1) over (order by t) as z1, lag(z0, {s}) over (order by t) as z2,
        lag(z0, {s + 1}) over (order by t) as z3
      from (select t, y - lag(y, 1) over (order by t) - lag(y, {s}) over (order by t)
                      + lag(y, {s + 1}) over (order by t) as z0
            from (select t, ln(1 + Revenue) as y from train))),
    m{s} as (select sum(z0*z0) as m00, sum(z0*z1) as m01, sum(z0*z2) as m02, sum(z0*z3) as m03, sum(z1*z1) as m11,
      sum(z1*z2) as m12, sum(z1*z3) as m13, sum(z2*z2) as m22, sum(z2*z3) as m23, sum(z3*z3) as m33
      from z{s} where z3 is not null),
    g{s} as (
      select *, i / 1000.0::double as p, m02 - i / 1000.0::double * m03 - i / 1000.0::double * m12 + pow(i / 1000.0::double, 2) * m13 as top,
        m22 - 2 * i / 1000.0::double * m23 + pow(i / 1000.0::double, 2) * m33 as bottom
      from m{s}, (select unnest(range(-999, 1000)) as i)),
    f{s} as (
      select p, q from (select *, greatest(-0.999, least(0.999, top / bottom)) as q from g{s})
      order by m00 - 2 * p * m01 + p * p * m11 - 2 * q * top + q * q * bottom limit 1),
    s{s} as (
      select 0 as Step, list(ln(1 + Revenue) order by t) as y from train
      union all
      select Step + 1, list_append(y, y[-1] + y[-{s}] - y[-{s + 1}] + p * {z(1)} + q * {z(s)} - p * q * {z(s + 1)})
      from s{s}, f{s} where Step < {HORIZON})"""


ORACLES = {
    "tsr01_weekly_series": week_sql(
        f"select Date, OrderCount, UniqueCustomers, {rounded('Revenue AvgOrderValue', 4)} from weekly"
    ),
    "tsr01_weekly_by_country": with_tables(
        "clean",
        f"select Country, Date, OrderCount, UniqueCustomers, {rounded('Revenue AvgOrderValue', 4)} from countries",
        COUNTRIES,
    ),
    "tsr02_monthly_series": with_tables(
        "clean",
        f"select Date, OrderCount, UniqueCustomers, {rounded('Revenue AvgOrderValue', 4)} from monthly",
        MONTHLY,
    ),
    "tsr03_avg_order_value": week_sql(f"select Date, {ra('AvgOrderValue', 4)} from weekly"),
    "tsr04_naive_forecast": week_sql(
        f"select Model, Step, {ra('Forecast', 4)} from forecasts where Model = 'Naive'", SPLIT, BASELINES
    ),
    "tsr05_moving_average_forecast": week_sql(
        f"select Model, Step, {ra('Forecast', 4)} from forecasts where Model <> 'Naive'", SPLIT, BASELINES
    ),
    "tsr09_autoregressive": _recursive(
        week_sql(f'select "Order", cast(Step as int) as Step, {ra("Forecast", 2)} from candidates', SPLIT, *_candidates())
    ),
    "tsr09_best_order": _recursive(
        week_sql(
            f"""select "Order", {ra('RMSE', 2)} from (
                  select "Order", sqrt(avg(pow(Revenue - Forecast, 2))) as RMSE
                  from candidates join test using (Step) group by 1 order by 2, 1 limit 1)""",
            SPLIT,
            *_candidates(),
        )
    ),
    "tsr06_grid_errors": _recursive(
        week_sql(
            f"""select {ra('Weight')}, {ra('SSE')} from (
                  select a as Weight, sum(c * c) - sum(c * k) * sum(c * k) / sum(k * k) as SSE from steps group by a)""",
            SPLIT,
            # c: error from a level of zero, k: how much of the first level is left; the best first level takes out their overlap
            """logs as (select list(ln(1 + Revenue) order by t) as y from train),
            steps as (
              select w * 0.05 as a, y, 1 as t, y[1] as c, 1.0::double as k, w * 0.05 * y[1] as level
              from logs, (select unnest(range(0, 21)) as w)
              union all
              select a, y, t + 1, y[t + 1] - level, k * (1 - a), a * y[t + 1] + (1 - a) * level from steps where t < len(y))""",
        )
    ),
    "tsr07_grid_errors": _recursive(
        week_sql(
            f"""select {r('a')} as Level, {r('b')} as Trend, {ra('SSE')} from (
                  select a, b, cc - (s22 * c1 * c1 - 2 * s12 * c1 * c2 + s11 * c2 * c2) / (s11 * s22 - s12 * s12) as SSE from (
                    select a, b, sum(c * c) as cc, sum(c * k1) as c1, sum(c * k2) as c2, sum(k1 * k1) as s11,
                      sum(k1 * k2) as s12, sum(k2 * k2) as s22
                    from (select *, y[t] - l0 - t0 as c, l1 + t1 as k1, l2 + t2 as k2 from steps where t <= len(y)) group by a, b))""",
            SPLIT,
            # level and trend: what the weeks give (0) and the shares of the first level (1) and trend (2)
            """logs as (select list(ln(1 + Revenue) order by t) as y from train),
            steps as (
              select i / 10.0::double as a, j / 10.0::double as b, y, 1 as t, 0.0::double as l0, 1.0::double as l1, 0.0::double as l2,
                0.0::double as t0, 0.0::double as t1, 1.0::double as t2
              from logs, (select unnest(range(0, 11)) as i), (select unnest(range(0, 11)) as j) where j <= i
              union all
              select a, b, y, t + 1, l0 + t0 + a * (y[t] - l0 - t0), (1 - a) * (l1 + t1), (1 - a) * (l2 + t2),
                t0 + b * (y[t] - l0 - t0), t1 - b * (l1 + t1), t2 - b * (l2 + t2)
              from steps where t <= len(y))""",
        )
    ),
    "tsr09_moving_average_grid": _recursive(
        week_sql(
            f"""select o as "Order", array_to_string(list_transform(
                    [a1, a2][:p] || [b1, b2][:q], lambda c: printf('%.1f', c)), ',') as Coefficients, {ra('SSE')}
                from (select *, s as SSE from errors where t = len(w)
                  qualify row_number() over (partition by o order by round(s, 9), a1, a2, b1, b2) = 1)""",
            SPLIT,
            _error_recursion(),
        )
    ),
    "tsr10_seasonal_autoregressive": _recursive(
        week_sql(
            " union all ".join(
                f"""select '(1,1,0)x(1,1,0,{s})' as "Order", cast(Step as int) as Step,
                    {r('greatest(exp(y[-1]) - 1, 0)', 2)} as Forecast from s{s} where Step > 0"""
                for s in ar.SEASONS
            ),
            SPLIT,
            *[_seasonal(s) for s in ar.SEASONS],
        )
    ),
    "tsr11_lag_features": week_sql(_lag_sql()),
    "tsr14_clean_forecast": week_sql(
        f"""select 'Growth' as Model, cast(Step as int) as Step,
              {r("coalesce(v, last_value(v ignore nulls) over (order by Step))")} as Forecast
            from (select Step, case when g is not null then greatest(g, 0) when Step < {HORIZON} then 0 end as v
                  from (select unnest(range(1, {HORIZON} + 1)) as Step)
                  left join (select a.tb as Step, case when b.Revenue <> 0 then a.Revenue / b.Revenue - 1 end as g
                             from train a join train b on b.tb = a.tb + 1 where a.tb < {HORIZON}) using (Step))""",
        SPLIT,
    ),
    "tsr15_back_transform": week_sql(
        f"select Date, {r('exp(ln(1 + Revenue) * 0.5::double) - 1', 4)} as Forecast from weekly"
    ),
    "tsr16_decomposition": week_sql(
        f"""select Date, Period, {ra('Revenue', 3)}, {ra('Trend', 3)}, {r('mean - centre', 3)} as Seasonal,
              {r('Revenue - Trend - (mean - centre)', 3)} as Residual
            from (select *, avg(case when t < Period then mean end) over () as centre
                  from (select *, avg(Revenue - Trend) over (partition by t % Period) as mean
                        from (select *, case when Period = 52
                                  then case when t >= 26 and t < n - 26 then (a + b) / 2 end
                                  else case when t >= 6 and t < n - 6 then c end end as Trend
                              from base_rows where Period is not null)))""",
        """base_rows as (
             select Date, Revenue, row_number() over w - 1 as t, n,
               cast(case when n >= 104 then 52 when n >= 26 then 13 end as int) as Period,
               avg(Revenue) over (order by Date rows between 26 preceding and 25 following) as a,
               avg(Revenue) over (order by Date rows between 25 preceding and 26 following) as b,
               avg(Revenue) over (order by Date rows between 6 preceding and 6 following) as c
             from (select *, count(*) over () as n from weekly) window w as (order by Date))""",
    ),
    "tsr18_forecast_residuals": week_sql(
        f"""select Model, Date, {r('Actual - Forecast', 4)} as Residual from matched
            where Model = (select Model from matched group by Model
                           order by sqrt(avg(pow(Actual - Forecast, 2))), Model limit 1)""",
        SPLIT,
        BASELINES,
    ),
    "tsr19_series_summary": week_sql(
        f"""select (select min(Date) from train) as TrainStart, (select max(Date) from train) as TrainEnd,
              (select min(Date) from test) as TestStart, (select max(Date) from test) as TestEnd,
              count(*) as WeeklyObservations, {r('sum(Revenue)', 2)} as TotalHistoricalRevenue,
              {r('avg(Revenue)', 2)} as AverageWeeklyRevenue, {r('max_by(Revenue, Date)', 2)} as LatestWeeklyRevenue,
              (select count(*) from monthly) as MonthlyObservations,
              (select {r('max_by(Revenue, Date)', 2)} from monthly) as LatestMonthlyRevenue
            from weekly""",
        SPLIT,
        MONTHLY,
    ),
    "tsr20_long_enough": with_tables(
        "clean",
        f"select Country, count(*) as Rows, count(*) > {HORIZON} + 20 as LongEnough from countries group by 1",
        COUNTRIES,
    ),
    "tsr20_rejected": with_tables(
        "clean",
        f"""select Country, count(*) as Rows, cast({LONG_HORIZON} + 21 as bigint) as RowsNeeded from countries
            group by 1 having count(*) <= {LONG_HORIZON} + 20""",
        COUNTRIES,
    ),
    "vue08_horizon_slice": week_sql(
        f"""select 'Naive' as Model, cast(k as int) as Step, cast((select max(Date) from weekly) + cast(7 * k as int) as date) as Date,
              {r('(select max_by(Revenue, Date) from weekly)', 4)} as Forecast from (select unnest(range(1, 5)) as k)"""
    ),
    "pre08_last_weeks_holdout": week_sql(
        f"select Date, {ra('Revenue', 4)}, case when back <= {HORIZON} then 'test' else 'train' end as Split from counted_back",
        SPLIT,
    ),
    "met12_smape": week_sql(
        f"select Model, {r(_SMAPE)} as sMAPE_Pct from matched group by 1", SPLIT, BASELINES
    ),
    "met13_wape": week_sql(
        f"select Model, {r(_WAPE)} as WAPE_Pct from matched group by 1", SPLIT, BASELINES
    ),
    "met14_forecast_metrics": week_sql(
        f"select {_METRICS} from matched group by Model", SPLIT, BASELINES
    ),
    "met15_model_comparison": week_sql(
        f"""select *, Model = (select Model from matched group by Model
                               order by sqrt(avg(pow(Actual - Forecast, 2))), Model limit 1) as IsBest
            from (select {_METRICS} from matched group by Model)""",
        SPLIT,
        BASELINES,
    ),
}
