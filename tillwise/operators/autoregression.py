"""Autoregressive forecasts on log revenue, fitted from lag cross-moments.

The moments are plain sums per series; coefficients come in closed form (and a one-way grid
for the seasonal model), and the recursion over the horizon is a fold over a small array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.columns import ratio
from tillwise.functions.joins import join_on
from tillwise.operators.series import back_transform, per_series

# Pure autoregressive orders (lags, differences) and the seasonal periods.
ORDERS = ((1, 0), (1, 1), (2, 0), (2, 1))
SEASONS = (4, 13)


def log_history(train: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per series: log revenue in date order. A series is a calendar, so it is short."""
    rows = F.array_sort(F.collect_list(F.struct("Date", F.log1p("Revenue").alias("y"))))
    return train.groupBy(*by).agg(F.transform(rows, lambda r: r["y"]).alias("y"))


def _lagged(train: DataFrame, by: Sequence[str], differences: int) -> DataFrame:
    order = per_series(by).orderBy("Date")
    rows = train.select(*by, "Date", F.log1p("Revenue").alias("y"))
    if differences == 0:
        centre = F.avg("y").over(per_series(by))
        rows = rows.withColumn("w", F.col("y") - centre)
    else:
        rows = rows.withColumn("w", F.col("y") - F.lag("y").over(order))
    return rows.withColumns({f"w{k}": F.lag("w", k).over(order) for k in (1, 2)})


def _coefficients(train: DataFrame, lags: int, differences: int, by: Sequence[str]) -> DataFrame:
    rows = _lagged(train, by, differences)
    names = ["w", "w1"] if lags == 1 else ["w", "w1", "w2"]
    rows = rows.where(F.col(names[-1]).isNotNull() & F.col("w").isNotNull())

    def cross(a: str, b: str) -> Column:
        return F.sum(F.col(a) * F.col(b))

    if lags == 1:
        return rows.groupBy(*by).agg(
            F.coalesce(ratio(cross("w", "w1"), cross("w1", "w1")), F.lit(0.0)).alias("a1"),
            F.lit(0.0).alias("a2"),
        )
    sums = rows.groupBy(*by).agg(
        cross("w", "w1").alias("r1"),
        cross("w", "w2").alias("r2"),
        cross("w1", "w1").alias("s11"),
        cross("w1", "w2").alias("s12"),
        cross("w2", "w2").alias("s22"),
    )
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    return sums.select(
        *by,
        F.coalesce(
            ratio(F.col("r1") * F.col("s22") - F.col("r2") * F.col("s12"), det), F.lit(0.0)
        ).alias("a1"),
        F.coalesce(
            ratio(F.col("r2") * F.col("s11") - F.col("r1") * F.col("s12"), det), F.lit(0.0)
        ).alias("a2"),
    )


def _attach(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    return join_on(left, right, by) if by else left.join(F.broadcast(right))


def _unfold(frame: DataFrame, by: Sequence[str], values: Column, keep: Sequence[str]) -> DataFrame:
    return frame.select(*by, *keep, F.posexplode(values).alias("_at", "_log")).select(
        *by, *keep, (F.col("_at") + 1).alias("Step"), back_transform(F.col("_log")).alias("Forecast")
    )


def autoregressive_forecast(
    train: DataFrame, horizon: int, lags: int, differences: int, by: Sequence[str] = ()
) -> DataFrame:
    """Forecast of one order, no moving-average terms."""
    history = _attach(log_history(train, by), _coefficients(train, lags, differences, by), by)
    y = F.col("y")
    centre = F.aggregate(y, F.lit(0.0), lambda s, v: s + v) / F.size(y)

    def at(k: int) -> Column:
        return F.element_at(y, F.lit(-k))

    if differences == 0:
        first, second, level = at(1) - centre, at(2) - centre, centre
    else:
        first, second, level = at(1) - at(2), at(2) - at(3), at(1)
    start = F.struct(
        first.alias("w1"), second.alias("w2"), level.alias("level"),
        F.array().cast("array<double>").alias("out"),
    )

    def advance(state: Column, _step: Column) -> Column:
        w = F.col("a1") * state["w1"] + F.col("a2") * state["w2"]
        level = state["level"] + w if differences else state["level"]
        shown = level if differences else state["level"] + w
        return F.struct(
            w.alias("w1"),
            state["w1"].alias("w2"),
            level.alias("level"),
            F.concat(state["out"], F.array(shown)).alias("out"),
        )

    values = F.aggregate(
        F.sequence(F.lit(1), F.lit(horizon)), start, advance, lambda state: state["out"]
    )
    frame = history.withColumn("Order", F.lit(f"({lags},{differences},0)"))
    return _unfold(frame, by, values, ["Order"])


def autoregressive_candidates(train: DataFrame, horizon: int, by: Sequence[str] = ()) -> DataFrame:
    frames = [autoregressive_forecast(train, horizon, p, d, by) for p, d in ORDERS]
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def _seasonal_coefficients(train: DataFrame, season: int, by: Sequence[str]) -> DataFrame:
    """Ordinary coefficient on a grid of thousandths, the seasonal one in closed form."""
    order = per_series(by).orderBy("Date")
    rows = train.select(*by, "Date", F.log1p("Revenue").alias("y"))

    def lag(k: int) -> Column:
        return F.lag("y", k).over(order)

    z = F.col("y") - lag(1) - lag(season) + lag(season + 1)
    rows = rows.withColumn("z0", z)
    rows = rows.withColumns(
        {f"z{i}": F.lag("z0", k).over(order) for i, k in ((1, 1), (2, season), (3, season + 1))}
    ).where(F.col("z3").isNotNull())
    pairs = [(i, j) for i in range(4) for j in range(i, 4)]
    sums = rows.groupBy(*by).agg(
        *[F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"m{i}{j}") for i, j in pairs]
    )
    grid = sums.withColumn("_i", F.explode(F.sequence(F.lit(-999), F.lit(999))))
    p = F.col("_i") / F.lit(1000.0)

    def m(i: int, j: int) -> Column:
        return F.col(f"m{min(i, j)}{max(i, j)}")

    top = m(0, 2) - p * m(0, 3) - p * m(1, 2) + p * p * m(1, 3)
    bottom = m(2, 2) - 2 * p * m(2, 3) + p * p * m(3, 3)
    seasonal = F.greatest(F.lit(-0.999), F.least(F.lit(0.999), F.coalesce(ratio(top, bottom), F.lit(0.0))))
    grid = grid.withColumn("_p", p).withColumn("_q", seasonal)
    q = F.col("_q")
    rest = m(0, 0) - 2 * p * m(0, 1) + p * p * m(1, 1)
    sse = rest - 2 * q * top + q * q * bottom
    return grid.groupBy(*by).agg(
        F.min_by(F.struct("_p", "_q"), F.struct(sse, F.abs(F.col("_i")), F.col("_i"))).alias("_best")
    ).select(*by, F.col("_best._p").alias("p"), F.col("_best._q").alias("q"))


def seasonal_forecast(
    train: DataFrame, horizon: int, season: int, by: Sequence[str] = ()
) -> DataFrame:
    """One ordinary and one seasonal lag on once and seasonally differenced log revenue."""
    history = _attach(log_history(train, by), _seasonal_coefficients(train, season, by), by)
    history = history.where(F.size("y") >= 2 * season + 2)

    def step(y: Column, _step: Column) -> Column:
        def at(k: int) -> Column:
            return F.element_at(y, F.lit(-k))

        def z(k: int) -> Column:
            return at(k) - at(k + 1) - at(k + season) + at(k + season + 1)

        p, q = F.col("p"), F.col("q")
        nxt = p * z(1) + q * z(season) - p * q * z(season + 1)
        return F.concat(y, F.array(at(1) + at(season) - at(season + 1) + nxt))

    folded = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col("y"), step)
    frame = history.withColumn("Order", F.lit(f"(1,1,0)x(1,1,0,{season})"))
    return _unfold(frame, by, F.slice(folded, F.size("y") + 1, horizon), ["Order"])


def seasonal_candidates(train: DataFrame, horizon: int, by: Sequence[str] = ()) -> DataFrame:
    whole = seasonal_forecast(train, horizon, SEASONS[0], by)
    for season in SEASONS[1:]:
        whole = whole.unionByName(seasonal_forecast(train, horizon, season, by))
    return whole


def best_order(candidates: DataFrame, test: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The order with the lowest test error per series, and that error."""
    numbered = test.select(
        *by, F.row_number().over(per_series(by).orderBy("Date")).alias("Step"), "Revenue"
    )
    errors = join_on(candidates, numbered, [*by, "Step"]).groupBy(*by, "Order").agg(
        F.sqrt(F.avg(F.pow(F.col("Revenue") - F.col("Forecast"), F.lit(2.0)))).alias("RMSE")
    )
    return errors.groupBy(*by).agg(
        F.min_by("Order", F.struct("RMSE", "Order")).alias("Order"), F.min("RMSE").alias("RMSE")
    )


def keep_order(candidates: DataFrame, best: DataFrame, model: str, by: Sequence[str] = ()) -> DataFrame:
    return join_on(candidates, best.select(*by, "Order"), [*by, "Order"]).select(
        *by, F.lit(model).alias("Model"), "Step", "Forecast"
    )
