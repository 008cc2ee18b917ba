"""Models with autoregressive and moving-average terms, ordinary and seasonal, on log revenue.

The coefficients of an order have the least conditional sum of squares: errors follow from the
differenced series by a recursion in which both lag polynomials are products of an ordinary and a
seasonal one; values and errors before the start count as zero. A coarse grid over the
coefficients is evaluated at once, then the best point is moved in ever smaller steps, so the sum
is never above the grid's. Spark spreads pairs of series and order over tasks; a task sees the weeks
of one series, a calendar's worth of numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tillwise.operators.autoregression import log_history
from tillwise.operators.series import back_transform


class Order(NamedTuple):
    lags: int
    differences: int
    errors: int
    seasonal_lags: int = 0
    seasonal_differences: int = 0
    seasonal_errors: int = 0
    season: int = 0

    def __str__(self) -> str:
        plain = f"({self.lags},{self.differences},{self.errors})"
        if not self.season:
            return plain
        return f"{plain}x({self.seasonal_lags},{self.seasonal_differences},{self.seasonal_errors},{self.season})"

    @property
    def size(self) -> int:
        return self.lags + self.errors + self.seasonal_lags + self.seasonal_errors


# The orders that are tried.
ORDERS = tuple(
    Order(*o) for o in ((0, 1, 1), (1, 1, 0), (1, 1, 1), (2, 1, 1), (1, 1, 2), (2, 1, 2), (1, 0, 1), (2, 0, 2))
)
SEASONAL_ORDERS = tuple(
    Order(*plain, *seasonal, season)
    for plain in ((0, 1, 1), (1, 1, 0), (1, 1, 1), (2, 1, 1))
    for season in (4, 13)
    for seasonal in ((0, 1, 1), (1, 1, 0), (1, 1, 1))
)
# Parameters: coefficients of the grid, the least step of the refinement and its rounds at most.
GRID = (-0.8, -0.4, 0.0, 0.4, 0.8)
LEAST_STEP, ROUNDS = 0.0005, 200
LIMIT = 0.99


def polynomial(plain: np.ndarray, seasonal: np.ndarray, season: int, sign: float) -> list[tuple[int, np.ndarray]]:
    """(lag, coefficient per row) of (1 + sign * plain)(1 + sign * seasonal) without the leading one."""
    out: dict[int, np.ndarray] = {}
    for i in range(plain.shape[1] + 1):
        for j in range(seasonal.shape[1] + 1):
            if i or j:
                one = sign * plain[:, i - 1] if i else 1.0
                other = sign * seasonal[:, j - 1] if j else 1.0
                lag = i + season * j
                out[lag] = out.get(lag, 0.0) + one * other * np.ones(len(plain))
    return sorted(out.items())


def parts_of(points: np.ndarray, order: Order) -> tuple[list, list]:
    """Lag polynomials of the values and of the errors for each row of coefficients."""
    cuts = np.cumsum([order.lags, order.errors, order.seasonal_lags])
    lags, errors, seasonal_lags, seasonal_errors = np.split(points, cuts, axis=1)
    return (
        polynomial(lags, seasonal_lags, order.season, -1.0),
        polynomial(errors, seasonal_errors, order.season, 1.0),
    )


def residuals(w: np.ndarray, points: np.ndarray, order: Order) -> np.ndarray:
    """(point, time): errors of the differenced series, zero while its lags are not all there."""
    values, errors = parts_of(points, order)
    out = np.zeros((len(points), len(w)))
    for t in range(max([lag for lag, _ in values], default=0), len(w)):
        e = np.full(len(points), w[t])
        for lag, c in values:
            e += c * w[t - lag]
        for lag, c in errors:
            if lag <= t:
                e -= c * out[:, t - lag]
        out[:, t] = e
    return out


def squares(w: np.ndarray, points: np.ndarray, order: Order) -> np.ndarray:
    with np.errstate(all="ignore"):
        sums = np.square(residuals(w, points, order)).sum(axis=1)
    return np.where(np.isfinite(sums), np.round(sums, 9), np.inf)


def differenced(y: np.ndarray, order: Order) -> tuple[np.ndarray, float]:
    """The differenced series, and the mean that was taken from one without differences."""
    w, centre = y, 0.0
    for _ in range(order.differences):
        w = w[1:] - w[:-1]
    for _ in range(order.seasonal_differences):
        w = w[order.season :] - w[: -order.season]
    if not order.differences and not order.seasonal_differences and len(w):
        centre = float(w.mean())
        w = w - centre
    return w, centre


def fitted(w: np.ndarray, order: Order, refine: bool = True) -> tuple[np.ndarray, float]:
    """Coefficients of the least sum of squares and that sum; of equal points the first."""
    points = np.array(list(product(GRID, repeat=order.size)))
    sums = squares(w, points, order)
    best, least, step = points[sums.argmin()], float(sums.min()), (GRID[1] - GRID[0]) / 2
    around = np.array(list(product((0.0, -1.0, 1.0), repeat=order.size)))
    for _ in range(ROUNDS if refine else 0):
        if step < LEAST_STEP:
            break
        points = np.clip(best + step * around, -LIMIT, LIMIT)
        sums = squares(w, points, order)
        if sums.min() < least:
            best, least = points[sums.argmin()], float(sums.min())
        else:
            step /= 2
    return best, least


def ahead(y: np.ndarray, order: Order, point: np.ndarray, horizon: int) -> list[float]:
    """Log forecasts: the errors to come are zero, differences are taken back."""
    w, centre = differenced(y, order)
    values, errors = parts_of(point[None], order)
    whole = polynomial(np.ones((1, 1)) if order.differences else np.zeros((1, 0)),
                       np.ones((1, 1)) if order.seasonal_differences else np.zeros((1, 0)), order.season, -1.0)
    levels, moves, shocks = list(y), list(w), list(residuals(w, point[None], order)[0])
    for _ in range(horizon):
        move = sum(float(c[0]) * shocks[-lag] for lag, c in errors if lag <= len(shocks))
        move -= sum(float(c[0]) * moves[-lag] for lag, c in values if lag <= len(moves))
        levels.append(move + centre - sum(float(c[0]) * levels[-lag] for lag, c in whole))
        moves.append(move)
        shocks.append(0.0)
    return levels[len(y) :]


def least_weeks(order: Order) -> int:
    """Weeks that leave the recursion more errors than it has coefficients."""
    gone = order.differences + order.season * (order.seasonal_differences + order.seasonal_lags) + order.lags
    return gone + 2 * order.size + 2


def fits(
    train: DataFrame, horizon: int, orders: Sequence[Order], by: Sequence[str] = (), refine: bool = True
) -> DataFrame:
    """(by, Order, Coefficients, SSE, Values) per series and order; too short a series has no row."""
    history = log_history(train, by)
    numbers = F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1))).alias("number")
    pairs = history.select(*by, "y", numbers).repartition(*by, "number")
    keys = [history.schema[name] for name in by]
    schema = StructType(
        [*keys, *StructType.fromDDL("`Order` string, Coefficients array<double>, SSE double, `Values` array<double>").fields]
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.to_dict("records"):
                order, y = orders[row["number"]], np.asarray(row["y"], float)
                if len(y) < least_weeks(order):
                    continue
                point, least = fitted(differenced(y, order)[0], order, refine)
                rows.append([*(row[k] for k in by), str(order), point.tolist(), least, ahead(y, order, point, horizon)])
            yield pd.DataFrame(rows, columns=schema.names)

    return pairs.mapInPandas(run, schema)


def forecasts(train: DataFrame, horizon: int, orders: Sequence[Order] = ORDERS, by: Sequence[str] = ()) -> DataFrame:
    """(by, Order, Step, Forecast) of every order."""
    found = fits(train, horizon, orders, by).select(*by, "Order", F.posexplode("Values").alias("_at", "_log"))
    return found.select(*by, "Order", (F.col("_at") + 1).alias("Step"), back_transform(F.col("_log")).alias("Forecast"))
