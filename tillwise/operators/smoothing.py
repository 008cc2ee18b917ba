"""Exponential smoothing on log revenue with estimated start states.

For fixed weights the one-step errors are affine in the start states, so those are solved by
least squares and only the weights are searched: a grid, then steps round its best point that halve
while none lowers the error. Spark spreads series and slices of the weight
grid over tasks; one task sees the weeks of one series, a calendar's worth of numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.functions.joins import join_on
from tillwise.operators.autoregression import log_history
from tillwise.operators.series import back_transform

SLICES = 8
STEP, LEAST_STEP = 0.1, 0.0005
GRID = tuple(round(STEP * i, 1) for i in range(11))


def _system(kind: str, season: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Transition, observation row and the state positions the weights act on."""
    size = {"simple": 1, "trend": 2, "seasonal": 2 + season}[kind]
    move, look = np.zeros((size, size)), np.zeros(size)
    move[0, 0] = look[0] = 1.0
    if size == 1:
        return move, look, [0]
    move[0, 1] = move[1, 1] = look[1] = 1.0
    if size == 2:
        return move, look, [0, 1]
    look[-1] = 1.0
    move[2, -1] = 1.0
    for i in range(3, size):
        move[i, i - 1] = 1.0
    return move, look, [0, 1, 2]


def _weights(kind: str) -> np.ndarray:
    """Weight combinations within the usual limits; 0 is part of every grid."""
    if kind == "simple":
        return np.array([[a / 2] for a in np.arange(0, 2.01, 0.1)])
    if kind == "trend":
        return np.array([w for w in product(GRID, GRID) if w[1] <= w[0]])
    return np.array([w for w in product(GRID, GRID, GRID) if w[1] <= w[0] and w[2] <= 1 - w[0] + 1e-9])


def _allowed(kind: str, weights: np.ndarray) -> np.ndarray:
    """The rows of weights within the usual limits."""
    inside = ((weights >= 0) & (weights <= 1)).all(axis=1)
    if kind != "simple":
        inside &= weights[:, 1] <= weights[:, 0] + 1e-12
    if kind == "seasonal":
        inside &= weights[:, 2] <= 1 - weights[:, 0] + 1e-9
    return weights[inside]


def _search(y: np.ndarray, kind: str, season: int, horizon: int, part: int) -> tuple[float, list, list]:
    """The best weights of one slice of the grid."""
    weights = _weights(kind)[part::SLICES]
    if len(weights) == 0 or len(y) <= len(_system(kind, season)[1]):
        return float("inf"), [], []
    return _fitted(y, kind, season, horizon, weights)


def _refined(y: np.ndarray, kind: str, season: int, horizon: int, weights: list) -> tuple[float, list, list]:
    """The weights moved in ever smaller steps while the error falls."""
    best, step = _fitted(y, kind, season, horizon, np.array([weights])), STEP / 2
    around = np.array(list(product((-1.0, 0.0, 1.0), repeat=len(weights))))
    while step >= LEAST_STEP:
        near = _allowed(kind, np.array(best[1]) + step * around)
        found = _fitted(y, kind, season, horizon, near) if len(near) else best
        if found[0] < best[0] - 1e-12:
            best = found
        else:
            step /= 2
    return best


def _fitted(y: np.ndarray, kind: str, season: int, horizon: int, weights: np.ndarray) -> tuple[float, list, list]:
    """The best of some weights: squared error, weights and log forecast."""
    move, look, places = _system(kind, season)
    count, size = len(weights), len(look)
    gain = np.zeros((count, size))
    gain[:, places] = weights
    carry = move[None] - gain[:, :, None] * look[None, None, :]
    slope = np.broadcast_to(np.eye(size), (count, size, size)).copy()
    shift = np.zeros((count, size))
    rows, target = np.empty((count, len(y), size)), np.empty((count, len(y)))
    for t, value in enumerate(y):
        rows[:, t] = look @ slope
        target[:, t] = value - shift @ look
        slope = carry @ slope
        shift = np.einsum("gij,gj->gi", carry, shift) + gain * value
    moments = np.einsum("gti,gtj->gij", rows, rows)
    start = np.einsum("gij,gj->gi", np.linalg.pinv(moments, hermitian=True), np.einsum("gti,gt->gi", rows, target))
    errors = target - np.einsum("gti,gi->gt", rows, start)
    squares = np.where(np.isfinite(errors).all(axis=1), (errors**2).sum(axis=1), np.inf)
    best = int(np.argmin(squares))
    state, out = slope[best] @ start[best] + shift[best], []
    for _ in range(horizon):
        out.append(float(look @ state))
        state = move @ state
    return float(squares[best]), [float(w) for w in weights[best]], out


def smoothing_forecast(
    train: DataFrame, horizon: int, kind: str, season: int = 0, by: Sequence[str] = (), model: str = ""
) -> DataFrame:
    """Forecast rows of one smoothing model per series, with its weights and squared error."""
    keys = list(by)
    pieces = log_history(train, by).withColumn(
        "Slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)))
    )
    fields = [f for f in pieces.schema.fields if f.name in keys]
    schema = T.StructType(
        [
            *fields,
            T.StructField("SSE", T.DoubleType()),
            T.StructField("Weights", T.ArrayType(T.DoubleType())),
            T.StructField("Values", T.ArrayType(T.DoubleType())),
        ]
    )

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame.iloc[0]
        found = _search(np.asarray(first["y"], dtype=float), kind, season, horizon, int(first["Slice"]))
        values = [first[k] for k in keys] + list(found)
        return pd.DataFrame([values], columns=[*keys, "SSE", "Weights", "Values"])

    def refine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [
                [*(row[k] for k in keys), *_refined(np.asarray(row["y"], float), kind, season, horizon, list(row["Weights"]))]
                for row in frame.to_dict("records")
            ]
            yield pd.DataFrame(rows, columns=[*keys, "SSE", "Weights", "Values"])

    tried = pieces.groupBy(*keys, "Slice").applyInPandas(fit, schema)
    coarse = tried.where(F.size("Values") > 0).groupBy(*keys).agg(
        F.min_by("Weights", F.struct("SSE", "Weights")).alias("Weights")
    )
    history = log_history(train, by)
    joined = join_on(history, coarse, keys) if keys else history.join(F.broadcast(coarse))
    best = joined.select(*keys, "y", "Weights").mapInPandas(refine, schema)
    return best.select(
        *keys, F.lit(model or kind).alias("Model"), "SSE", "Weights", F.posexplode("Values").alias("_at", "_log"),
    ).select(
        *keys, "Model", (F.col("_at") + 1).alias("Step"),
        back_transform(F.col("_log")).alias("Forecast"), "SSE", "Weights",
    )


def grid_errors(train: DataFrame, kind: str, season: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """(by, Weights, SSE): the squared error of every point of the grid, with its own best start."""
    keys, weights = list(by), _weights(kind)
    history = log_history(train, by)
    numbers = F.explode(F.sequence(F.lit(0), F.lit(len(weights) - 1))).alias("number")
    fields = [history.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("Weights", T.ArrayType(T.DoubleType())), T.StructField("SSE", T.DoubleType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.to_dict("records"):
                point = weights[row["number"]][None]
                rows.append([*(row[k] for k in keys), point[0].tolist(), _fitted(np.asarray(row["y"], float), kind, season, 0, point)[0]])
            yield pd.DataFrame(rows, columns=schema.names)

    return history.select(*keys, "y", numbers).mapInPandas(run, schema)


def simple_smoothing(train: DataFrame, horizon: int, by: Sequence[str] = ()) -> DataFrame:
    return smoothing_forecast(train, horizon, "simple", by=by, model="SES")


def trend_smoothing(train: DataFrame, horizon: int, by: Sequence[str] = ()) -> DataFrame:
    return smoothing_forecast(train, horizon, "trend", by=by, model="Holt")


def seasonal_smoothing(train: DataFrame, horizon: int, season: int, by: Sequence[str] = ()) -> DataFrame:
    return smoothing_forecast(
        train, horizon, "seasonal", season, by=by, model=f"HoltWinters_s{season}"
    )
