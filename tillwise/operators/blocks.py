"""Distance work between rows: cells of a k-d tree with the boxes around their rows, and fast distances with a known error.

The space is cut into cells by a k-d tree over a sample. A row has to meet only rows whose box
comes within reach (``pieces.py``). A matrix product finds the pairs that can matter; their
distances are then taken feature by feature. Cells change the cost, not the result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.lineage import cut_lineage
from tillwise.functions.ranking import hash_key

MAX_CELLS = 2048
ROWS_PER_CELL = 2000
SAMPLE_PER_CELL, MAX_SAMPLE = 32, 32_768
MAX_TASKS = 1000
ROUNDING = 1e-9  # distances tie at this many digits
AT_ONCE = 64  # rows of a block compared in one step


def with_vector(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, F.array(*[F.col(c).cast("double") for c in columns]).alias("Vector"))


def stack(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in vectors])


def matrix_of(table: pa.Table, name: str) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    values = table.column(name).combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def pair_distances(left: np.ndarray, right: np.ndarray, power: int = 2) -> np.ndarray:
    """Distances of the rows side by side to nine digits, so that equal ones tie whatever the order of the rows."""
    total = np.zeros(len(left))
    for j in range(left.shape[1]):
        step = np.abs(left[:, j] - right[:, j])
        total += step if power == 1 else step * step
    return np.floor((total if power == 1 else np.sqrt(total)) * 1e9 + 0.5) / 1e9


class Rough:
    """Fast distances to the rows of a block: squares by a matrix product, or sums in single precision.

    ``error`` bounds by how much a value may be off, per row that is compared.
    """

    def __init__(self, right: np.ndarray, power: int):
        self.power, self.centre = power, right.mean(axis=0)
        moved = right - self.centre
        if power == 1:
            self.right = np.ascontiguousarray(moved.T, dtype=np.float32)
            self.size = np.abs(moved).sum(axis=1).max()
        else:
            self.right, self.squares = moved.T, (moved * moved).sum(axis=1)
            self.size = self.squares.max()

    def to(self, left: np.ndarray, columns: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The fast distances to all rows of the block, or to those named, and their error."""
        moved = left - self.centre
        right = self.right if columns is None else self.right[:, columns]
        if self.power == 1:
            error = 1e-5 * (np.abs(moved).sum(axis=1) + self.size)
            moved = moved.astype(np.float32)
            total = np.zeros((len(left), right.shape[1]), np.float32)
            step = np.empty_like(total)
            for j in range(len(right)):
                np.subtract(moved[:, j, None], right[j], out=step)
                total += np.abs(step, out=step)
            return total, error
        squares = (moved * moved).sum(axis=1)
        apart = moved @ right
        apart *= -2.0
        apart += squares[:, None]
        apart += self.squares if columns is None else self.squares[columns]
        return apart, 1e-12 * (squares + self.size)

    def limit(self, reach: np.ndarray | float, side: int = 1) -> np.ndarray | float:
        """A rounded distance on this scale, moved out (or in) by more than the rounding."""
        moved = reach + side * 2 * ROUNDING
        return moved if self.power == 1 else moved * np.abs(moved)


def near_pairs(left: np.ndarray, right: np.ndarray, rough: Rough, reach: float, apart: np.ndarray, error: np.ndarray) -> np.ndarray:
    """Which pairs are within reach; pairs that the fast distances leave open are compared exactly."""
    near = apart <= rough.limit(reach) + error[:, None]
    sure = apart <= rough.limit(reach, -1) - error[:, None]
    if np.count_nonzero(near) != np.count_nonzero(sure):
        rows, columns = np.nonzero(near & ~sure)
        near[rows, columns] = pair_distances(left[rows], right[columns], rough.power) <= reach
    return near


@dataclass(frozen=True)
class Cells:
    """A k-d tree and, per cell (leaf), the number of its rows and the box around them."""

    feature: np.ndarray  # -1 where a node is a leaf
    cut: np.ndarray  # values up to this one go left
    below: np.ndarray  # (left, right) children; a leaf holds its cell number
    power: int
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """The cell of every row."""
        at, rows = np.zeros(len(vectors), int), np.arange(len(vectors))
        while True:
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any():
                return self.below[at, 0]
            right = vectors[rows, np.maximum(feature, 0)] > self.cut[at]
            at = np.where(inner, self.below[at, right.astype(int)], at)

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        """(row, cell): the distance from a row to the box of a cell."""
        total = np.zeros((len(vectors), len(self.rows)))
        for j in range(vectors.shape[1]):
            value = vectors[:, j, None]
            step = np.maximum(np.maximum(self.low[:, j] - value, value - self.high[:, j]), 0.0)
            total += step if self.power == 1 else step * step
        return total if self.power == 1 else np.sqrt(total)

    def visits(self, vectors: np.ndarray, reach: np.ndarray | float) -> list[np.ndarray]:
        """Per row, the cells that can hold a row within reach (one number, or one per row)."""
        found = []
        for start in range(0, len(vectors), AT_ONCE):
            apart = self.nearest(vectors[start : start + AT_ONCE])
            limit = reach[start : start + AT_ONCE, None] if isinstance(reach, np.ndarray) else reach
            near = (apart <= limit * (1 + 1e-9) + 2 * ROUNDING) & (self.rows > 0)
            found += [np.flatnonzero(line).astype("int32") for line in near]
        return found

    def blocks(self, counts: np.ndarray, block_rows: int) -> np.ndarray:
        return np.maximum(1, np.ceil(counts / block_rows)).astype(int)


def per_cell(values: np.ndarray) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("Cell") + 1)


def kd_tree(sample: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The largest leaf is cut at the median of its widest feature until there are enough leaves."""
    feature, cut, below, leaves = [-1], [0.0], [[0, 0]], {0: np.arange(len(sample))}
    open_leaves = [(-len(sample), 0)]
    while open_leaves and len(leaves) < wanted:
        open_leaves.sort()
        _, node = open_leaves.pop(0)
        rows = leaves[node]
        values = sample[rows]
        if len(rows) < 2 or not (values.max(axis=0) > values.min(axis=0)).any():
            continue
        best = int(values.var(axis=0).argmax())
        if not values[:, best].max() > values[:, best].min():
            best = int((values.max(axis=0) - values.min(axis=0)).argmax())
        line = np.sort(values[:, best])
        middle = line[(len(line) - 1) // 2]
        middle = middle if middle < line[-1] else line[np.searchsorted(line, middle) - 1]
        left = values[:, best] <= middle
        feature[node], cut[node], below[node] = best, float(middle), [len(feature), len(feature) + 1]
        del leaves[node]
        for child in (rows[left], rows[~left]):
            leaves[len(feature)] = child
            open_leaves.append((-len(child), len(feature)))
            feature.append(-1), cut.append(0.0), below.append([0, 0])
    for number, node in enumerate(sorted(leaves)):
        below[node] = [number, number]
    return np.array(feature), np.array(cut), np.array(below)


def build_cells(home: DataFrame, identifier: str, power: int = 2, pivots: int | None = None) -> tuple[DataFrame, Cells]:
    """Put every row into its cell (column ``Cell``). At most MAX_SAMPLE rows reach the driver."""
    size = home.count()
    wanted = pivots or min(MAX_CELLS, max(1, -(-size // ROWS_PER_CELL)))
    rows = min(MAX_SAMPLE, SAMPLE_PER_CELL * wanted)
    picked = home.orderBy(hash_key(identifier), identifier).limit(rows).select("Vector").collect()
    sample = np.array([row[0] for row in picked], dtype=float).reshape(len(picked), -1)
    width = sample.shape[1]
    feature, cut, below = kd_tree(sample, wanted)
    cells = Cells(feature, cut, below, power, np.zeros(0), np.zeros(0), np.zeros(0))
    placed = cut_lineage(with_cell(home, cells))
    value = lambda k: F.get("Vector", F.lit(k))
    stats = placed.groupBy("Cell").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.min(value(k)) for k in range(width)]).alias("low"),
        F.array(*[F.max(value(k)) for k in range(width)]).alias("high"),
    )
    number = int((feature < 0).sum())
    counts, low, high = np.zeros(number), np.full((number, width), np.inf), np.full((number, width), -np.inf)
    for row in stats.collect():
        counts[row["Cell"]], low[row["Cell"]], high[row["Cell"]] = row["n"], row["low"], row["high"]
    return placed, Cells(feature, cut, below, power, counts, low, high)


def with_cell(df: DataFrame, cells: Cells) -> DataFrame:
    @F.pandas_udf("int")
    def placed(vectors: pd.Series) -> pd.Series:
        return pd.Series(cells.place(stack(vectors)) if len(vectors) else [], dtype="int32")

    return df.withColumn("Cell", placed("Vector"))
