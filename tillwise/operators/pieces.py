"""Rows in pieces: neighbouring rows lie in one file of the shared folder, and a task reads the pieces it has to meet.

Rows are written once, whatever the number of pieces that meet. A piece belongs to a cell of the
k-d tree (a cell with many rows, equal ones even, has several) and its rows lie leaf by leaf, each leaf of
some 64 rows with its own box. A task takes one piece past the others, the nearest box first, and
returns whole results of its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.functions import shared
from tillwise.operators.blocks import (
    MAX_TASKS,
    ROUNDING,
    ROWS_PER_CELL,
    Cells,
    Rough,
    build_cells,
    kd_tree,
    matrix_of,
    pair_distances,
    per_cell,
    with_vector,
)

PIECE_ROWS = 2 * ROWS_PER_CELL  # a cell with more rows has several pieces
LEAF_ROWS = 64
KEPT_PIECES = 128  # that a task holds at once
TASKS_PER_CORE = 8
MANY = 4  # times the wanted neighbours: so many candidates a row are narrowed before they are compared exactly


def gaps(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray, power: int = 2) -> np.ndarray:
    """The distance of every box to every other box; a row is a box without size."""
    total = np.zeros((len(low), len(other_low)))
    for j in range(low.shape[1]):
        step = np.maximum(other_low[:, j] - high[:, j, None], low[:, j, None] - other_high[:, j])
        np.maximum(step, 0.0, out=step)
        total += step if power == 1 else step * step
    return total if power == 1 else np.sqrt(total)


def loosened(reach):
    """A reach moved out by more than the rounding of boxes and distances."""
    return reach * (1 + 1e-9) + 2 * ROUNDING


class Piece:
    """The rows of one file, leaf by leaf."""

    def __init__(self, number: int, table: pa.Table, power: int):
        self.number, self.table, self.power = number, table, power
        self.vectors = shared.column_matrix(table, "Vector")
        leaf = table.column("Leaf").to_numpy()
        self.starts = np.flatnonzero(np.diff(leaf, prepend=-1))
        self.ends = np.append(self.starts[1:], len(leaf))
        self.low = np.minimum.reduceat(self.vectors, self.starts, axis=0)
        self.high = np.maximum.reduceat(self.vectors, self.starts, axis=0)

    @cached_property
    def ids(self) -> np.ndarray:
        """The ids as bytes, which sort as the texts do."""
        names = self.table.column("Name").combine_chunks()
        return np.frombuffer(names.buffers()[1], f"S{names.type.byte_width}", len(names), names.offset * names.type.byte_width)

    @cached_property
    def rough(self) -> Rough:
        return Rough(self.vectors, self.power)

    def rows_of(self, leaves: np.ndarray) -> np.ndarray:
        return np.concatenate([np.arange(self.starts[i], self.ends[i]) for i in np.flatnonzero(leaves)])


@dataclass(frozen=True)
class Pieces:
    """The files and the boxes around their rows."""

    paths: list[str]
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray
    power: int

    def reader(self) -> Callable[[int], Piece]:
        """Reads pieces and keeps the last ones."""
        return lru_cache(KEPT_PIECES)(lambda number: Piece(int(number), shared.load(self.paths[number]), self.power))

    def gaps_from(self, number: int, other: Pieces) -> np.ndarray:
        some = slice(number, number + 1)
        return gaps(self.low[some], self.high[some], other.low, other.high, self.power)[0]


def stored(
    df: DataFrame, columns: Sequence[str], identifier: str, keep: Sequence[str] = (), power: int = 2,
    pivots: int | None = None, block_rows: int = PIECE_ROWS,
) -> Pieces:
    """Write the rows in pieces of at most some ``block_rows``."""
    spark = df.sparkSession
    text = df.withColumn(identifier, F.col(identifier).cast("string"))
    home, cells = build_cells(with_vector(text, columns, [identifier, *keep]), identifier, power, pivots)
    blocks = cells.blocks(cells.rows, block_rows)
    folder = shared.shared_folder(spark, "pieces")

    def written(rows: pa.Table) -> pa.Table:
        vectors = matrix_of(rows, "Vector")
        feature, cut, below = kd_tree(vectors, -(-len(vectors) // LEAF_ROWS))
        leaf = Cells(feature, cut, below, power, *[np.zeros(0)] * 3).place(vectors)
        order = np.argsort(leaf, kind="stable")
        ids = [v.encode() for v in rows.column(identifier).to_pylist()]
        width = max(1, *map(len, ids))
        bytes_of = pa.array([v.ljust(width, b"\0") for v in ids], pa.binary(width))
        table = pa.table(
            {"Id": rows.column(identifier), "Name": bytes_of, "Vector": shared.matrix_column(vectors), "Leaf": pa.array(leaf)}
            | {name: rows.column(name) for name in keep}
        ).take(pa.array(order))
        place = [rows.column("Cell")[0].as_py(), rows.column("_h")[0].as_py()]
        found = [*place, shared.save(folder, table), len(vectors), vectors.min(axis=0).tolist(), vectors.max(axis=0).tolist()]
        return pa.Table.from_arrays([pa.array([v], kind) for v, kind in zip(found, kinds, strict=True)], names=names)

    names = ["Cell", "Block", "Path", "Rows", "Low", "High"]
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
    schema = "Cell int, Block int, Path string, Rows bigint, Low array<double>, High array<double>"
    tasks = min(MAX_TASKS, max(spark.sparkContext.defaultParallelism, int(blocks.sum()) // 4))
    dealt = home.withColumn("_h", F.pmod(F.xxhash64(identifier), per_cell(blocks)).cast("int"))
    made = dealt.repartition(tasks, "Cell", "_h").groupBy("Cell", "_h").applyInArrow(written, schema).collect()
    made.sort(key=lambda row: (row["Cell"], row["Block"]))
    low, high = (np.array([row[name] for row in made], float).reshape(len(made), len(columns)) for name in ("Low", "High"))
    return Pieces([row["Path"] for row in made], np.array([row["Rows"] for row in made], int), low, high, power)


def each_piece(
    spark: SparkSession, count: int, prepared: Callable[[], Callable[[int], Iterator[pa.Table]]], schema: str
) -> DataFrame:
    """Run the work that ``prepared`` returns on the number of every piece; a task takes few, which mostly meet the same others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = prepared()
        for batch in batches:
            for number in batch.column(0).to_pylist():
                for table in work(number):
                    yield from table.to_batches()

    tasks = min(MAX_TASKS, count, max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, count // 4))
    return spark.range(0, count, 1, max(1, tasks)).mapInArrow(run, schema)


def nearest(
    mine: Piece, pieces: Pieces, order: np.ndarray, apart: np.ndarray, read: Callable[[int], Piece],
    k: int, cap: float = np.inf, fold: str | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Per row the distances and places (piece << 32 | row) of its k nearest rows within the cap, ties by id.

    ``order`` names the pieces to meet, nearest box first, ``apart`` their distances. The k-th distance
    found so far bounds what a row still has to meet.
    """
    size = len(mine.vectors)
    best, places = np.full((size, k), np.inf), np.full((size, k), -1, np.int64)
    names, bound = np.zeros((size, k), "S1"), np.full(size, cap)
    folds = mine.table.column(fold).to_numpy() if fold else None
    for number in order:
        if apart[number] > loosened(bound.max()):
            break
        box = slice(number, number + 1)
        open_rows = gaps(mine.vectors, mine.vectors, pieces.low[box], pieces.high[box], pieces.power)[:, 0] <= loosened(bound)
        if not open_rows.any():
            continue
        other = read(number)
        leaves = gaps(mine.low, mine.high, other.low, other.high, pieces.power)
        other_folds = other.table.column(fold).to_numpy() if fold else None
        if names.dtype.itemsize < other.ids.dtype.itemsize:
            names = names.astype(other.ids.dtype)
        for group, (start, end) in enumerate(zip(mine.starts, mine.ends, strict=True)):
            rows = np.flatnonzero(open_rows[start:end]) + start
            if not len(rows):
                continue
            met = leaves[group] <= loosened(bound[rows].max())
            if not met.any():
                continue
            at = None if met.all() else other.rows_of(met)
            left = mine.vectors[rows]
            squares, error = other.rough.to(left, at)
            if fold:
                squares[folds[rows, None] == (other_folds if at is None else other_folds[at])] = np.inf
            limit = other.rough.limit(bound[rows])
            near = (squares <= (limit + error)[:, None]) & (squares < np.inf)
            if np.count_nonzero(near) > MANY * k * len(rows):
                farthest = np.partition(squares, k - 1, axis=1)[:, k - 1] + error
                if pieces.power == 2:
                    farthest = np.sqrt(np.maximum(farthest, 0.0))
                near &= squares <= (other.rough.limit(farthest) + error)[:, None]
            r, c = np.nonzero(near)
            if not len(r):
                continue
            c = c if at is None else at[c]
            exact = pair_distances(left[r], other.vectors[c], pieces.power)
            kept = exact <= bound[rows][r]
            r, c, exact = r[kept], c[kept], exact[kept]
            held = np.nonzero(np.isfinite(best[rows]))
            r = np.concatenate([held[0], r])
            d = np.concatenate([best[rows][held], exact])
            p = np.concatenate([places[rows][held], (np.int64(number) << 32) | c])
            n = np.concatenate([names[rows][held], other.ids[c]])
            sort = np.lexsort((d, r))
            if ((np.diff(r[sort]) == 0) & (np.diff(d[sort]) == 0)).any():
                sort = np.lexsort((n, d, r))
            r, d, p, n = r[sort], d[sort], p[sort], n[sort]
            rank = np.arange(len(r)) - np.searchsorted(r, r)
            kept = rank < k
            best[rows[r[kept]], rank[kept]] = d[kept]
            places[rows[r[kept]], rank[kept]] = p[kept]
            names[rows[r[kept]], rank[kept]] = n[kept]
            bound[rows] = np.minimum(bound[rows], best[rows, k - 1])
    return best, places
