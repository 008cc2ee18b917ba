"""Exact nearest-neighbour classification and regression."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.operators.pieces import PIECE_ROWS, each_piece, nearest, stored


def nearest_rows(
    train: DataFrame,
    queries: DataFrame,
    columns: Sequence[str],
    target: str,
    k: int,
    power: int = 2,
    identifier: str = "Customer_ID",
    pivots: int | None = None,
    block_rows: int = PIECE_ROWS,
    fold: str | None = None,
) -> DataFrame:
    """The k nearest training rows of every query row, ties in the order of the id.

    Both sides are written in pieces once; a task takes a piece of query rows past the training
    pieces, the nearest first, until no other box comes within the k-th distances found. With
    ``fold`` (a column of both sides) only training rows of other folds count.
    """
    known = [fold] if fold else []
    valued = train.withColumn(target, F.col(target).cast("double"))
    home = stored(valued, columns, identifier, [target, *known], power, pivots, block_rows)
    going = home if queries is train else stored(queries, columns, identifier, known, power, pivots, block_rows)

    def prepared() -> Callable[[int], Iterator[pa.Table]]:
        read, going_read = home.reader(), going.reader()

        def found(number: int) -> Iterator[pa.Table]:
            mine = going_read(number)
            apart = going.gaps_from(number, home)
            distances, places = nearest(mine, home, np.argsort(apart, kind="stable"), apart, read, k, fold=fold)
            rows, place = np.nonzero(places >= 0)
            codes = places[rows, place]
            names, values = np.empty(len(codes), object), np.full(len(codes), np.nan)
            empty = np.ones(len(codes), bool)
            for piece in np.unique(codes >> 32):
                some = np.flatnonzero(codes >> 32 == piece)
                table = read(int(piece)).table.take(pa.array(codes[some] & 0xFFFFFFFF))
                names[some] = table.column("Id").to_numpy()
                values[some] = table.column(target).to_numpy()
                empty[some] = table.column(target).is_null().to_numpy()
            columns = [
                mine.table.column("Id").take(pa.array(rows)), pa.array(names, pa.string()), pa.array(values, mask=empty),
                pa.array(distances[rows, place]), pa.array(place + 1, pa.int32()),
            ]
            yield pa.table([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=names_out)

        return found

    names_out = [identifier, "Neighbour", "Target", "Distance", "Place"]
    schema = f"{identifier} string, Neighbour string, Target double, Distance double, Place int"
    return each_piece(train.sparkSession, len(going.paths), prepared, schema)


def _weighted(found: DataFrame, weights: str, identifier: str) -> DataFrame:
    """Weighted mean of the neighbours' targets. At distance zero only those rows count."""
    if weights == "uniform":
        return found.groupBy(identifier).agg(F.avg("Target").alias("Value"))
    exact = F.col("Distance") == 0
    inverse = F.when(~exact, 1 / F.nullif(F.col("Distance"), F.lit(0.0)))
    return found.groupBy(identifier).agg(
        F.coalesce(
            F.avg(F.when(exact, F.col("Target"))), F.sum(F.col("Target") * inverse) / F.sum(inverse)
        ).alias("Value")
    )


def knn_classify(
    train: DataFrame, queries: DataFrame, columns: Sequence[str], label: str, k: int = 5,
    weights: str = "uniform", identifier: str = "Customer_ID", **options,
) -> DataFrame:
    """Share of positive neighbours as score; the class needs more than half."""
    found = nearest_rows(train, queries, columns, label, k, identifier=identifier, **options)
    return _weighted(found, weights, identifier).select(
        identifier,
        F.col("Value").alias("Score"),
        (F.col("Value") > 0.5).cast("int").alias("Decision"),
    )


def knn_regress(
    train: DataFrame, queries: DataFrame, columns: Sequence[str], target: str, k: int = 5,
    weights: str = "uniform", identifier: str = "Customer_ID", **options,
) -> DataFrame:
    found = nearest_rows(train, queries, columns, target, k, identifier=identifier, **options)
    return _weighted(found, weights, identifier).withColumnRenamed("Value", "Predicted")
