"""Joins that keep rows whose keys are null, and broadcasts of sides whose size was checked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.functions.lineage import cut_lineage

BROADCAST_ROWS = 100_000


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where null equals null; the keys are those of ``left``.

    Null-safe equality is a hash or sort-merge join like any other.
    """
    names = {key: f"_right_{key}" for key in keys}
    renamed = right.withColumnsRenamed(names)
    same = [F.col(key).eqNullSafe(F.col(name)) for key, name in names.items()]
    return left.join(renamed, same, how).drop(*names.values())


def attach(df: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join ``side``; broadcast it when it has few rows, else leave the join to AQE."""
    written = cut_lineage(side)
    few = written.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(written) if few else written, list(keys), how)
