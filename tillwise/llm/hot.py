"""Joins with one row per key, where one key may hold a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parameter: keys of more than a thousandth of all rows are broadcast, fewer than 1,000 of them.
SHARE = 1000


def join_by_size(rows: DataFrame, side: DataFrame, keys: Sequence[str], size: Column, total: int) -> DataFrame:
    """Inner join of a side whose ``size`` column counts the rows of its key, of ``total`` in all.

    Hot keys meet their rows by a broadcast, the others by a shuffle join. Keys are not null; both
    frames are read twice, so they should be written ones.
    """
    keys = list(keys)
    is_hot = size > total // SHARE
    hot, cold = F.broadcast(side.where(is_hot)), side.where(~is_hot)
    return rows.join(hot, keys).unionByName(rows.join(hot, keys, "left_anti").join(cold, keys))
