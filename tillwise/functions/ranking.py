"""Ranks, running totals and exact quantiles over whole tables, without a one-task window.

A window without a partition key moves every row into one task. Here the rows are range
partitioned by the sort order instead (a hot value is split too, because the order ends in
a unique key or the rows are counted per value first), each partition is summed on its own
and the totals of the earlier partitions, one row per partition, are added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwise.functions.columns import unpivot
from tillwise.functions.joins import join_on
from tillwise.functions.lineage import cut_lineage


def running_totals(
    df: DataFrame,
    order: Sequence[Column],
    sums: dict[str, Column],
    by: Sequence[str] = (),
) -> DataFrame:
    """Add, per name in ``sums``, the total over the rows up to and including each row.

    ``by`` restarts the totals per group; ``order`` must be unique within a group.
    """
    groups = list(by)
    placed = cut_lineage(
        df.orderBy(*groups, *order).withColumn("_part", F.spark_partition_id())
    )
    per_part = placed.groupBy("_part", *groups).agg(
        *[F.sum(expr).alias(f"_{name}_sum") for name, expr in sums.items()]
    )
    earlier = W.partitionBy(*(groups or [F.lit(0)])).orderBy("_part").rowsBetween(
        W.unboundedPreceding, -1
    )
    offsets = per_part.select(
        "_part",
        *groups,
        *[
            F.coalesce(F.sum(f"_{name}_sum").over(earlier), F.lit(0)).alias(f"_{name}_before")
            for name in sums
        ],
    )
    inside = W.partitionBy("_part", *groups).orderBy(*order).rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    local = placed.select("*", *[F.sum(expr).over(inside).alias(f"_{n}_in") for n, expr in sums.items()])
    joined = join_on(local, offsets, ["_part", *groups])
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[(F.col(f"_{name}_in") + F.col(f"_{name}_before")).alias(name) for name in sums],
    )


def row_positions(
    df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), name: str = "Position"
) -> DataFrame:
    """Add the 1-based position of each row in a unique order."""
    return running_totals(df, order, {name: F.lit(1).cast("bigint")}, by)


def average_ranks(df: DataFrame, value: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct value with its count and its average rank (ties share the mean)."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("Copies"))
    ranked = running_totals(counts, [F.col(value)], {"_upto": F.col("Copies")}, by)
    rank = F.col("_upto") - (F.col("Copies") - 1) / F.lit(2.0)
    return ranked.select(*by, value, "Copies", rank.alias(name))


#: Rank error of the sketch that brackets a quantile: one in so many rows.
SKETCH = 10_000
#: Groups of fewer rows are selected from as a whole.
FEW_ROWS = 20_000


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: dict[str, float],
    by: Sequence[str] = (),
) -> DataFrame:
    """Linearly interpolated quantiles: one row per group and column (``Measure``).

    Exact, without a sort of the rows: a sketch brackets every quantile, one pass counts the rows
    below the bracket and keeps those inside, and only these (a few in ten thousand, counted per
    value, so that a value held by a third of all rows is one) are sorted. Where a rank lies
    outside its bracket all rows of the group are sorted.
    """
    groups, names = [*by, "Measure"], list(probabilities)
    rows = cut_lineage(df.select(*by, *dict.fromkeys(c for c in columns if c not in by)))
    long = unpivot(rows, list(by), list(columns), "Measure", "Value").where(F.col("Value").isNotNull())
    ends = [min(1.0, max(0.0, p + side * 4 / SKETCH)) for p in probabilities.values() for side in (-1, 1)]
    stats = cut_lineage(
        long.groupBy(*groups).agg(F.percentile_approx("Value", ends, SKETCH).alias("_ends"), F.count(F.lit(1)).alias("_n"))
    )
    bracketed = join_on(long, stats if by else F.broadcast(stats), groups)
    few = F.col("_n") <= FEW_ROWS
    low = [F.col("_ends")[2 * k] for k in range(len(names))]
    high = [F.col("_ends")[2 * k + 1] for k in range(len(names))]
    below = bracketed.groupBy(*groups).agg(
        *[F.count_if(~few & (F.col("Value") < low[k])).alias(f"_below{k}") for k in range(len(names))]
    )
    which = F.array_compact(
        F.array(*[F.when(few | F.col("Value").between(low[k], high[k]), F.lit(k)) for k in range(len(names))])
    )
    inside = bracketed.select(*groups, "Value", F.explode(which).alias("_k")).groupBy(*groups, "_k", "Value").agg(
        F.count(F.lit(1)).alias("Copies")
    )
    order = W.partitionBy(*groups, "_k").orderBy("Value").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = inside.withColumn("_upto", F.sum("Copies").over(order))
    counted = join_on(placed, join_on(below, stats.drop("_ends"), groups), groups)
    picks = []
    for k, (name, p) in enumerate(probabilities.items()):
        upto = F.col("_upto") + F.col(f"_below{k}")
        for side, index in _spots(p):
            here = (F.col("_k") == k) & (upto - F.col("Copies") <= index) & (index < upto)
            picks.append(F.max(F.when(here, F.col("Value"))).alias(f"_{name}_{side}"))
    found = cut_lineage(join_on(stats.drop("_ends"), counted.groupBy(*groups).agg(*picks), groups, "left"))
    sides = [F.col(f"_{name}_{side}") for name in names for side in ("lo", "hi")]
    whole = F.lit(True)
    for side in sides:
        whole = whole & side.isNotNull()
    if found.where(~whole).limit(1).count():
        missed = join_on(long, found.where(~whole).select(*groups), groups, "left_semi")
        found = found.where(whole).unionByName(_sorted_picks(missed, probabilities, groups))
    values = []
    for name, p in probabilities.items():
        spot = F.lit(p) * (F.col("_n") - 1)
        low_value, high_value = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        values.append((low_value + (high_value - low_value) * (spot - F.floor(spot))).alias(name))
    return found.select(*groups, F.col("_n").alias("Rows"), *values)


def _spots(p: float) -> list[tuple[str, Column]]:
    spot = F.lit(p) * (F.col("_n") - 1)
    return [("lo", F.floor(spot)), ("hi", F.ceil(spot))]


def _sorted_picks(long: DataFrame, probabilities: dict[str, float], groups: Sequence[str]) -> DataFrame:
    """The values around every quantile from running counts of all values."""
    counts = long.groupBy(*groups, "Value").agg(F.count(F.lit(1)).alias("Copies"))
    placed = running_totals(counts, [F.col("Value")], {"_upto": F.col("Copies")}, groups)
    rows = join_on(placed, placed.groupBy(*groups).agg(F.sum("Copies").alias("_n")), groups)
    picks = [
        F.max(
            F.when((F.col("_upto") - F.col("Copies") <= index) & (index < F.col("_upto")), F.col("Value"))
        ).alias(f"_{name}_{side}")
        for name, p in probabilities.items()
        for side, index in _spots(p)
    ]
    return rows.groupBy(*groups).agg(F.max("_n").alias("_n"), *picks)


def hash_key(identifier: str) -> Column:
    return F.md5(F.col(identifier).cast("string"))


def hash_positions(
    df: DataFrame, identifier: str, strata: Sequence[str] = (), digits: int = 3
) -> DataFrame:
    """Add ``Position`` and ``StratumSize`` in the order of the md5 of a unique id.

    The first hash digits cut every stratum into 16**digits even buckets, so a stratum that
    holds most rows still spreads over all tasks. The per-bucket counts are the only thing
    that is joined back.
    """
    groups = list(strata)
    keyed = df.withColumn("_hash", hash_key(identifier)).withColumn(
        "_bucket", F.substring("_hash", 1, digits)
    )
    buckets = keyed.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    stratum = W.partitionBy(*(groups or [F.lit(0)]))
    before = stratum.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = buckets.select(
        *groups,
        "_bucket",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(stratum).alias("StratumSize"),
    )
    inside = W.partitionBy(*groups, "_bucket").orderBy("_hash", F.col(identifier))
    numbered = keyed.withColumn("_in", F.row_number().over(inside))
    joined = join_on(numbered, offsets, [*groups, "_bucket"])
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        (F.col("_in") + F.col("_before")).alias("Position"),
        "StratumSize",
    )


def join_ranks(df: DataFrame, ranks: DataFrame, value: str, name: str, identifier: str) -> DataFrame:
    """Attach the rank of ``value`` to every row, also when one value holds most rows.

    A value with more than a thousandth of all rows is hot; there are fewer than a thousand
    of those, so their ranks are broadcast. Only the other rows meet their rank by a shuffle
    join; the hot ones spread over it by the hash of their id and match nothing.
    """
    total = ranks.agg(F.sum("Copies").alias("_rows"))
    sized = ranks.join(F.broadcast(total))
    hot = sized.where(F.col("Copies") * 1000 > F.col("_rows")).select(
        value, F.col(name).alias("_hot_rank")
    )
    rest = sized.where(F.col("Copies") * 1000 <= F.col("_rows")).select(
        F.col(value).alias("_key"), F.lit(0).alias("_salt"), F.col(name).alias("_cold_rank")
    )
    is_hot = F.col("_hot_rank").isNotNull()
    spread = df.join(F.broadcast(hot), value, "left").withColumns(
        {
            "_key": F.when(~is_hot, F.col(value)),
            "_salt": F.when(is_hot, F.pmod(F.xxhash64(identifier), F.lit(4096)).cast("int")).otherwise(0),
        }
    )
    return spread.join(rest, ["_key", "_salt"], "left").select(
        *df.columns, F.coalesce("_hot_rank", "_cold_rank").alias(name)
    )
