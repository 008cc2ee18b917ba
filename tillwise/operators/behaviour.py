"""Purchase behaviour and exploratory aggregates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwise.functions.columns import correlation, money_sum, ratio, unpivot
from tillwise.functions.ranking import exact_quantiles, hash_key, hash_positions
from tillwise.operators.features import gaps_between

# The features whose distributions and correlations are explored.
EXPLORED = (
    "Recency",
    "Frequency",
    "Monetary",
    "AvgBasketValue",
    "AvgQuantity",
    "UniqueProducts",
    "LifetimeDays",
    "PurchaseRate",
    "AvgGapDays",
    "PurchasesLast30Days",
    "SpendLast30Days",
    "CancellationRate",
    "ReturnRate",
)
GAP_LIMITS = (30, 60, 75, 90)


def invoice_dates(purchases: DataFrame) -> DataFrame:
    return purchases.groupBy("Customer_ID", "Invoice").agg(F.min("InvoiceDate").alias("InvoiceDate"))


def repeat_rate(purchases: DataFrame) -> DataFrame:
    """Share of customers with more than one invoice."""
    per_customer = (
        purchases.select("Customer_ID", "Invoice")
        .distinct()
        .groupBy("Customer_ID")
        .agg(F.count(F.lit(1)).alias("Invoices"))
    )
    return per_customer.agg(
        F.count(F.lit(1)).alias("Customers"),
        F.count_if(F.col("Invoices") > 1).alias("RepeatCustomers"),
        F.avg((F.col("Invoices") > 1).cast("double")).alias("RepeatRate"),
    )


def gap_counts(purchases: DataFrame) -> DataFrame:
    """How often each gap length occurs: one row per whole number of days."""
    return (
        gaps_between(invoice_dates(purchases))
        .groupBy("GapDays")
        .agg(F.sum("Gaps").alias("Gaps"))
    )


def gap_distribution(purchases: DataFrame) -> DataFrame:
    """Count, mean, deviation, extremes and quantiles of the gaps.

    The gap lengths are counted first; the quantiles are read off the running count of at
    most one row per day of history.
    """
    counts = gap_counts(purchases)
    upto = W.partitionBy(F.lit(0)).orderBy("GapDays")
    whole = W.partitionBy(F.lit(0))
    placed = counts.select(
        "GapDays", "Gaps", F.sum("Gaps").over(upto).alias("Upto"), F.sum("Gaps").over(whole).alias("n")
    )
    n, gap = F.col("n"), F.col("GapDays").cast("double")

    def pick(index: Column) -> Column:
        here = (F.col("Upto") - F.col("Gaps") <= index) & (index < F.col("Upto"))
        return F.max(F.when(here, gap))

    parts, values = [], []
    for name, p in (("P25", 0.25), ("Median", 0.5), ("P75", 0.75), ("P90", 0.9)):
        spot = F.lit(p) * (n - 1)
        parts += [pick(F.floor(spot)).alias(f"{name}_lo"), pick(F.ceil(spot)).alias(f"{name}_hi")]
        low, high = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        values.append((low + (high - low) * (spot - F.floor(spot))).alias(name))
    total = placed.agg(
        F.max("n").alias("n"),
        F.sum(gap * F.col("Gaps")).alias("s"),
        F.sum(gap * gap * F.col("Gaps")).alias("q"),
        F.min(gap).alias("Min"),
        F.max(gap).alias("Max"),
        *parts,
    )
    return total.select(
        n.alias("Count"),
        ratio(F.col("s"), n).alias("Mean"),
        F.sqrt(ratio(n * F.col("q") - F.col("s") * F.col("s"), n * (n - 1))).alias("Std"),
        "Min",
        *values,
        "Max",
    )


def gap_shares(purchases: DataFrame, limits: Sequence[int] = GAP_LIMITS) -> DataFrame:
    counts = gap_counts(purchases)
    total = F.sum("Gaps")
    return counts.agg(
        *[
            ratio(F.sum(F.when(F.col("GapDays") <= k, F.col("Gaps")).otherwise(0)), total).alias(f"Within{k}")
            for k in limits
        ]
    )


def month_of(when: str = "InvoiceDate") -> Column:
    return F.date_format(when, "yyyy-MM")


def invoices_per_month(lines: DataFrame) -> DataFrame:
    return lines.groupBy(month_of().alias("Month")).agg(
        F.countDistinct("Invoice").alias("InvoiceCount")
    )


def revenue_per_month(lines: DataFrame) -> DataFrame:
    return lines.groupBy(month_of().alias("Month")).agg(
        money_sum(F.col("TransactionValue")).alias("Revenue")
    )


def value_counts(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    return df.groupBy(F.col(column).alias(name or column)).agg(F.count(F.lit(1)).alias("Count"))


def top_values(df: DataFrame, column: str, rows: int, name: str | None = None) -> DataFrame:
    shown = name or column
    return value_counts(df, column, shown).orderBy(F.col("Count").desc(), shown).limit(rows)


def lines_per_hour(lines: DataFrame) -> DataFrame:
    return lines.groupBy(F.hour("InvoiceDate").alias("Hour")).agg(F.count(F.lit(1)).alias("Count"))


def lines_per_weekday(lines: DataFrame) -> DataFrame:
    """Monday first."""
    return (
        lines.groupBy(
            F.weekday("InvoiceDate").alias("DayIndex"),
            F.date_format("InvoiceDate", "EEEE").alias("Day"),
        )
        .agg(F.count(F.lit(1)).alias("Count"))
        .orderBy("DayIndex")
    )


def trimmed_sample(df: DataFrame, column: str, rows: int, identifier: str, share: float = 0.99) -> DataFrame:
    """Rows below the quantile of a column, then a repeatable sample of them."""
    edge = exact_quantiles(df, [column], {"Edge": share}).select("Edge")
    kept = df.join(F.broadcast(edge)).where(F.col(column) < F.col("Edge")).drop("Edge")
    return kept.orderBy(hash_key(identifier), identifier, column).limit(rows)


def feature_samples(df: DataFrame, columns: Sequence[str], rows: int, identifier: str = "Customer_ID") -> DataFrame:
    """Up to ``rows`` non-null values per feature in md5 order, numbered in even buckets."""
    long = unpivot(df, [identifier], list(columns), "Measure", "Value").where(
        F.col("Value").isNotNull()
    )
    return (
        hash_positions(long, identifier, ["Measure"])
        .where(F.col("Position") <= rows)
        .select("Measure", identifier, "Value")
    )


def pearson(a: str, b: str) -> Column:
    """Correlation over the rows where both values are present."""
    return correlation(F.col(a), F.col(b))


MOMENTS = ("n", "mx", "my", "vx", "vy", "c")


def pair_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, j, n, vx, vy, c) per pair of columns i <= j: rows with both values, squared deviations and their products.

    One pass: every task multiplies the matrix of its rows with itself, null masks included, and
    sends one row per pair; the tasks' means and moments are then put together.
    """
    names = list(columns)
    first, second = np.triu_indices(len(names))

    def moments(values: np.ndarray) -> np.ndarray:
        """(moment, i, j) of a block of rows, about a value of each column."""
        mask = (~np.isnan(values)).astype(float)
        filled = np.where(mask > 0, values, 0.0)
        centre = filled[mask.argmax(axis=0), np.arange(len(names))]  # the first value: a constant has no spread at all
        apart = (filled - centre) * mask
        n, sums, squares = mask.T @ mask, apart.T @ mask, (apart * apart).T @ mask
        share = 1 / np.maximum(n, 1)
        mean, spread = centre[:, None] + sums * share, squares - sums * sums * share
        return np.stack([n, mean, mean.T, spread, spread.T, apart.T @ apart - sums * sums.T * share])

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = a[0] + b[0]
        dx, dy, share = b[1] - a[1], b[2] - a[2], b[0] / np.maximum(n, 1)
        both = a[0] * share
        return np.stack(
            [n, a[1] + dx * share, a[2] + dy * share, a[3] + b[3] + dx * dx * both, a[4] + b[4] + dy * dy * both,
             a[5] + b[5] + dx * dy * both]
        )

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            if len(frame):
                mine = moments(frame.to_numpy(dtype=float))
                held = mine if held is None else joined(held, mine)
        if held is not None:
            yield pd.DataFrame({"i": first, "j": second} | {m: held[k][first, second] for k, m in enumerate(MOMENTS)})

    rows = df.select(*[F.col(c).cast("double").alias(c) for c in names])
    parts = rows.mapInPandas(partial, "i int, j int, " + ", ".join(f"{m} double" for m in MOMENTS))
    n = F.sum("n")
    means = {side: F.coalesce(ratio(F.sum(F.col("n") * F.col(side)), n), F.lit(0.0)).alias(f"{side}_all") for side in ("mx", "my")}
    held = parts.groupBy("i", "j").agg(n.alias("n"), *means.values(), F.collect_list(F.struct(*MOMENTS)).alias("parts"))

    def whole(moment: str, one: str, other: str) -> Column:
        return F.aggregate(
            "parts",
            F.lit(0.0),
            lambda t, p: t + p[moment] + p["n"] * (p[one] - F.col(f"{one}_all")) * (p[other] - F.col(f"{other}_all")),
        ).alias(moment)

    def spread(moment: str, mean: str) -> Column:
        """No spread where there is none beyond the rounding of the mean."""
        value = whole(moment, mean, mean)
        return F.when(value > 1e-18 * F.col("n") * F.pow(F.col(f"{mean}_all"), F.lit(2.0)), value).otherwise(0.0).alias(moment)

    return held.select("i", "j", "n", spread("vx", "mx"), spread("vy", "my"), whole("c", "mx", "my"))


def _pair_correlation() -> Column:
    """From the moments of a pair; null where a side is constant up to rounding."""
    return ratio(F.col("c"), F.sqrt(F.col("vx")) * F.sqrt(F.col("vy")))


def correlation_matrix(df: DataFrame, columns: Sequence[str], digits: int = 2) -> DataFrame:
    """All pairs of columns from one pass, rounded, undefined entries as 0."""
    names = list(columns)
    i, j = F.col("i"), F.col("j")
    value = F.when(i == j, F.when(F.col("vx") > 0, 1.0)).otherwise(_pair_correlation())
    one, other = F.struct(i.alias("a"), j.alias("b")), F.struct(j.alias("a"), i.alias("b"))
    sides = F.when(i == j, F.array(one)).otherwise(F.array(one, other))
    found = pair_moments(df, names).select(value.alias("_value"), F.inline(sides).alias("i", "j"))
    grid = [(x, y, a, b) for a, x in enumerate(names) for b, y in enumerate(names)]
    every = df.sparkSession.createDataFrame(grid, "X string, Y string, i int, j int")
    scale = 10.0**digits
    rounded = F.floor(F.col("_value") * scale + 0.5).cast("double") / scale
    return every.join(F.broadcast(found), ["i", "j"], "left").select(
        "X", "Y", F.coalesce(rounded, F.lit(0.0)).alias("Correlation")
    )


def label_correlations(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    names = [*columns, label]
    last = len(names) - 1
    found = pair_moments(df, names).where((F.col("j") == last) & (F.col("i") < last))
    return found.select(F.get(F.lit(names), F.col("i")).alias("Measure"), _pair_correlation().alias("Correlation")).orderBy(
        F.col("Correlation").desc_nulls_last(), "Measure"
    )


def label_profile(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Mean and quartiles of each feature per label."""
    means = (
        df.groupBy(label)
        .agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns])
        .unpivot([label], list(columns), "Measure", "Mean")
    )
    quartiles = exact_quantiles(df, columns, {"P25": 0.25, "P50": 0.5, "P75": 0.75}, [label])
    return means.join(quartiles.drop("Rows"), [label, "Measure"])


def quantiles_and_skew(df: DataFrame, column: str) -> DataFrame:
    """Upper quantiles and the bias-corrected skewness of a column."""
    quantiles = exact_quantiles(
        df, [column], {"P25": 0.25, "P50": 0.5, "P75": 0.75, "P90": 0.9, "P95": 0.95, "P99": 0.99}
    ).drop("Rows", "Measure")
    x, n = F.col(column).cast("double"), F.count(column)
    correction = F.when(n > 2, F.sqrt((n * (n - 1)).cast("double")) / F.nullif(n - 2, F.lit(0)))
    skew = df.agg((F.skewness(x) * correction).alias("Skew"))
    return quantiles.join(F.broadcast(skew))


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """Counts in equal bins from the smallest to the largest value; empty bins included."""
    values = df.select(value.cast("double").alias("_x")).where(F.col("_x").isNotNull())
    limits = values.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    place = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("_x") - F.col("_lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))
    )
    counts = (
        values.join(F.broadcast(limits))
        .groupBy(place.cast("int").alias("Bin"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    grid = limits.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("Bin"), "_lo", width.alias("_w"))
    return grid.join(counts, "Bin", "left").select(
        "Bin",
        (F.col("_lo") + F.col("Bin") * F.col("_w")).alias("BinStart"),
        F.coalesce("_n", F.lit(0)).alias("Count"),
    )


def negative_value_lines(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("TransactionValue") < 0)


def recent_customers(features: DataFrame, days: int = 15) -> DataFrame:
    return features.where(F.col("Recency") < days)
