"""Imputation, scaling, splits and samples. Statistics come from the fitted frame only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.columns import ratio, safe_log1p
from tillwise.functions.ranking import exact_quantiles, hash_key, hash_positions

# Names and order of the columns.
LOG_FEATURES = (
    "Frequency",
    "Monetary",
    "AvgBasketValue",
    "UniqueProducts",
    "SpendLast30Days",
    "SpendLast90Days",
    "SpendPrior90Days",
    "RevenuePerDay",
    "AvgSpendPerProduct",
    "ProductDiversityRate",
)
SCALE_FEATURES = (
    "AvgQuantity",
    "Recency",
    "LifetimeDays",
    "PurchaseRate",
    "AvgGapDays",
    "StdGapDays",
    "PurchasesLast30Days",
    "PurchasesLast90Days",
    "ReturnRate",
    "IsNewCustomer",
    "RecencyFrequency",
    "SpendTrendRatio",
    "FrequencyLast90DaysRatio",
)


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the exact median of every column, under the column's own name."""
    long = exact_quantiles(df, columns, {"Median": 0.5})
    return long.agg(
        *[F.max(F.when(F.col("Measure") == c, F.col("Median"))).alias(c) for c in columns]
    )


def impute_median(
    df: DataFrame, columns: Sequence[str], fitted_on: DataFrame | None = None
) -> DataFrame:
    """Fill nulls with the median of the fitted frame; the one-row statistics are broadcast."""
    stats = medians(fitted_on if fitted_on is not None else df, columns).select(
        *[F.col(c).alias(f"_median_{c}") for c in columns]
    )
    filled = df.join(F.broadcast(stats)).withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.col(f"_median_{c}")) for c in columns}
    )
    return filled.select(*df.columns)


def log_columns(df: DataFrame, columns: Sequence[str], clip: bool = False) -> DataFrame:
    def logged(name: str) -> Column:
        value = F.col(name).cast("double")
        return safe_log1p(value) if clip else F.log1p(value)

    return df.withColumns({c: logged(c) for c in columns})


def scaling_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(
        *[F.avg(F.col(c).cast("double")).alias(f"_mean_{c}") for c in columns],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"_std_{c}") for c in columns],
    )


def standardise(
    df: DataFrame, columns: Sequence[str], fitted_on: DataFrame | None = None
) -> DataFrame:
    """Subtract the mean and divide by the population deviation; a constant column gives 0."""
    stats = scaling_stats(fitted_on if fitted_on is not None else df, columns)

    def scaled(name: str) -> Column:
        spread = F.when(F.col(f"_std_{name}") == 0, 1.0).otherwise(F.col(f"_std_{name}"))
        return (F.col(name).cast("double") - F.col(f"_mean_{name}")) / spread

    return (
        df.join(F.broadcast(stats)).withColumns({c: scaled(c) for c in columns}).select(*df.columns)
    )


def scaled_matrix(
    df: DataFrame,
    log: Sequence[str] = LOG_FEATURES,
    plain: Sequence[str] = SCALE_FEATURES,
    fitted_on: DataFrame | None = None,
    keep: Sequence[str] = ("Customer_ID",),
) -> DataFrame:
    """Impute, log (first group only) and scale; every other column but ``keep`` is dropped.

    One pass finds the medians, one the moments of the filled and logged columns.
    """
    fit = fitted_on if fitted_on is not None else df
    names = [*log, *plain]
    middle = medians(fit, names).select(*[F.col(c).alias(f"_median_{c}") for c in names])

    def prepared(frame: DataFrame, kept: Sequence[str]) -> DataFrame:
        def value(name: str) -> Column:
            filled = F.coalesce(F.col(name).cast("double"), F.col(f"_median_{name}"))
            return (safe_log1p(filled) if name in log else filled).alias(name)

        return frame.join(F.broadcast(middle)).select(*kept, *[value(c) for c in names])

    return standardise(prepared(df, list(keep)), names, prepared(fit, []))


def split_rows(
    df: DataFrame, test_share: float = 0.2, strata: Sequence[str] = (), identifier: str = "Customer_ID"
) -> DataFrame:
    """Add ``Split``: the first share of each stratum in md5 order is test, the rest train."""
    placed = hash_positions(df, identifier, strata)
    is_test = F.col("Position") <= F.ceil(F.col("StratumSize") * F.lit(test_share))
    return placed.withColumn("Split", F.when(is_test, "test").otherwise("train")).drop(
        "Position", "StratumSize"
    )


def finite_or_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Infinite and not-a-number values become null, then the median, then zero."""
    infinite = F.lit(float("inf"))
    cleaned = df.withColumns(
        {
            c: F.when(F.isnan(c) | (F.abs(F.col(c)) == infinite), F.lit(None)).otherwise(
                F.col(c).cast("double")
            )
            for c in columns
        }
    )
    return impute_median(cleaned, columns).fillna(0.0, subset=list(columns))


def class_weights(df: DataFrame, label: str = "RetentionLabel") -> DataFrame:
    """Per class: rows, balanced weight n / (2 * n_class) and the negative to positive ratio."""
    counts = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(label) == 0).alias("n0"),
        F.count_if(F.col(label) == 1).alias("n1"),
    )
    one = F.struct(F.lit(1).alias("Label"), F.col("n1").alias("Rows"), ratio(F.col("n"), 2 * F.col("n1")).alias("Weight"))
    zero = F.struct(F.lit(0).alias("Label"), F.col("n0").alias("Rows"), ratio(F.col("n"), 2 * F.col("n0")).alias("Weight"))
    return counts.select(
        F.inline(F.array(zero, one)), ratio(F.col("n0"), F.col("n1")).alias("NegativeToPositive")
    )



def hash_sample(df: DataFrame, rows: int, identifier: str = "Customer_ID") -> DataFrame:
    """A repeatable sample: the first rows in the md5 order of the id."""
    return df.orderBy(hash_key(identifier), identifier).limit(rows)
