"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY_UNITS = 10000.0
SECONDS_PER_DAY = 86400


def money(value: Column) -> Column:
    """A line amount in ten-thousandths as bigint.

    Whole numbers make sums independent of the row order, and they stay in registers where
    wide decimals would not. A sum past 9.2e14 currency units raises, it never wraps.
    """
    return F.rint(value.cast("double") * MONEY_UNITS).cast("bigint")


def from_money(units: Column) -> Column:
    return units / F.lit(MONEY_UNITS)


def money_sum(value: Column) -> Column:
    return from_money(F.sum(money(value)))


def whole_days(start: Column, end: Column) -> Column:
    """Elapsed time from start to end in completed days (not midnights crossed)."""
    return F.floor(F.timestamp_diff("SECOND", start, end) / SECONDS_PER_DAY).cast("bigint")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives null, not an error, on a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def correlation(a: Column, b: Column) -> Column:
    """Aggregate: Pearson correlation over rows with both values, null for a constant side.

    The built-in ``corr`` divides by zero there, which raises in ANSI mode.
    """
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def safe_log1p(value: Column) -> Column:
    return F.log1p(F.greatest(value.cast("double"), F.lit(0.0)))


def title_case(text: Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the others.

    ``initcap`` only starts a word after a blank. Text with a letter right behind another
    non-letter gets a marked blank there first, taken out again afterwards.
    """
    trimmed = F.trim(text)
    marked = F.regexp_replace(trimmed, r"([^\p{L}\s])", "$1\u0001 ")
    inner = trimmed.rlike(r"[^\p{L}\s]\p{L}")
    return F.when(inner, F.regexp_replace(F.initcap(marked), "\u0001 ", "")).otherwise(
        F.initcap(trimmed)
    )


#: Where rounding goes up. A hair under the half: sums taken in another order differ there.
HALF = 0.50003


def half_up(value: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.floor(value * scale + HALF).cast("double") / scale


def settled(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column half up, so that results can be compared across engines."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            column = half_up(column, special.get(field.name, digits)).alias(field.name)
        columns.append(column)
    return df.select(*columns)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def unpivot(df: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """Long form: one row per key and column, values as double."""
    wide = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot(list(keys), list(columns), name, value)
