"""Queries behind the tables and charts of a report viewer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.functions.ranking import row_positions

# How a finite decimal number is spelt, with blanks around it.
NUMBER = r"^\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"


def head_preview(df: DataFrame, order: Sequence[str], rows: int = 20) -> DataFrame:
    """The first rows in a total order, with the number shown and the number there are."""
    total = df.agg(F.count(F.lit(1)).alias("TotalRows"))
    return (
        df.orderBy(*order)
        .limit(rows)
        .join(F.broadcast(total))
        .withColumn("RowsShown", F.least(F.lit(rows).cast("bigint"), F.col("TotalRows")))
    )


def table_profile(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Per column: type, row count and the values of the first three rows."""
    names = list(df.columns)
    sample = (
        df.orderBy(*order)
        .limit(3)
        .agg(*[F.collect_list(F.col(f"`{c}`").cast("string")).alias(c) for c in names])
        .unpivot([], names, "Column", "Sample")
    )
    types = F.create_map(
        *[F.lit(v) for f in df.schema.fields for v in (f.name, f.dataType.simpleString())]
    )
    total = df.agg(F.count(F.lit(1)).alias("Rows"))
    return sample.join(F.broadcast(total)).select(
        "Column", types[F.col("Column")].alias("Type"), "Rows", "Sample"
    )


def systematic_sample(df: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """Every ceil(n / limit)-th row in a unique order; all rows when there are few."""
    numbered = row_positions(df, order, name="_at")
    size = df.agg(F.count(F.lit(1)).alias("_n"))
    step = F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(limit)))
    return (
        numbered.join(F.broadcast(size))
        .where(F.pmod(F.col("_at") - 1, step) == 0)
        .drop("_at", "_n")
    )


def finite_number(name: str) -> Column:
    """The number that a column's text spells, or null.

    A cast alone also takes type suffixes (``85123D``), ``NaN`` and ``Infinity``.
    """
    text = F.col(f"`{name}`").cast("string")
    number = F.when(text.rlike(NUMBER), text).try_cast("double")
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def rows_with_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cast the columns to double and drop the rows where one is no finite number."""
    cast = df.withColumns({c: finite_number(c) for c in columns})
    for c in columns:
        cast = cast.where(F.col(c).isNotNull())
    return cast


def first_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of every non-blank key in a stated order.

    ``min_by`` keeps one row per key on the map side, so a key with most rows is no burden.
    """
    rest = [c for c in df.columns if c != key]
    return (
        df.where(F.col(key).isNotNull() & (F.col(key) != ""))
        .groupBy(key)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(key, "_row.*")
    )


def average_categories(df: DataFrame, category: str, columns: Sequence[str]) -> DataFrame:
    """One row per category with the mean of each column, blanks counted as zero."""
    return (
        df.where(F.col(category).isNotNull() & (F.col(category) != ""))
        .groupBy(category)
        .agg(*[F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in columns])
    )


def search(df: DataFrame, text: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows where one of the columns (all by default) contains the text, in any case."""
    needle = text.strip().lower()
    if not needle:
        return df
    hit = F.lit(False)
    for name in columns or df.columns:
        shown = F.lower(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")))
        hit = hit | shown.contains(needle)
    return df.where(hit)


def filter_customers(
    df: DataFrame, segment: str | None, min_spend: float, max_recency: float
) -> DataFrame:
    spend = F.coalesce(F.col("Monetary"), F.lit(0.0)) >= min_spend
    recent = F.coalesce(F.col("Recency"), F.lit(9999)) <= max_recency
    picked = df.where(spend & recent)
    return picked if segment in (None, "All") else picked.where(F.col("SegmentName") == segment)


def top_rows(df: DataFrame, metric: str, tiebreak: Sequence[str], rows: int) -> DataFrame:
    return df.orderBy(F.col(metric).desc_nulls_last(), *tiebreak).limit(rows)


def horizon_slice(forecast: DataFrame, steps: int, by: Sequence[str] = ()) -> DataFrame:
    """The first steps of a forecast, per series."""
    order = W.partitionBy(*(by or [F.lit(0)])).orderBy("Date")
    return (
        forecast.withColumn("Step", F.row_number().over(order)).where(F.col("Step") <= steps)
    )


def column_kinds(df: DataFrame) -> DataFrame:
    """Per column the rows that spell a finite number and the other non-blank rows.

    A mixed column is listed both as numeric and as text.
    """
    names = list(df.columns)

    def counted(name: str) -> Column:
        filled = F.col(f"`{name}`").cast("string").rlike(r"\S")
        number = finite_number(name).isNotNull()
        return F.struct(F.count_if(number).alias("number"), F.count_if(filled & ~number).alias("text")).alias(name)

    counts = df.agg(*[counted(c) for c in names])
    return counts.unpivot([], names, "Column", "Rows").select(
        "Column",
        F.col("Rows.number").alias("NumericRows"),
        F.col("Rows.text").alias("TextRows"),
        F.when(F.col("Rows.number") > 0, "numeric").otherwise("text").alias("Kind"),
        (F.col("Rows.number") > 0).alias("IsNumeric"),
        (F.col("Rows.text") > 0).alias("IsText"),
    )
