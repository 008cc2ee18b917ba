"""Cleaning of invoice lines, line flags and purchase filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwise.functions.columns import money_sum, title_case
from tillwise.functions.ranking import exact_quantiles

# Stock codes that stand for postage, fees and bank entries, not for products.
NON_PRODUCT_CODES = ("POST", "DOT", "BANK CHARGES", "AMAZONFEE", "MANUAL", "CRUK")


def trim_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.strip().replace(" ", "_") for name in df.columns])


def resolve_column(df: DataFrame, aliases: Sequence[str]) -> str:
    """The first of the aliases the frame has."""
    for name in aliases:
        if name in df.columns:
            return name
    raise ValueError(f"none of the columns {list(aliases)} is in {df.columns}")


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def drop_missing_customer(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["Customer_ID"])


def parse_timestamps(df: DataFrame, column: str = "InvoiceDate") -> DataFrame:
    return df.withColumn(column, F.col(column).cast("timestamp_ntz"))


def customer_id_text(df: DataFrame) -> DataFrame:
    return df.withColumn("Customer_ID", F.col("Customer_ID").cast("bigint").cast("string"))


def normalise_codes(df: DataFrame) -> DataFrame:
    return df.withColumn("StockCode", F.upper(F.trim(F.col("StockCode").cast("string"))))


def title_countries(df: DataFrame) -> DataFrame:
    return df.withColumn("Country", title_case(F.col("Country").cast("string")))


def drop_exact_copies(df: DataFrame, first: Sequence[str] = ()) -> DataFrame:
    """One row of all that are equal in every column; null equals null.

    Rows that were dealt by some of the columns in ``first`` are sorted in their tasks, by these columns
    first, and each is held against the row before it. Hashing would build two tables of whole rows per
    task, one for the partial and one for the final groups.
    """
    if not first:
        return df.dropDuplicates()
    names = [*first, *[c for c in df.columns if c not in first]]
    alike = W.partitionBy(*names).orderBy(names[0])
    return df.withColumn("_before", F.lag(F.lit(1)).over(alike)).where(F.col("_before").isNull()).drop("_before")


def positive_price(df: DataFrame) -> DataFrame:
    return df.where(F.col("Price") > 0)


def false_if_null(condition: Column) -> Column:
    """A missing invoice, quantity or code carries no flag."""
    return F.coalesce(condition, F.lit(False))


def flag_cancelled(df: DataFrame) -> DataFrame:
    return df.withColumn("IsCancelled", false_if_null(F.col("Invoice").cast("string").startswith("C")))


def flag_return(df: DataFrame) -> DataFrame:
    return df.withColumn("IsReturn", false_if_null(F.col("Quantity") <= 0))


def flag_non_product(df: DataFrame) -> DataFrame:
    return df.withColumn("IsNonProduct", false_if_null(F.col("StockCode").isin(*NON_PRODUCT_CODES)))


def transaction_value(df: DataFrame) -> DataFrame:
    return df.withColumn("TransactionValue", F.col("Quantity") * F.col("Price"))


def tidy(raw: DataFrame) -> DataFrame:
    """Headers, types and text normalised; no row dropped."""
    return (
        raw.transform(trim_headers)
        .transform(parse_timestamps)
        .transform(customer_id_text)
        .transform(normalise_codes)
        .transform(title_countries)
    )


def clean_lines(raw: DataFrame) -> DataFrame:
    """From raw invoice lines to flagged, deduplicated, priced lines of known customers.

    The price filter commutes with the removal of whole-row copies, so both filters run in
    the scan, before the only shuffle. That one deals the lines by customer and invoice, as
    copies share both, so sums per invoice need no further shuffle; the lines of one invoice
    of one customer meet in a task, sorted by code.
    """
    return (
        tidy(raw)
        .transform(drop_missing_customer)
        .transform(positive_price)
        .repartition("Customer_ID", "Invoice")
        .transform(drop_exact_copies, ["Customer_ID", "Invoice", "StockCode"])
        .transform(flag_cancelled)
        .transform(flag_return)
        .transform(flag_non_product)
        .transform(transaction_value)
    )


def chronological(df: DataFrame) -> DataFrame:
    """For sinks only: every other operator states the order it needs."""
    return df.orderBy("Customer_ID", "InvoiceDate", "Invoice", "StockCode", "Quantity", "Price")


def genuine_purchases(df: DataFrame) -> DataFrame:
    for flag in ("IsCancelled", "IsReturn", "IsNonProduct"):
        df = df.where(~false_if_null(F.col(flag)))
    return df


def strict_purchases(df: DataFrame) -> DataFrame:
    return genuine_purchases(df).where(
        (F.col("Quantity") > 0)
        & (F.col("Price") > 0)
        & (F.col("TransactionValue") > 0)
        & F.col("Customer_ID").isNotNull()
    )


def ensure_flags(df: DataFrame) -> DataFrame:
    """Derive the flag and value columns a frame does not carry yet."""
    for name, derive in (
        ("TransactionValue", transaction_value),
        ("IsCancelled", flag_cancelled),
        ("IsReturn", flag_return),
        ("IsNonProduct", flag_non_product),
    ):
        if name not in df.columns:
            df = derive(df)
    return df


def cleaning_funnel(raw: DataFrame) -> DataFrame:
    """Rows left after each cleaning stage, in one pass over the lines."""
    lines = tidy(raw)
    copies = lines.groupBy(*lines.columns).agg(F.count(F.lit(1)).alias("Copies"))
    known = F.col("Customer_ID").isNotNull()
    priced = known & (F.col("Price") > 0)
    code = F.col("StockCode").isin(*NON_PRODUCT_CODES)
    return copies.agg(
        F.sum("Copies").alias("RawRows"),
        F.sum(F.when(known, F.col("Copies")).otherwise(0)).alias("RowsWithCustomer"),
        F.count_if(known).alias("DistinctRows"),
        F.count_if(priced).alias("PricedRows"),
        F.sum(F.when(known, 0).otherwise(F.col("Copies"))).alias("MissingCustomerRows"),
        F.sum(F.when(known, F.col("Copies") - 1).otherwise(0)).alias("DuplicateRows"),
        F.count_if(known & ~(F.col("Price") > 0)).alias("BadPriceRows"),
        F.count_if(priced & code).alias("NonProductRows"),
    )


def cleaning_summary(lines: DataFrame) -> DataFrame:
    """Distinct customers and invoices, date range and flag counts of clean lines.

    Lines are summed per customer and invoice first, so the two distinct counts expand
    invoices, not lines.
    """
    per_invoice = lines.groupBy("Customer_ID", "Invoice").agg(
        F.count(F.lit(1)).alias("Lines"),
        F.min("InvoiceDate").alias("First"),
        F.max("InvoiceDate").alias("Last"),
        F.count_if("IsCancelled").alias("Cancelled"),
        F.count_if("IsReturn").alias("Returned"),
        F.count_if("IsNonProduct").alias("NonProduct"),
    )
    return per_invoice.agg(
        F.sum("Lines").alias("Rows"),
        F.countDistinct("Customer_ID").alias("Customers"),
        F.countDistinct("Invoice").alias("Invoices"),
        F.min("First").alias("FirstDate"),
        F.max("Last").alias("LastDate"),
        F.sum("Cancelled").alias("CancelledRows"),
        F.sum("Returned").alias("ReturnRows"),
        F.sum("NonProduct").alias("NonProductRows"),
    )


def null_counts(df: DataFrame) -> DataFrame:
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], list(counts.columns), "Column", "Nulls")


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct non-null values per column, smallest first.

    Pairs of column and value are made distinct in every task before they are shuffled. Values are
    told apart by their text, which is exact for what a table file holds; zero has no sign.
    """
    names = list(columns or df.columns)

    def text(name: str) -> Column:
        value = F.col(f"`{name}`")
        is_real = dict(df.dtypes)[name] in ("double", "float")
        return (value + F.lit(0.0) if is_real else value).cast("string")

    pairs = F.array(*[F.struct(F.lit(c).alias("Column"), text(c).alias("Value")) for c in names])
    found = df.select(F.inline(pairs)).distinct().groupBy("Column").agg(
        F.count("Value").alias("DistinctValues")
    )
    every = df.sparkSession.createDataFrame([(c,) for c in names], "Column string")
    counts = every.join(F.broadcast(found), "Column", "left").select("Column", F.coalesce("DistinctValues", F.lit(0)).alias("DistinctValues"))
    return counts.orderBy("DistinctValues", "Column")


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum per column."""
    names = list(columns)
    moments = df.agg(
        *[
            F.struct(
                F.count(c).alias("Count"),
                F.avg(F.col(c).cast("double")).alias("Mean"),
                F.stddev_samp(F.col(c).cast("double")).alias("Std"),
                F.min(F.col(c).cast("double")).alias("Min"),
                F.max(F.col(c).cast("double")).alias("Max"),
            ).alias(c)
            for c in names
        ]
    ).unpivot([], names, "Measure", "Moments")
    quartiles = exact_quantiles(df, names, {"P25": 0.25, "P50": 0.5, "P75": 0.75})
    return (
        moments.select("Measure", "Moments.*")
        .join(quartiles.drop("Rows"), "Measure", "left")
        .select("Measure", "Count", "Mean", "Std", "Min", "P25", "P50", "P75", "Max")
    )
