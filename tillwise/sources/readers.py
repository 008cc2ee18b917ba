"""Reading the driver tables and the raw invoice lines over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_LINE = T.StructType(
    [
        T.StructField("Invoice", T.StringType()),
        T.StructField("StockCode", T.StringType()),
        T.StructField("Description", T.StringType()),
        T.StructField("Quantity", T.IntegerType()),
        T.StructField("InvoiceDate", T.TimestampNTZType()),
        T.StructField("Price", T.DoubleType()),
        T.StructField("Customer ID", T.DoubleType()),
        T.StructField("Country", T.StringType()),
    ]
)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder as it is now."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Only these columns; the parquet scan reads no others."""
    return spark.read.parquet(path).select(*columns)


def read_parts(parts: Sequence[DataFrame]) -> DataFrame:
    """One frame out of several sheets with the same columns, matched by name."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def invoice_lines(
    spark: SparkSession, folder: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Raw invoice lines over the order tables, with the defects cleaning has to deal with.

    Cancelled invoices, returns, missing customers, codes, quantities and countries, zero prices,
    untidy codes, codes that look like numbers, and exact copies are put in by rule. The copies come from an explode, so the tables are read once.
    """
    orders = read_table(spark, folder, "orders")
    if start is not None:
        orders = orders.where(F.col("o_orderdate") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        orders = orders.where(F.col("o_orderdate") < F.lit(end).cast("timestamp_ntz"))
    order_key = F.col("o_orderkey")
    cancelled = order_key % 37 == 0
    seconds = (order_key * 7919 % 86400).cast("decimal(18,6)")
    invoices = orders.select(
        "o_orderkey",
        "o_custkey",
        cancelled.alias("_cancelled"),
        F.concat(F.when(cancelled, "C").otherwise(""), order_key.cast("string")).alias("Invoice"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)).alias(
            "InvoiceDate"
        ),
        F.when(order_key % 29 == 0, F.array(F.lit(1), F.lit(2)))
        .otherwise(F.array(F.lit(1)))
        .alias("_copies"),
    )
    nations = read_table(spark, folder, "nation").select(
        "n_nationkey", F.when(F.col("n_nationkey") % 13 != 5, F.lower("n_name")).alias("Country")
    )
    customers = (
        read_table(spark, folder, "customer")
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "c_custkey",
            F.when(F.col("c_custkey") % 41 == 0, F.lit(None).cast("double"))
            .otherwise(F.col("c_custkey").cast("double"))
            .alias("Customer ID"),
            "Country",
        )
    )
    part_key = F.col("p_partkey")
    products = read_table(spark, folder, "part").select(
        "p_partkey",
        F.when(part_key % 53 == 0, " post ")
        .when(part_key % 61 == 0, F.lit(None))
        .when(part_key % 59 == 0, F.concat(part_key.cast("string"), F.lit("D")))
        .when(part_key % 67 == 0, "NaN")
        .otherwise(F.concat(F.lit("p"), part_key.cast("string")))
        .alias("StockCode"),
        F.col("p_name").alias("Description"),
    )
    # Customers meet invoices, not lines: the line table is shuffled once less.
    headers = invoices.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    base = (
        read_table(spark, folder, "lineitem")
        .join(headers, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(products, F.col("l_partkey") == F.col("p_partkey"))
    )
    returned = (F.col("l_returnflag") == "R") & (F.col("l_partkey") % 11 == 0)
    unit_price = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5) / 100
    return base.withColumn("_copy", F.explode("_copies")).select(
        "Invoice",
        "StockCode",
        "Description",
        F.when(F.col("l_partkey") % 89 == 0, F.lit(None))
        .when(F.col("_cancelled") | returned, -F.col("l_quantity"))
        .otherwise(F.col("l_quantity"))
        .cast("int")
        .alias("Quantity"),
        "InvoiceDate",
        F.when(F.col("l_partkey") % 97 == 0, 0.0).otherwise(unit_price).alias("Price"),
        "Customer ID",
        "Country",
    )


def event_purchases(spark: SparkSession, folder: str) -> DataFrame:
    """The purchase events as a second source of dated amounts per customer."""
    return (
        read_table(spark, folder, "events")
        .where(F.col("event_type") == "purchase")
        .select(
            F.col("event_id").cast("string").alias("Invoice"),
            F.col("user_id").cast("string").alias("Customer_ID"),
            F.col("ts").alias("InvoiceDate"),
            F.col("value").alias("TransactionValue"),
        )
    )
