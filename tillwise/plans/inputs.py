"""The frames the registered queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.functions.lineage import cut_lineage
from tillwise.operators.cleaning import clean_lines, genuine_purchases, tidy
from tillwise.operators.features import Periods, customer_features
from tillwise.plans.oracle import CUTOFF
from tillwise.sources.readers import invoice_lines

PERIODS = Periods(CUTOFF)


def raw(spark: SparkSession, folder: str) -> DataFrame:
    return invoice_lines(spark, folder)


def tidied(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(raw(spark, folder))


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return clean_lines(raw(spark, folder))


def purchases(spark: SparkSession, folder: str) -> DataFrame:
    return genuine_purchases(lines(spark, folder))


def features(spark: SparkSession, folder: str) -> DataFrame:
    return customer_features(lines(spark, folder), PERIODS)


def kept_features(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The feature rows (of these columns) written once, for queries that go over them again.

    The columns are picked before the write, so the others are never computed.
    """
    frame = features(spark, folder)
    return cut_lineage(frame.select("Customer_ID", *columns) if columns else frame)


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return cut_lineage(scored_rows(features(spark, folder)))


def scored_rows(frame: DataFrame) -> DataFrame:
    """A repeatable stand-in for a model: last spend as prediction, recent activity as score."""
    bought, recency = F.col("PurchasesLast90Days"), F.col("Recency")
    score = bought / (bought + 1 + recency / F.lit(30.0))
    return frame.select(
        "Customer_ID",
        F.col("FutureSpend90Days").alias("Actual"),
        F.col("SpendLast90Days").alias("Predicted"),
        F.col("RetentionLabel").cast("int").alias("Label"),
        score.alias("Score"),
        (score >= 0.5).cast("int").alias("Decision"),
    )
