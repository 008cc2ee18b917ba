"""Report tables put together from the results of the other operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_model_row(metrics: DataFrame, by: str = "RMSE") -> DataFrame:
    """The whole metric row of the model with the lowest error."""
    rest = [c for c in metrics.columns if c != "Model"]
    return metrics.agg(
        F.min_by(F.struct("Model", *rest), F.struct(by, "Model")).alias("_best")
    ).select("_best.*")


def segment_rows(named: DataFrame) -> DataFrame:
    """Segments by average future spend, with the columns of the summary."""
    return named.select(
        "Cluster",
        "SegmentName",
        "ClusterSize",
        "CustomerShare_Pct",
        "FutureRevenueShare_Pct",
        "RetentionRate_Pct",
        "ZeroFutureSpendRate_Pct",
        "AvgFutureSpend90Days",
        "AvgRecency",
        "AvgFrequency",
        "AvgMonetary",
    ).orderBy(F.col("AvgFutureSpend90Days").desc(), "Cluster")


def cards(frame: DataFrame, section: str, titles: dict[str, str]) -> DataFrame:
    """One card per column of a one-row frame: text results and numbers in separate columns."""
    kinds = dict(frame.dtypes)
    rows = [
        F.struct(
            F.lit(section).alias("Section"),
            F.lit(title).alias("Title"),
            (F.col(c) if kinds[c] == "string" else F.lit(None).cast("string")).alias("Text"),
            (F.lit(None).cast("double") if kinds[c] == "string" else F.col(c).cast("double")).alias("Number"),
        )
        for c, title in titles.items()
    ]
    return frame.select(F.inline(F.array(*rows)))


def kpi_cards(parts: Sequence[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def report_row(frame: DataFrame, module: str, method: str, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """One line of the report: module, method and two named figures of a one-row frame."""
    return frame.select(
        F.lit(module).alias("Module"),
        F.col(method).alias("Method"),
        F.lit(first[0]).alias("Metric1"),
        F.col(first[1]).cast("double").alias("Value1"),
        F.lit(second[0]).alias("Metric2"),
        F.col(second[1]).cast("double").alias("Value2"),
    )
