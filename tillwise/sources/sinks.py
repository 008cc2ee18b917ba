"""Writing result tables. One file per task; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json_records(df: DataFrame, path: str) -> None:
    """One JSON object per line, dates in ISO form, nulls kept as fields."""
    (
        df.write.mode("overwrite")
        .option("dateFormat", "yyyy-MM-dd")
        .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss")
        .option("ignoreNullFields", False)
        .json(path)
    )
