"""Cutting the lineage of a frame that is used more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: what the session names, else a folder for local runs."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="tillwise-checkpoint-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir() or named


def written(df: DataFrame) -> DataFrame:
    """Write the frame as Parquet to the shared folder and read it back.

    Later reads are pruned and pushed down, and a lost executor costs no recomputation.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Go on from a written copy of a frame that is used more than once."""
    return written(df)
