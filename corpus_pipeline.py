"""From raw documents to packed training sequences, stage by stage.

Every stage is written as Parquet to the shared folder and read again by the next, so a lost
executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillwise.functions.lineage import written
from tillwise.llm.jaccard import jaccard_stage
from tillwise.llm.mixing import mixing_stage
from tillwise.llm.packing import packing_stage
from tillwise.llm.passages import passages_stage
from tillwise.llm.quality import quality_stage

STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("suffix_array_dedup", passages_stage),
    ("source_mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL has no zstandard, no tokenizer and no suffix array: tests/llm hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; the rows are those of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
