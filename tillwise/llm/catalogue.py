"""The queries of this subpackage and the SQL they are compared with."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = (
    "packing",
    "ordering",
    "chat",
    "langid",
    "passages",
    "quality",
    "fingerprints",
    "mixing",
    "urls",
    "jaccard",
    "exact",
    "trie",
    "negatives",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in MODULES:
        found.update(importlib.import_module(f"tillwise.llm.{module}").QUERIES)
    return found


def oracles() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in MODULES:
        found.update(importlib.import_module(f"tillwise.llm.{module}").ORACLES)
    return found
