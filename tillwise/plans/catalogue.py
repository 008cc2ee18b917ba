"""All registered queries and the SQL they are compared with."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SECTIONS = (
    "cleaning",
    "features",
    "behaviour",
    "preparation",
    "metrics",
    "series",
    "models",
    "segments",
    "reports",
    "checks",
    "fits",
)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for section in SECTIONS:
        found.update(importlib.import_module(f"tillwise.plans.{section}").QUERIES)
    return found


def oracles() -> dict[str, str]:
    found: dict[str, str] = {}
    for section in SECTIONS:
        found.update(importlib.import_module(f"tillwise.plans.{section}").ORACLES)
    return found
