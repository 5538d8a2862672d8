"""All registered queries and their SQL twins, collected from the query modules."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ["q_rules", "q_scoring", "q_steps", "q_graph", "q_documents", "q_reports"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict = {}
    for name in MODULES:
        found.update(import_module(f"wardlight.plans.{name}").QUERIES)
    return found


def oracles() -> dict[str, str]:
    found: dict = {}
    for name in MODULES:
        found.update(import_module(f"wardlight.plans.{name}").ORACLES)
    return found
