"""All registered queries of the graph engine: a callable and, where SQL can express it, its SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "flagship"
MODULES = ("patterns", "algebra", "analysis", "workspace", "changes", "more")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {}
    for m in MODULES:
        out |= import_module(f".plans.{m}", __package__).QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for m in MODULES:
        out |= import_module(f".plans.{m}", __package__).SQL
    return out
