"""Collects the registered queries and their SQL oracles from the plan modules."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules of rillgraph.plans; each has QUERIES (name to function) and ORACLES (name to SQL).
PLANS: tuple[str, ...] = ("checkers", "graphs", "reports", "programs", "facts")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query of the plan modules, by name."""
    return {k: f for m in PLANS for k, f in import_module(f"rillgraph.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """The SQL of those queries that SQL can express, by name."""
    return {k: s for m in PLANS for k, s in import_module(f"rillgraph.plans.{m}").ORACLES.items()}
