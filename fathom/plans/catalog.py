"""Registry of named queries: a Spark builder and (where SQL can say it) a DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    name: str
    build: Builder
    sql: str | None
    ops: str


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None, ops: str = ""):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its oracle SQL."""
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, sql, ops)
        return fn
    return deco


def load_all() -> dict[str, Entry]:
    # importing the plan modules registers their queries
    from fathom.plans import basics, series, grids, models, dives, echogram, tables  # noqa: F401
    return REGISTRY
