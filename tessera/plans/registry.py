"""Registry of named queries over the driver tables.

Each entry pairs a Spark builder ``(spark, sf_dir) -> DataFrame`` with an
optional DuckDB oracle SQL string over the same tables (pre-registered as
views).  Output columns are aliased identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    oracle: str | None
    ops: tuple[str, ...]


_REGISTRY: dict[str, Query] = {}


def register(name: str, oracle: str | None = None, ops: tuple[str, ...] = ()):
    def deco(fn: Builder) -> Builder:
        if name in _REGISTRY:
            raise ValueError(f"duplicate query name {name}")
        _REGISTRY[name] = Query(name, fn, oracle, ops)
        return fn
    return deco


def all_queries() -> dict[str, Query]:
    from . import load_all  # noqa: F401  (imports register everything)
    load_all()
    return dict(_REGISTRY)
