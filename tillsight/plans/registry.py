"""Registry of named queries: Spark builder + DuckDB oracle SQL + survey ids."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ids: tuple = field(default_factory=tuple)


REGISTRY: dict[str, Query] = {}


def register(name: str, ids: str, sql: str | None = None):
    """Decorator: ``@register("name", "A1 A4", sql=...)`` on ``fn(spark, sf_dir)``."""
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, tuple(ids.split()))
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # Importing the modules registers their queries.
    from . import sales, reports, features, calendar, profiles, patterns, history, models, pricing, live, exports  # noqa: F401
    return REGISTRY
