"""Registered queries: a Spark callable and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFunction = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: QueryFunction
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable[[QueryFunction], QueryFunction]:
    """Register a function under its own name."""

    def register(function: QueryFunction) -> QueryFunction:
        REGISTRY[function.__name__] = Query(function.__name__, function, sql)
        return function

    return register


def load() -> dict[str, Query]:
    """All registered queries."""
    from skyframe.workload import (  # noqa: F401
        briefs,
        catalogue,
        operations,
        perturbed,
        reports,
        screening,
        selection,
        streams,
        trajectories,
        upsert_streams,
    )

    return REGISTRY
