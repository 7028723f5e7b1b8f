"""Every query that the repository registers, with its check in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, when the check can be said in SQL, its twin."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def load_all() -> None:
    from . import (aggregates, classifiers, discovery, extraction, feed, fuzzy, matching, sources, sqlfunctions,  # noqa: F401
                   scalars, streams, upserts, vectors, windows)
