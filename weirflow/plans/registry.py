"""The named queries. Each takes a session and a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    if QUERIES.setdefault(f.__name__, f) is not f:
        raise ValueError(f"another query is named {f.__name__}")
    return f
