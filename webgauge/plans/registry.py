"""Every registered query by name, and the SQL of its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import chain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, **made: str) -> Callable:
    """Register a query under its function's name.  sql: its oracle, over the driver's and the derived tables and those `made` here."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = chain(sql, made)
        return f

    return register


from . import arrivals, branches, codes, content, crawl, hosts, observations, pages, readers, reports, robots  # noqa: E402, F401  (they register their queries)
