"""Every operator as a query over the standard tables, with its SQL twin where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
AREAS = ("scalars", "hashing", "joins", "reports", "ordered", "splits", "scoring", "drifting", "sharing", "mining", "decisions", "modelling")


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with the SQL that must give the same rows."""

    def register(fn: Query) -> Query:
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"query {key!r} registered twice")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return register


def load() -> tuple[dict[str, Query], dict[str, str]]:
    for area in AREAS:
        import_module(f"stallwatch.catalog.{area}")
    return QUERIES, ORACLE
