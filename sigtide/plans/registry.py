"""Registered queries: name -> (Spark plan, oracle SQL, inventory ids)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    plan: Plan
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(covers: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under its function name; ``covers`` lists inventory ids."""
    def wrap(fn: Plan) -> Plan:
        if fn.__name__ in QUERIES:
            raise ValueError(f"query {fn.__name__} registered twice")
        QUERIES[fn.__name__] = Query(fn.__name__, tuple(covers.split()), fn, sql)
        return fn
    return wrap
