"""Names of queries, the functions that build them, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(c: Column, digits: int = 4) -> Column:
    """Half up at the last digit kept, the same in every engine."""
    return F.floor(c * 10.0**digits + 0.5) / 10.0**digits


def r(x: str, digits: int = 4) -> str:
    """SQL of rounded()."""
    return f"(floor(({x}) * 1e{digits}::double + 0.5::double) / 1e{digits}::double)"
