"""The table of registered queries and their oracle SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .adapters import SQL, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def with_views(sql: str) -> str:
    """``sql`` with the adapter tables it names put before it."""
    used = [f"{n} AS ({body})" for n, body in SQL.items() if re.search(rf"\b{n}\b", sql)]
    if not used:
        return sql
    rest = re.sub(r"^\s*WITH\b", "", sql)
    return f"WITH {', '.join(used)}" + (f", {rest}" if rest != sql else f" {sql}")


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of the tables under ``name``."""

    def put(body: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: body(Tables(spark, sf_dir))
        if sql:
            ORACLE[name] = with_views(sql)
        return body

    return put
