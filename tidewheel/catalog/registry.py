"""Registered queries: a Spark callable per name and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidewheel.catalog.sql import with_ctes

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        assert name not in QUERIES, name
        QUERIES[name] = Query(run, with_ctes(sql) if sql else None)
        return run

    return add
