"""The registered queries over the driver's tables, each with its SQL twin."""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


_QUERIES: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    """Decorator: registers a query under a name, with the SQL that gives the same rows."""

    def add(run):
        _QUERIES[name] = Query(run, sql)
        return run

    return add


def _load() -> dict[str, Query]:
    for name in ("retrieval", "tables", "texts", "streams", "answer", "evaluation", "records", "ingest"):
        if importlib.util.find_spec(f"isopleth.plans.{name}"):
            importlib.import_module(f"isopleth.plans.{name}")
    return _QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query.run for name, query in _load().items()}


def oracle_sql() -> dict[str, str]:
    return {name: query.sql for name, query in _load().items() if query.sql}
