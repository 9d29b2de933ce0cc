"""The list of registered queries, with the SQL each is checked against."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from markgrid.catalog.tables import Tables, duck_sql


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    run: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}
MODULES = (
    "reconciliation", "keys_text", "filters", "spatial_joins", "suppression", "aggregates",
    "evaluation", "layout", "datasets", "sources_sinks", "cascades", "streams",
)


def query(name: str, covers: str, sql: str | None = None):
    """Register a query under ``name``; ``covers`` lists the inventory rows it exercises."""
    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = Query(name, covers, fn, duck_sql(sql) if sql else None)
        return fn

    return add


def load() -> dict[str, Query]:
    for m in MODULES:
        try:
            importlib.import_module(f"markgrid.catalog.{m}")
        except ModuleNotFoundError as e:
            if m not in str(e):
                raise
    return QUERIES


def runner(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: q.run(Tables(spark, sf_dir))
