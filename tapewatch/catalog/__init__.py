"""Registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Build
    covers: str
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Build], Build]:
    """``covers`` lists the rows of the operator inventory that the query exercises."""

    def add(build: Build) -> Build:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(build, covers, sql)
        return build

    return add


def load_all() -> dict[str, Query]:
    import importlib

    for module in MODULES:
        importlib.import_module(f"tapewatch.catalog.{module}")
    return REGISTRY


MODULES = ["series_windows", "edges", "columns", "desk", "scoring", "timeseries", "learning", "trees", "live", "jobs"]
