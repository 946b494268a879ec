"""Registered queries: each binds an operator to the test tables, with its SQL twin."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.catalog.tables import Tables, view_sql

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register ``fn(tables)`` under ``name``; ``views`` are fixture CTEs the SQL uses."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query registered twice: {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        _QUERIES[name] = run
        if sql is not None:
            _ORACLES[name] = view_sql(sql, views)
        return fn

    return register


def _load() -> None:
    from tidemark.catalog import modules

    for module in modules.NAMES:
        importlib.import_module(f"tidemark.catalog.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
