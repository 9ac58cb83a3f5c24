"""All core queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellumine.plans import catalog, evaluation, incremental, retrieval

_PARTS = (retrieval, catalog, evaluation, incremental)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for part in _PARTS for name, q in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for part in _PARTS for name, q in part.SQL.items()}
