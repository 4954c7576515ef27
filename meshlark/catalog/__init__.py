"""All queries of the library with their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meshlark.catalog import algebra, evolution, gauge, mesh, spinors
from meshlark.catalog._register import ORACLE, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


__all__ = ["algebra", "evolution", "gauge", "mesh", "oracle_sql", "queries", "spinors"]
