"""Every registered query of the engine with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keystrata.plans import relational, storage, vectors


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return storage.QUERIES | relational.QUERIES | vectors.QUERIES


def oracle_sql() -> dict[str, str]:
    return storage.SQL | relational.SQL | vectors.SQL
