"""Operators of a training-data pipeline. Nothing else in the library imports this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The query of each operator over its whole table."""
    from .bindings import QUERIES

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    from .bindings import ORACLES

    return dict(ORACLES)
