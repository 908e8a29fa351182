"""All registered queries over the gridded relations, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import grid_queries, ingest_queries, model_queries
from .registry import ORACLES, QUERIES

MODULES = (ingest_queries, grid_queries, model_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
