"""Every query by name, and its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import geometry, images, metadata, similarity, statistics

Query = Callable[[SparkSession, str], DataFrame]
GROUPS = (similarity, metadata, geometry, statistics, images)


def queries() -> dict[str, Query]:
    return {name: q for g in GROUPS for name, (q, _) in g.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for g in GROUPS for name, (_, sql) in g.QUERIES.items() if sql}
