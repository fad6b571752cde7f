"""All named queries of the core and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ladderlake.plans import analytics, dq, evidence, lookups, quality, reasoning, warehouse

_MODULES = (dq, warehouse, analytics, reasoning, quality, evidence, lookups)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.QUERIES["score_overall"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
