"""Every registered query with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factengine.plans import queries_layout, queries_pairs, queries_read, queries_values
from factengine.plans.registry import QUERIES, SQL

MODULES = (queries_values, queries_pairs, queries_layout, queries_read)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which facts of different documents state the same value, and do they corroborate?"""
    return QUERIES["settle_pairs"](spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
