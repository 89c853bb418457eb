"""Registered acceptance queries: each key has a Spark callable ``(spark, sf_dir)
-> DataFrame`` over the given tables and, where SQL can say the same thing, a
DuckDB oracle over the same parquet files. Column names match on both sides.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a Spark query under ``key`` with its oracle SQL (or none)."""
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_all() -> None:
    """Import every module that registers queries."""
    from . import (browse_q, chart_q, edit_q, filter_q, io_q, profile_q,  # noqa: F401
                   render_q, shape_q, sql_q)
