"""The registered queries: a function of (spark, sf_dir) and, where SQL can say the same, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str, columns: dict[str, list[str]]) -> dict[str, DataFrame]:
    """Tables narrowed to the named columns, so that the scan reads no others."""
    return {t: table(spark, sf_dir, t).select(*c) for t, c in columns.items()}
