"""Registering queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(rows: DataFrame) -> DataFrame:
    """Money as doubles, times as seconds and lists as text, which all engines print alike."""
    forms = {}
    for name, kind in rows.dtypes:
        if kind.startswith("decimal"):
            forms[name] = F.col(name).cast("double")
        elif kind.startswith("timestamp"):
            forms[name] = F.unix_timestamp(name)
        elif kind.startswith("array"):
            forms[name] = F.coalesce(F.array_join(name, ","), F.lit(""))
    return rows.withColumns(forms) if forms else rows
