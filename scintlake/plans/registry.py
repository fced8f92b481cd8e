"""Registry of the queries: name -> (Spark callable, equivalent SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register the decorated callable under ``name``."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every floating column, so that a different summation order cannot change the result."""
    return df.select(*[
        (F.round(F.col(f.name), special.get(f.name, digits)) + F.lit(0.0)).alias(f.name)
        if f.dataType.typeName() in ("double", "float") else F.col(f.name)
        for f in df.schema.fields])
