"""Registration of queries next to their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
WHOLE = {"tinyint", "smallint", "int"}


def emit(df: DataFrame, digits: int = 6) -> DataFrame:
    """Whole numbers as bigint and doubles rounded, the form the SQL side returns."""
    def one(name: str, dtype: str):
        c = F.col(f"`{name}`")
        if dtype in WHOLE:
            return c.cast("long").alias(name)
        return F.round(c, digits).alias(name) if dtype == "double" else c
    return df.select(*[one(n, t) for n, t in df.dtypes])


def query(name: str, sql: str | None = None, digits: int = 6) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf: emit(fn(spark, sf), digits)
        if sql is not None:
            SQL[name] = sql
        return fn
    return register
