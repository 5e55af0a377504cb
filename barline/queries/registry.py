"""Names, Spark callables and checking SQL of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` computes the same rows in DuckDB."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def emit(df: DataFrame, *columns: str, digits: int = 6, **places: int) -> DataFrame:
    """Output form shared with the SQL side: dates as text, flags and counts as bigint, doubles rounded."""
    names = columns or tuple(df.columns)

    def form(name: str) -> Column:
        kind = df.schema[name].dataType
        c = F.col(name)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            c = F.round(c, places.get(name, digits))
        elif isinstance(kind, (T.DateType, T.TimestampType)):
            c = c.cast("date").cast("string")
        elif isinstance(kind, (T.BooleanType, T.IntegerType, T.LongType, T.ShortType)):
            c = c.cast("bigint")
        return c.alias(name)

    return df.select([form(n) for n in names])


# -- the same forms in SQL ------------------------------------------------------------
def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    return f"round(({expr})::DOUBLE, {digits}) + 0::DOUBLE AS {name or expr}"


def d(expr: str, name: str | None = None) -> str:
    return f"CAST(CAST({expr} AS DATE) AS VARCHAR) AS {name or expr}"


def n(expr: str, name: str | None = None) -> str:
    return f"CAST({expr} AS BIGINT) AS {name or expr}"
