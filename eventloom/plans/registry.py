"""The registered queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.sources.adapters import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def r6(c: Column | str) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def s6(sql: str) -> str:
    return f"(round({sql}, 6) + 0.0::double)"


def query(sql: str | None = None, *views: str):
    """Register fn(tables) under its name, with SQL over the named views."""

    def put(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[fn.__name__] = with_views(sql, *views) if views else sql.strip()
        return fn

    return put
