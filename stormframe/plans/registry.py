"""Where queries and their SQL twins are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stormframe.plans.derived import Tables
from stormframe.plans.oracle import with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, tables: tuple[str, ...] = ()):
    """Register ``fn(Tables) -> DataFrame`` under a name, with the SQL that must give the same rows."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_tables(sql, *tables)
        return fn

    return register


def rounded(name: str, column: Column | None = None) -> Column:
    """Six digits; NaN reads null, so that both engines print the same."""
    value = F.col(name) if column is None else column
    return F.when(~F.isnan(value), F.round(value, 6)).alias(name)


def micros(column: str, name: str | None = None) -> Column:
    return F.unix_micros(column).alias(name or column)


def epoch(column: str, name: str) -> Column:
    return F.unix_timestamp(column).alias(name)


def big(name: str) -> Column:
    return F.col(name).cast("long").alias(name)
