"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.plans.ctes import sql
from waymark.plans.history import History

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
KEY = ["device_id", "track_id"]


def query(oracle: str | None = None):
    def register(f: Callable[[History], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(History(spark, sf_dir))
        if oracle:
            SQL[f.__name__] = sql(oracle)
        return f

    return register


def r(column: Column | str, digits: int = 3) -> Column:
    name = column if isinstance(column, str) else None
    out = F.round(column, digits)
    return out.alias(name) if name else out


def long(column: str) -> Column:
    return F.col(column).cast("long").alias(column)
