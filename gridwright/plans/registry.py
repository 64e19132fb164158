"""Named queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Test tables by name: ``t.orders`` reads ``<folder>/orders.parquet``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self._folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._folder}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    """Register a function of ``Tables`` under its own name, with its SQL."""
    def wrap(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, folder: f(Tables(spark, folder))
        QUERIES[key].__doc__ = f.__doc__
        if sql is not None:
            ORACLES[key] = sql
        return f

    return wrap


def half_up(x: str, places: int = 2) -> str:
    """SQL of rounding half up."""
    s = 10 ** places
    return f"(floor(({x}) * {s}.0::DOUBLE + 0.5) / {s}.0::DOUBLE)"


def tidy(x: str) -> str:
    """SQL of removing arithmetic noise at the tenth decimal."""
    return f"(round_even(({x}) * 1e10, 0) / 1e10)"
