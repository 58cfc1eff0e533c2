"""Registered queries: name, Spark query and, where one exists, the equal SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; it runs in UTC, as event times in the tables carry no zone."""

    def register(build):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return build(spark, sf)

        run.__name__, run.__doc__ = build.__name__, build.__doc__
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return build

    return register
