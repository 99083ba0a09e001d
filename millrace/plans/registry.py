"""Queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    run: Query
    sql: str


REGISTRY: dict[str, Registered] = {}


def query(name: str, sql: str) -> Callable[[Query], Query]:
    """Register a query; event times without zone are UTC, whatever the session's zone is."""

    def register(run: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"query {name!r} is registered twice")

        def in_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
            before = spark.conf.get("spark.sql.session.timeZone")
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            try:
                return run(spark, sf_dir)
            finally:
                spark.conf.set("spark.sql.session.timeZone", before)

        REGISTRY[name] = Registered(in_utc, sql)
        return run

    return register
