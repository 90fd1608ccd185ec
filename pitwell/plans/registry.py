"""Queries by name, each a function of Tables, with its DuckDB text where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pitwell.plans.tables import Tables, with_fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, build: Callable[[Tables], DataFrame], sql: str | None = None, more: dict[str, str] | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Tables(spark, sf_dir))

    run.__name__ = name
    QUERIES[name] = run
    if sql:
        ORACLES[name] = with_fixtures(sql, more)


def query(name: str, sql: str | None = None, more: dict[str, str] | None = None):
    def take(build: Callable[[Tables], DataFrame]):
        register(name, build, sql, more)
        return build

    return take
