"""All queries of the library by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.sources.catalog import Tables, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Register a function of Tables under its name; sql reads the named views."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, path: f(Tables(spark, path))
        if sql is not None:
            ORACLES[f.__name__] = oracle(sql, *views)
        return f

    return add


def flagship(spark: SparkSession, path: str) -> DataFrame:
    return QUERIES["flagship_top_signals"](spark, path)


from tallyloom.plans import allocation, books, broker, cross_section, evaluation, fundamentals, history, indicators, operations, portfolio, screening, series, signals, simulation, snapshots_io, streams, text_and_sets, validation, walkforward  # noqa: E402, F401
