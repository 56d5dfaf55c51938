"""Queries by name, each with the SQL that says the same, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobloom.sources.fixtures import NOW, Tables, with_tables

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
O: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of the tables; ``NOW`` in the SQL is the logical clock."""

    def wrap(f: Callable[[Tables], DataFrame]) -> Callable:
        if name in Q:
            raise ValueError(name)
        Q[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            O[name] = with_tables(sql.replace("NOW", f"timestamp '{NOW}'"))
        return f

    return wrap
