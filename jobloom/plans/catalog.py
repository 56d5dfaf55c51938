"""All queries of the library itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobloom.plans import changes, reads, timetable, work
from jobloom.plans.registry import O, Q

__all__ = ["changes", "reads", "timetable", "work"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(O)
