"""Counts of jobs by actor, queue and state, kept up from what transitions change instead of scanning all jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.plans.transitions import Transition

KEYS = ["actor", "queue", "status"]


def counted(jobs: DataFrame) -> DataFrame:
    """(actor, queue, status, n) by a full scan."""
    return jobs.groupBy(*KEYS).agg(F.count("*").alias("n"))


def changes(transition: Transition) -> DataFrame:
    """What a transition takes from the state that each row was in and adds to the one that it is in."""
    moved = transition.rows.filter(~F.col("from_state").eqNullSafe(F.col("status")))
    each = moved.select("actor", "queue", F.explode(F.array(F.struct(F.col("from_state").alias("status"), F.lit(-1).alias("n")), F.struct(F.col("status").alias("status"), F.lit(1).alias("n")))).alias("c"))
    return each.groupBy("actor", "queue", F.col("c.status").alias("status")).agg(F.sum("c.n").alias("n"))


def arrived(jobs: DataFrame) -> DataFrame:
    """New rows."""
    return counted(jobs)


def left(jobs: DataFrame) -> DataFrame:
    """Rows that go, to the archive for one."""
    return counted(jobs).withColumn("n", -F.col("n"))


def kept(counts: DataFrame, *deltas: DataFrame) -> DataFrame:
    """Counts after the changes; in any order and grouping the result is the same."""
    every = reduce(DataFrame.unionByName, [counts, *deltas])
    return every.groupBy(*KEYS).agg(F.sum("n").alias("n")).filter("n <> 0")


def in_flight(counts: DataFrame) -> DataFrame:
    return counts.filter("status = 'running'").groupBy("actor").agg(F.sum("n").alias("n"))


def waiting(counts: DataFrame) -> DataFrame:
    return counts.filter("status in ('pending', 'scheduled')").groupBy("actor").agg(F.sum("n").alias("n"))


def depth(counts: DataFrame) -> DataFrame:
    return counts.filter("status in ('pending', 'scheduled')").groupBy("queue").agg(F.sum("n").alias("n"))
