"""Counts that are kept up, tables laid out for lookups, hooks of dead jobs."""

import random

import pytest
from pyspark.sql import functions as F

from jobloom.operators import actors
from jobloom.plans import counts, transitions
from jobloom.sources import layout
from test_outcomes import NOW, jobs


def rows(df):
    return sorted((r.actor, r.queue, r.status, r.n) for r in df.collect())


def test_counts_follow_transitions(spark):
    rng = random.Random(2)
    kinds = [transitions.promote, transitions.expire_deadlines, lambda j, now: transitions.snooze(j, now, 5.0), lambda j, now: transitions.fail(j, now, 1), lambda j, now: transitions.request_cancel(j, j.filter("id % 3 = 0").select("id"), now), lambda j, now: transitions.retry_by_hand(j, j.select("id"), now), lambda j, now: transitions.isolate(j, now, 2), lambda j, now: transitions.retry_after(j, now, 0.0)]
    df = jobs(spark, 60)
    spark_counts = counts.counted(df)
    for k in range(10):
        found = rng.choice(kinds)(df, NOW)
        delta = spark.createDataFrame(counts.changes(found).collect(), "actor string, queue string, status string, n long")
        spark_counts = spark.createDataFrame(counts.kept(spark_counts, delta).collect(), "actor string, queue string, status string, n long")
        after = found.apply(df)
        # Some are claimed again, so that the next one finds work.
        claimed = after.withColumn("status", F.when((F.col("status") == "pending") & (F.col("id") % 4 == k % 4), "running").otherwise(F.col("status"))).withColumn("locked_by_worker", F.when(F.col("status") == "running", F.coalesce("locked_by_worker", F.lit(1))).otherwise(F.col("locked_by_worker")))
        df = spark.createDataFrame(claimed.collect(), claimed.schema)
        spark_counts = spark.createDataFrame(counts.kept(spark_counts, counts.left(after), counts.arrived(df)).collect(), "actor string, queue string, status string, n long")
        assert rows(spark_counts) == rows(counts.counted(df)), k
    half = df.filter("id % 2 = 0")
    assert rows(counts.kept(spark_counts, counts.left(half))) == rows(counts.counted(df.filter("id % 2 = 1")))
    assert {r.actor: r.n for r in counts.in_flight(spark_counts).collect()} == {r.actor: r["count"] for r in df.filter("status = 'running'").groupBy("actor").count().collect()}


def scan(df, metric):
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply(metric).value() for i in range(leaves.size()))


@pytest.fixture
def laid_out(spark, tmp_path):
    df = spark.range(20_000).select("id", F.concat(F.lit("k"), F.sha1(F.col("id").cast("string"))).alias("key"), (F.col("id") * 2).alias("v"))
    path = str(tmp_path / "t")
    layout.lay_out(df, path, keys=["key"], parts=16, expected=2000)
    return df, path


def test_lookups_read_few_files(spark, laid_out):
    df, path = laid_out
    assert spark.read.parquet(path).count() == 20_000
    found = layout.by_ids(spark, path, [5, 5, None, 19_999, 10**9], parts=16)
    assert sorted(map(tuple, found.select("id", "v").collect())) == [(5, 10), (19_999, 39_998)]
    one = layout.by_ids(spark, path, [77], parts=16)
    one.collect()
    assert scan(one, "numFiles") == 1
    assert layout.by_ids(spark, path, [None], parts=16).count() == 0


def test_filters_skip_row_groups_without_the_key(spark, laid_out):
    df, path = laid_out
    wanted = df.filter("id = 1234").first()["key"]
    found = layout.by_key(spark, path, "key", [wanted, None])
    assert [r.id for r in found.collect()] == [1234]
    read = scan(found, "numOutputRows")
    absent = layout.by_key(spark, path, "key", ["k" + "5" * 40])
    assert absent.collect() == [] and read <= 5000 and scan(absent, "numOutputRows") <= 5000


def test_hooks_and_reporters_dont_stop_each_other(spark):
    dead = spark.createDataFrame([(1, "a", "Late"), (2, "b", "Late"), (3, "c", "Late")], "job_id long, actor string, cause string")

    def bad(job, cause):
        raise KeyError(cause)

    got = {r.job_id: (r.hook, r.report) for r in actors.told(dead, {"a": bad, "b": lambda j, c: None}, bad).collect()}
    assert got == {1: ("KeyError", "KeyError"), 2: ("called", "KeyError"), 3: (None, "KeyError")}
    assert all(r.report is None for r in actors.told(dead, {}).collect())
