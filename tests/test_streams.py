import time

import pytest

from jobloom.streaming import streams

COLUMNS = streams.PROGRESS


def write(spark, path, rows, name):
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture
def folders(tmp_path):
    return f"file://{tmp_path}/in", f"file://{tmp_path}/out"


def test_monotone_across_restarts(spark, folders):
    source, sink = folders
    write(spark, source, [(1, 0, "running", "a", False), (1, 2, "running", "b", False), (1, 1, "running", "late", False)], "a")
    run = lambda: streams.drained(streams.monotone(streams.file_source(spark, source, COLUMNS)), sink)
    assert sorted(r.seq for r in run().collect()) == [0, 1, 2]
    write(spark, source, [(1, 2, "running", "again", False), (1, 1, "running", "old", False), (1, 3, "running", "c", False), (1, 3, "succeeded", "end", True)], "b")
    assert sorted((r.seq, r.detail) for r in run().collect() if r.seq > 2) == [(3, "c"), (3, "end")]
    assert run().count() == 5


def test_changes_stop_at_the_end(spark, folders):
    source, sink = folders
    write(spark, source, [(1, 0, "pending", "", False), (1, 0, "pending", "", False), (1, 0, "running", "", False), (1, 1, "succeeded", "", True), (1, 2, "running", "", False)], "a")
    got = streams.drained(streams.state_changes(streams.file_source(spark, source, COLUMNS)), sink)
    assert [(r.seq, r.status) for r in got.collect()] == [(0, "pending"), (0, "running"), (1, "succeeded")]


def test_resume_after_last_seen(spark, folders):
    source, sink = folders
    write(spark, source, [(1, i, "running", "", False) for i in range(5)] + [(2, 1, "running", "", False)], "a")
    got = streams.drained(streams.monotone(streams.file_source(spark, source, COLUMNS), spark.createDataFrame([(1, 2), (2, -5), (1, 1)], "job_id long, last_seq int")), sink)
    assert sorted((r.job_id, r.seq) for r in got.collect()) == [(1, 3), (1, 4), (2, 1)]


def test_state_of_idle_jobs_goes(spark, folders):
    """After the idle time a job's state is dropped, and a row of it counts as its first."""
    source, sink = folders
    write(spark, source, [(1, 5, "running", "", False)], "a")
    operator = streams.monotone(streams.file_source(spark, source, COLUMNS), idle=0.001)
    streams.drained(operator, sink)
    for job in (2, 3):
        time.sleep(0.05)
        write(spark, source, [(job, 0, "running", "", False)], "b")
        streams.drained(operator, sink)
    write(spark, source, [(1, 1, "running", "", False)], "c")
    assert sorted((r.job_id, r.seq) for r in streams.drained(operator, sink).collect()) == [(1, 1), (1, 5), (2, 0), (3, 0)]


def test_snapshot_if_it_is_newer(spark):
    rows = [(1, 0, "running", "a", False), (1, 2, "succeeded", "b", True), (2, 1, "running", "c", False), (3, 0, "running", "d", False)]
    seen = spark.createDataFrame([(1, 1), (2, 1), (3, None), (9, 0)], "job_id long, last_seq int")
    got = streams.snapshots(spark.createDataFrame(rows, COLUMNS), seen).collect()
    assert sorted((r.job_id, r.seq, r.detail) for r in got) == [(1, 2, "b"), (3, 0, "d")]


def test_ticks_at_a_cadence(spark, tmp_path):
    seen = []
    query = streams.every(spark, 0.2, seen.append, f"file://{tmp_path}/ticks")
    try:
        until = time.time() + 30
        while len(seen) < 3 and time.time() < until:
            time.sleep(0.1)
    finally:
        query.stop()
    assert len(seen) >= 3 and seen == sorted(seen)


def test_coalesced_keeps_the_last_writer_of_each_field(spark):
    rows = [(1, 0, "running", "x", False), (1, 2, None, "y", False), (1, 3, None, None, False), (2, 0, None, None, False)]
    got = {r.job_id: tuple(r)[1:] for r in streams.coalesced(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == {1: (3, "running", "y", 3), 2: (0, None, None, 1)}


def test_sampler_counts_each_batch(spark, folders):
    source, sink = folders
    write(spark, source, [(1, 0, "running", "", False)], "a")
    write(spark, source, [(2, 0, "running", "", False)], "b")
    got = streams.sampled(streams.file_source(spark, source, COLUMNS, 1), lambda b: b.groupBy("status").count(), sink)
    assert sorted(r["count"] for r in got.collect()) == [1, 1] and "batch" in got.columns


def test_windows_on_a_stream(spark, folders):
    source, sink = folders
    spark.sql("select timestamp '2024-01-01 00:00:10' + make_interval(0,0,0,0,0,id) as at, 'x' as to_state from range(30)").coalesce(1).write.parquet(source)
    stream = streams.file_source(spark, source, "at timestamp, to_state string")
    got = streams.drained(streams.event_windows(stream, "at", "10 minutes", late="1 minute"), sink)
    assert {r.n for r in got.collect()} <= {10} and got.count() >= 1


@pytest.mark.parametrize("name", ["token_bucket", "window_log", "gcra"])
def test_limits_keep_their_state_between_batches(spark, folders, name):
    from jobloom.operators import ratelimit

    source, sink = folders
    step = {"token_bucket": lambda s, t: ratelimit.token_bucket(s, t, 3.0, 0.1), "window_log": lambda s, t: ratelimit.window_log(s, t, 3, 20.0), "gcra": lambda s, t: ratelimit.gcra(s, t, 3, 20.0)}[name]
    rows = spark.sql("select concat('b', id % 2) as bucket, timestamp '2024-01-01' + make_interval(0,0,0,0,0,0,id) as ts, id as request_id from range(40)")
    for part in ("request_id < 15", "request_id >= 15"):
        rows.filter(part).coalesce(1).write.mode("append").parquet(source)
        got = streams.drained(streams.limited(streams.file_source(spark, source, "bucket string, ts timestamp, request_id long"), step), sink)
    want = ratelimit.replayed(rows, step)
    pick = lambda df: sorted((r.request_id, r.allowed) for r in df.collect())
    assert pick(got) == pick(want) and {a for _, a in pick(got)} == {True, False}


def test_limits_hand_out_decisions_in_slices():
    import pickle
    from types import SimpleNamespace

    import pandas as pd

    made = []

    class Stream:
        def select(self, *_):
            return self

        groupBy = select

        def applyInPandasWithState(self, run, *_):
            made.append(run)

    step = lambda s, at: ((s or 0) + 1, True, float((s or 0) + 1), None)
    real, streams.F = streams.F, SimpleNamespace(unix_micros=lambda c: SimpleNamespace(alias=lambda n: None), col=lambda c: SimpleNamespace(cast=lambda kind: None))
    try:
        streams.limited(Stream(), step)
    finally:
        streams.F = real
    n, kept = 25_001, []
    rows = pd.DataFrame({"us": range(n, 0, -1), "request_id": [2**60 + k for k in range(n)]})
    state = SimpleNamespace(exists=False, update=kept.append)
    got = list(made[0](("b",), iter([rows[:9], rows[9:]]), state))
    assert [len(x) for x in got] == [10_000, 10_000, 5_001] and [pickle.loads(x[0]) for x in kept] == [n]
    whole = pd.concat(got)
    assert whole["request_id"].tolist() == [2**60 + k for k in reversed(range(n))] and whole["level"].tolist() == [float(k + 1) for k in range(n)]
