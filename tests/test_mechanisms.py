"""The event log, timers and instruments, each against what must hold."""

import json
import os
import random
import shutil
import time
from datetime import datetime, timedelta
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from jobloom.operators import metrics
from jobloom.sources import event_log
from jobloom.streaming import streams, timers

T = datetime(2024, 1, 1)


def lines(spark, path, schema, batches):
    """A file for each batch, in order of time."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


EVENT = event_log.EVENT


def test_log_loses_and_repeats_nothing(spark, tmp_path):
    rows = [[(10 * b + i, f"job:{i % 3}", None if i == 4 else f"p\n{b}") for i in range(5)] for b in range(4)]
    log = str(tmp_path / "log")
    stream = lines(spark, str(tmp_path / "in"), EVENT, rows[:2])
    event_log.publish(stream, log, str(tmp_path / "c"))
    flat = [(k, *r) for k, r in enumerate(r for b in rows for r in b)]
    got = sorted(map(tuple, event_log.read(spark, log).collect()))
    assert [g[0] for g in got] == list(range(10)) and sorted(g[1:] for g in got) == sorted(f[1:] for f in flat[:10])

    def read():
        return sorted(tuple(r)[1:] for r in streams.drained(event_log.follow(spark, log), str(tmp_path / "out")).collect())

    assert read() == sorted(f[1:] for f in flat[:10])
    lines(spark, str(tmp_path / "in"), EVENT, rows[2:])
    event_log.publish(stream, log, str(tmp_path / "c"))
    assert read() == sorted(f[1:] for f in flat) and read() == sorted(f[1:] for f in flat)
    after = event_log.read(spark, log, after=21, channel="job:2").collect()
    assert sorted(r.id for r in after) == [22, 32]


def test_log_is_written_and_read_in_arrow_batches(tmp_path):
    import pyarrow as pa

    log, names = str(tmp_path / "log"), ["position", "id", "channel", "payload"]
    writer = event_log._Writer(log)
    batch = lambda ids: pa.RecordBatch.from_arrays([pa.nulls(len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array(["a\nb" if (i or 1) % 2 else None for i in ids], pa.string()), pa.array(["\u00fc"] * len(ids), pa.string())], names=names)
    wrote = [writer.write(iter([batch([1, 2, None]), batch([]), batch([4])])), writer.write(iter([])), writer.write(iter([batch([2**60])]))]
    assert [w.rows for w in wrote] == [4, 0, 1] and len(os.listdir(f"{log}/rows")) == 2
    writer.commit(wrote, 0)

    def read(start, end, after, channel):
        found = [b for p in event_log._parts(event_log.Log(log).manifests(), start, end) for b in event_log._rows(log, p, after, channel)]
        assert all(isinstance(b, pa.RecordBatch) for b in found)
        return [(r["position"], r["id"]) for b in found for r in b.to_pylist()]

    assert read(0, 5, -1, None) == [(0, 1), (1, 2), (2, None), (3, 4), (4, 2**60)]
    assert read(1, 4, 2, None) == [(2, None), (3, 4)] and read(0, 5, 0, "a\nb") == [(0, 1), (2, None)]


def test_failed_batches_leave_nothing_and_repeats_count_once(spark, tmp_path):
    log, bad = str(tmp_path / "log"), F.udf(lambda i: 1 // (i - 3), "long")
    stream = lines(spark, str(tmp_path / "in"), EVENT, [[(i, "a", "x") for i in range(8)]])
    with pytest.raises(Exception):
        event_log.publish(stream.withColumn("id", bad("id") + F.col("id")).repartition(4), log, str(tmp_path / "c"))
    assert not os.listdir(f"{log}/batches") and event_log.read(spark, log).count() == 0
    event_log.publish(stream, log, str(tmp_path / "c2"))
    box = event_log.Log(log)
    before = box.manifests()
    box.write(f"{log}/rows/again.jsonl", b'[1,"a","x"]')
    box.commit(before[-1]["batch"], [{"name": "again.jsonl", "rows": 1}])
    assert box.manifests() == before and not os.path.exists(f"{log}/rows/again.jsonl") and event_log.read(spark, log).count() == 8


def test_readers_wait_for_a_log_that_is_away(tmp_path, monkeypatch):
    log = event_log.Log(str(tmp_path / "log"))
    log.make()
    log.commit(0, [{"name": "a", "rows": 3}])
    reader = event_log._StreamReader(str(tmp_path / "log"), -1, None)
    assert reader.latestOffset() == {"position": 3}
    shutil.move(tmp_path / "log", tmp_path / "gone")
    clock = [100.0]
    monkeypatch.setattr(event_log.time, "monotonic", lambda: clock[0])
    pauses = []
    for _ in range(9):
        assert reader.latestOffset() == {"position": 3}
        pauses.append(reader.pause)
        clock[0] = reader.not_before
    assert pauses[:3] == [0.5, 1.0, 2.0] and pauses[-1] == 60.0
    shutil.move(tmp_path / "gone", tmp_path / "log")
    log.commit(1, [{"name": "b", "rows": 2}])
    assert reader.latestOffset() == {"position": 5} and reader.pause == 0


@pytest.mark.parametrize("backwards", [False, True])
def test_batches_without_rows_hide_no_others(tmp_path, monkeypatch, backwards):
    """Folders list files in any order; a batch without rows starts where the next one does."""

    class Folder:
        def get_file_info(self, wanted):
            return sorted(local.get_file_info(wanted), key=lambda f: f.path, reverse=backwards)

        def __getattr__(self, name):
            return getattr(local, name)

    log = event_log.Log(str(tmp_path / "log"))
    local = log.fs
    monkeypatch.setattr(event_log.fs, "LocalFileSystem", Folder)
    log = event_log.Log(log.path)
    log.make()
    for batch, rows in enumerate([0, 3, 0, 0, 2]):
        log.commit(batch, [{"name": str(batch), "rows": rows}] if rows else [])
    assert [(m["batch"], m["start"], m["end"]) for m in log.manifests() if m["files"]] == [(1, 0, 3), (4, 3, 5)]
    assert event_log._StreamReader(log.path, -1, None).latestOffset() == {"position": 5}
    assert sum(p.end for p in event_log._Reader(log.path, -1, None).partitions()) == 5


def test_timeouts_fire_without_a_row_of_the_job(spark, tmp_path):
    at = lambda s: T + timedelta(seconds=s)
    schema = "job_id long, at timestamp, status string"
    batches = [[(1, at(0), "running"), (2, at(1), "running"), (3, at(2), "running")], [(2, at(5), "succeeded"), (9, at(6), "pending")], [(3, at(8), "running"), (9, at(100), "pending")]]
    stream = lines(spark, str(tmp_path / "in"), schema, batches)
    found = streams.drained(timers.attempts_timed_out(stream, 10), str(tmp_path / "o"))
    assert sorted(r.job_id for r in found.collect()) == [1, 3]
    first = {r.job_id: (r.timed_out_at - r.started_at).total_seconds() for r in found.collect()}
    assert set(first.values()) == {10.0}
    # After a restart a job that started before still has its timer.
    lines(spark, str(tmp_path / "in"), schema, [[(4, at(101), "running"), (5, at(102), "running")]])
    streams.drained(timers.attempts_timed_out(stream, 10), str(tmp_path / "o"))
    lines(spark, str(tmp_path / "in"), schema, [[(5, at(103), "failed"), (9, at(200), "pending")], [(9, at(201), "pending")]])
    again = streams.drained(timers.attempts_timed_out(stream, 10), str(tmp_path / "o"))
    assert sorted(r.job_id for r in again.collect()) == [1, 3, 4]


def test_timeouts_do_not_depend_on_the_order_of_rows_in_a_batch(spark, tmp_path):
    at = lambda s: T + timedelta(seconds=s)
    schema = "job_id long, at timestamp, status string"
    # 1 ends before its row of the start, 2 takes no time, 3 ends too late, 4 starts again when it ends, 5 is due with the last row.
    rows = [(1, at(5), "succeeded"), (1, at(1), "running"), (2, at(1), "failed"), (2, at(1), "running"), (3, at(30), "succeeded"), (3, at(1), "running"), (4, at(9), "running"), (4, at(9), "failed"), (4, at(1), "running"), (5, at(90), "running"), (9, at(100), "pending")]
    stream = lines(spark, str(tmp_path / "in"), schema, [rows])
    found = streams.drained(timers.attempts_timed_out(stream, 10), str(tmp_path / "o"))
    assert sorted((r.job_id, r.started_at) for r in found.collect()) == [(3, at(1)), (4, at(9)), (5, at(90))]


class Store:
    """A part's state and timers as a processor sees them; counts its calls."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def replayed(batches, clocks, limit):
    """Timeouts (job, start) by one job after the other."""
    running, found = {}, []
    for rows, clock in zip(batches, clocks, strict=True):
        for job in {r[0] for r in rows}:
            now = running.pop(job, None)
            for at in sorted({r[1] for r in rows if r[0] == job}):
                said = {r[2] for r in rows if r[:2] == (job, at)}
                if now is not None and at > now + limit:
                    found.append((job, now))
                    now = None
                now = at if said == {True} or len(said) == 2 and now is not None else None
            if now is not None:
                running[job] = now
        gone = [j for j, at in running.items() if -(-(at + limit) // 1000) <= clock]
        found += [(j, running.pop(j)) for j in gone]
    return sorted(found), running


@pytest.mark.parametrize("seed", range(30))
def test_a_part_of_jobs_times_out_as_each_job_does(seed):
    rng, limit = random.Random(seed), 10_000
    batches = [[(rng.randrange(12) - 3, 500 * rng.randrange(20 * b, 20 * b + 90) + rng.randrange(2), rng.random() < 0.6) for _ in range(rng.randrange(1, 40))] for b in range(6)]
    clocks = [10 * b + 5 for b in range(6)]
    watch, store, got = timers._Watch(limit / 1e6), Store(), []
    watch.init(store)
    for rows, clock in zip(batches, clocks, strict=True):
        chunks = [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
        out = list(watch.handleInputRows((0,), (pd.DataFrame(c, columns=["job_id", "us", "running"]) for c in chunks if c), None))
        for due in [t for t in store.timers if t < clock]:
            out += watch.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: clock), SimpleNamespace(getExpiryTimeInMs=lambda: due))
            store.timers.remove(due)
        got += [(int(r.job_id), round(r.started_at.timestamp() * 1e6)) for d in out for r in d.itertuples()]
        assert all((d.timed_out_at - d.started_at == timedelta(microseconds=limit)).all() for d in out)
    want, running = replayed(batches, clocks, limit)
    assert sorted(got) == want and len(store.timers) == min(1, len(running))
    assert dict(zip(*(x.tolist() for x in watch._known()), strict=True)) == running


def test_calls_of_the_state_do_not_grow_with_the_jobs(spark, tmp_path):
    watch, store = timers._Watch(10), Store()
    watch.init(store)
    jobs = list(range(50_000))
    list(watch.handleInputRows((0,), iter([pd.DataFrame({"job_id": jobs, "us": jobs, "running": True})]), None))
    due = store.timers.pop()
    (found,) = watch.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 10_060), SimpleNamespace(getExpiryTimeInMs=lambda: due))
    assert len(found) == 50_000 and store.calls < 20 and store.value is None
    at = lambda s: T + timedelta(seconds=s)
    stream = lines(spark, str(tmp_path / "in"), "job_id long, at timestamp, status string", [[(j, at(j % 5), "running") for j in range(300)] + [(None, at(1), "running"), (7, None, "running")], [(j, at(9), None if j % 2 else "failed") for j in range(200)], [(-1, at(50), "pending")]])
    found = timers.attempts_timed_out(stream, 10, parts=3)
    query = found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "o")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 3 * 4
    assert sorted(r.job_id for r in spark.read.parquet(str(tmp_path / "o")).collect()) == list(range(200, 300))


def test_warnings_come_once(spark, tmp_path):
    stream = lines(spark, str(tmp_path / "in"), "key string, at timestamp", [[("a", T), ("b", T)], [("a", T), ("a", T)]])
    got = streams.drained(timers.warned_once(stream, 3600), str(tmp_path / "o")).collect()
    assert sorted((r.key, r.first) for r in got) == [("a", False), ("a", False), ("a", True), ("b", True)]
    lines(spark, str(tmp_path / "in"), "key string, at timestamp", [[("a", T), ("c", T)]])
    again = streams.drained(timers.warned_once(stream, 3600), str(tmp_path / "o")).collect()
    assert sorted((r.key, r.first) for r in again)[-2:] == [("b", True), ("c", True)] and len(again) == 6


def points(df):
    return {(r.name, r.labels, r.scale, r.bucket): (r.n, r.total, r.least, r.most) for r in df.collect()}


def test_histograms_merge_in_any_order(spark):
    rng = random.Random(1)
    sets = [[("a", float(rng.choice([0, -1, 1, 2, 4, 3, 100, 10**6]))) for _ in range(40)] for _ in range(3)] + [[("b", 2.0**k) for k in range(-30, 40)], [("b", None), ("b", float("nan")), ("c", 0.0)]]
    df = [spark.createDataFrame(s, "k string, v double") for s in sets]
    h = [metrics.histogram(d, "took", ["k"], F.col("v")) for d in df]
    whole = points(metrics.merged(metrics.histogram(df[0].union(df[1]).union(df[2]).union(df[3]).union(df[4]), "took", ["k"], F.col("v")), most=20))
    one = points(metrics.merged(metrics.merged(h[0], h[3], most=20), metrics.merged(h[4], metrics.merged(h[1], h[2])), most=20))
    other = points(metrics.merged(*reversed(h), most=20))
    assert one == other == whole and len({k[2] for k in whole}) == 3  # b went further down than a, zeros have a scale of their own
    by = [k for k in whole if k[1] == '{"k":"b"}']
    assert len(by) <= 20 and sum(whole[k][0] for k in by) == 70
    for (_, labels, scale, bucket), (_, _, least, most) in whole.items():
        if bucket is not None:
            base = 2.0 ** (2.0**-scale)
            assert base**bucket * (1 - 1e-12) < least and most <= base ** (bucket + 1) * (1 + 1e-12), (labels, bucket)


def test_quantiles_of_histograms_are_close(spark):
    rng = random.Random(4)
    values = [rng.lognormvariate(0, 2) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = metrics.quantile(metrics.histogram(df, "took", [], F.col("v")), 0.9).first()
    true = sorted(values)[449]
    assert got["count"] == 500 and got.total == pytest.approx(sum(values)) and true <= got.bound <= true * 2 ** (1 / 8)


def test_counters_add_up(spark):
    df = spark.createDataFrame([("a", "x", 2), ("a", None, 3), ("b", "x", 1)], "actor string, kind string, n int")
    both = metrics.merged(metrics.counter(df, "done", ["kind", "actor"]), metrics.counter(df, "done", ["actor", "kind"], F.col("n")))
    assert {json.dumps(json.loads(r.labels), sort_keys=True): r.n for r in both.collect()} == {'{"actor": "a", "kind": "x"}': 3, '{"actor": "a"}': 4, '{"actor": "b", "kind": "x"}': 2}
