"""Streams: state changes, monotone progress, coalescing, samplers, fan-out and event-time windows.

Each operator takes a streaming (or, where it has no state of its own, any) DataFrame and returns one. Sinks run with
a checkpoint, so a restart goes on where it stopped.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from jobloom.functions.columns import merged, moment
from jobloom.operators.ratelimit import DECISIONS
from jobloom.operators.sequences import sessions

PROGRESS = "job_id long, seq int, status string, detail string, terminal boolean"
_COLUMNS = ["job_id", "seq", "status", "detail", "terminal"]
#: Seconds after its last row that a job's state is kept. A row that comes later still counts as the job's first.
IDLE = 86_400
#: Decisions that a task holds as Python objects.
SLICE = 10_000


def file_source(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """Files of a folder as a stream; a limit per batch is the back-pressure."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def drained(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Everything that is there now through the stream into a table; it can be called again for what came since."""
    # Batches without data, which only look for state that timed out, would never end; such state goes with the next data.
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    if "ProcessingTime" in stream._jdf.queryExecution().analyzed().toString():
        conf.set(name, "false")
    try:
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/_state").option("path", f"{path}/out").outputMode(mode).trigger(availableNow=True).start()
    finally:
        conf.set(name, before)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def _sorted(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A job's rows of one micro-batch, as many as the source's limit per batch lets in."""
    return pd.concat(list(batches)).sort_values("seq", kind="stable")


def _changes(idle: float) -> Callable:
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        rows = _sorted(batches)
        keep = []
        for i, (seq, status, terminal) in enumerate(zip(rows["seq"], rows["status"], rows["terminal"], strict=True)):
            if last is not None and last[2]:
                break
            if last is None or (int(seq), status) != tuple(last[:2]):
                keep.append(i)
            last = (int(seq), status, bool(terminal))
        state.update(last)
        state.setTimeoutDuration(int(idle * 1000))
        yield rows.iloc[keep][_COLUMNS]

    return run


def state_changes(stream: DataFrame, idle: float = IDLE) -> DataFrame:
    """Rows whose (seq, status) differs from the job's last one, up to its terminal row."""
    return stream.groupBy("job_id").applyInPandasWithState(_changes(idle), PROGRESS, "seq int, status string, done boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def _ahead(idle: float) -> Callable:
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = _sorted(batches)
        last = state.get[0] if state.exists else int(rows["after"].iloc[0])
        keep = []
        for i, (seq, terminal) in enumerate(zip(rows["seq"], rows["terminal"], strict=True)):
            if seq > last or terminal:
                keep.append(i)
                last = max(last, int(seq))
        state.update((int(last),))
        state.setTimeoutDuration(int(idle * 1000))
        yield rows.iloc[keep][_COLUMNS]

    return run


def monotone(stream: DataFrame, resume: DataFrame | None = None, idle: float = IDLE) -> DataFrame:
    """Rows with a higher seq than all before; late and repeated ones go, a terminal row always passes.

    ``resume`` (job_id, last_seq) is a table: a reader goes on after the seq that it saw last, after 0 if it lists none.
    """
    if resume is None:
        stream = stream.withColumn("after", F.lit(-1))
    else:
        seen = resume.groupBy("job_id").agg(F.greatest(F.max("last_seq"), F.lit(0)).cast("int").alias("after"))
        stream = stream.join(seen, "job_id", "left").withColumn("after", F.coalesce("after", F.lit(0)))
    return stream.groupBy("job_id").applyInPandasWithState(_ahead(idle), PROGRESS, "last int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def snapshots(progress: DataFrame, resume: DataFrame) -> DataFrame:
    """What a reader that comes back gets first: the latest row of each job of ``resume`` (job_id, last_seq), if it is
    newer than what it saw."""
    seen = resume.groupBy("job_id").agg(F.max("last_seq").alias("last_seq"))
    latest = progress.groupBy("job_id").agg(F.max_by(F.struct(*_COLUMNS[1:]), F.struct("seq", "terminal")).alias("row")).select("job_id", "row.*")
    return latest.join(seen, "job_id").filter("last_seq is null or seq > last_seq").select(*_COLUMNS)


def every(spark: SparkSession, seconds: float, action: Callable[[int], None], path: str) -> StreamingQuery:
    """``action`` with the number of the tick, at this cadence, until the query is stopped; a tick that failed is
    repeated under its number."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, number: action(number)).option("checkpointLocation", f"{path}/_state").trigger(processingTime=f"{seconds} seconds").start()


def published(events: DataFrame, path: str) -> DataFrame:
    """Events (channel, payload) as lines of JSON in a folder for each channel, which readers follow as a stream."""
    events.select("channel", "payload").write.mode("append").partitionBy("channel").json(path)
    return events.sparkSession.read.schema("payload string, channel string").json(path)


def coalesced(updates: DataFrame) -> DataFrame:
    """One row per job: the last writer's fields and the number of updates. For a micro-batch or a table."""
    at = F.struct("seq")
    return updates.groupBy("job_id").agg(F.max("seq").alias("seq"), F.max_by("status", F.when(F.col("status").isNotNull(), at)).alias("status"), F.max_by("detail", F.when(F.col("detail").isNotNull(), at)).alias("detail"), F.count("*").alias("updates"))


def fan_out(events: DataFrame, worker: int | None = None, kind: str | None = None) -> DataFrame:
    out = events
    if worker is not None:
        out = out.filter(F.col("worker_id").isNull() | (F.col("worker_id") == worker))
    return out if kind is None else out.filter(F.col("kind") == kind)


def with_global_copy(events: DataFrame) -> DataFrame:
    """Each event on its job's channel and on the global one."""
    return events.withColumn("channel", F.explode(F.array(F.concat(F.lit("job:"), F.col("job_id").cast("string")), F.lit("all"))))


def sampled(stream: DataFrame, sample: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """``sample`` of every micro-batch appended to a table, with the batch number; repeated batches overwrite."""

    def each(batch: DataFrame, number: int) -> None:
        sample(batch).write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/_state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/out")


def event_windows(events: DataFrame, at: str, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by window and kind with a watermark; sliding if ``slide`` is given."""
    span = F.window(at, length, slide) if slide else F.window(at, length)
    source = events.withWatermark(at, late) if events.isStreaming else events
    return source.groupBy(span.alias("w"), "to_state").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "to_state", "n")


def event_sessions(events: DataFrame, at: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Counts by session and actor. A table's sessions come from counts of short spans, so that no task gathers an actor's
    rows; a stream's are Spark's session windows, whose state merges as rows come."""
    if events.isStreaming:
        found = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), "actor").agg(F.count("*").alias("n"))
        return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "actor", "n")
    kind, size = dict(events.dtypes)[at], int(pd.Timedelta(gap) / pd.Timedelta(microseconds=1))
    found = sessions(events.select("actor", F.unix_micros(F.col(at).cast("timestamp")).alias("us")), ["actor"], size)
    moment_of = lambda us: F.timestamp_micros(us).cast(kind)
    return found.select(moment_of(F.col("first_us")).alias("start"), moment_of(F.col("last_us") + size).alias("end"), "actor", "n")


def timed_out(jobs: DataFrame, now, limit: float) -> DataFrame:
    """Running jobs beyond their start-to-close time."""
    return jobs.filter((F.col("status") == "running") & (F.col("started_at") + F.make_dt_interval(secs=F.lit(limit)) < moment(now))).select("id", "actor")


def snapshot_changes(versions: DataFrame, keys: list[str], values: list[str], order: str) -> DataFrame:
    """Rows of polled snapshots whose values differ from the snapshot before."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order)
    now, before = F.struct(*values), F.lag(F.struct(*values)).over(w)
    return versions.withColumn("_before", before).withColumn("_now", now).filter("_before is null or not (_before <=> _now)").drop("_before", "_now")


def merged_states(states: DataFrame) -> DataFrame:
    """Two JSON states per row merged, the newer over the older."""
    return states.select("job_id", merged(F.col("old"), F.col("new")).alias("state"))


def limited(stream: DataFrame, step: Callable[[object, float], tuple]) -> DataFrame:
    """A rate limit's step function over a stream of (bucket, ts, request_id): the batch decisions, with the bucket's
    state kept between micro-batches. Within a micro-batch requests are taken by time, then id."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else None
        # Two numbers are all that is kept of a request until it is decided.
        whole = [(rows["us"].to_numpy(copy=True), rows["request_id"].to_numpy(copy=True)) for rows in batches]
        us, requests = (np.concatenate(x) for x in zip(*whole, strict=True))
        del whole
        order = np.lexsort((requests, us))
        for at in range(0, len(order), SLICE):
            part, out = order[at : at + SLICE], []
            for moment_us, request in zip(us[part].tolist(), requests[part].tolist(), strict=True):
                held, ok, level, wait = step(held, moment_us / 1e6)
                out.append((key[0], request, ok, level, wait))
            if at + SLICE >= len(order):
                state.update((pickle.dumps(held),))
            yield pd.DataFrame(out, columns=["bucket", "request_id", "allowed", "level", "retry_after"]).astype({"level": float, "retry_after": float})

    source = stream.select("bucket", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "request_id")
    return source.groupBy("bucket").applyInPandasWithState(run, DECISIONS, "data binary", "append", GroupStateTimeout.NoTimeout)
