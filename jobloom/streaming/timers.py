"""Operators with timers: attempts that run too long, and states that expire when nobody uses them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TIMED_OUT = "job_id long, started_at timestamp, timed_out_at timestamp"
_FOUND = ["job_id", "started_at", "timed_out_at"]
#: Parts into which jobs are dealt: enough for the tasks of a cluster, and for a part of many million jobs to be small.
PARTS = 4096


def with_state_store(spark: SparkSession) -> SparkSession:
    """Timers need a state store with several columns for each key."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


class _Watch(StatefulProcessor):
    """The attempts that run, of all jobs of a part, with a timer for the first of them that is due."""

    def __init__(self, seconds: float) -> None:
        self.limit = int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Jobs and the moments of their starts, in microseconds, as packed numbers of 64 bits.
        self.running = handle.getValueState("running", "jobs binary, at binary")

    def _due(self, us):
        """The timer's millisecond: the clock must be beyond it, so it is the last one before the moment, rounded up."""
        return -(-us // 1000) + self.limit - 1

    def _known(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.running.exists():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        jobs, at = self.running.get()
        return np.frombuffer(bytes(jobs), np.int64), np.frombuffer(bytes(at), np.int64)

    def _keep(self, jobs: np.ndarray, at: np.ndarray) -> None:
        if len(jobs):
            self.running.update((jobs.tobytes(), at.tobytes()))
        else:
            self.running.clear()

    def _ordered(self, jobs: np.ndarray, at: np.ndarray, starts: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Job, moment, and whether there are a start and an end, for each moment of a job; the ``known`` first rows are of the
        state and come before the job's others."""
        new = np.arange(len(jobs)) >= known
        order = np.lexsort((at, new, jobs))
        jobs, at, new, starts = jobs[order], at[order], new[order], starts[order]
        first = np.flatnonzero(np.r_[True, (jobs[1:] != jobs[:-1]) | (at[1:] != at[:-1]) | (new[1:] != new[:-1])])
        return jobs[first], at[first], np.logical_or.reduceat(starts, first), np.logical_or.reduceat(~starts, first)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self._known()
        parts = [(p["job_id"].to_numpy(np.int64), p["us"].to_numpy(np.int64), p["running"].to_numpy(bool)) for p in rows]
        jobs, at, starts = (np.concatenate(c) for c in zip((*known, np.ones(len(known[0]), bool)), *parts, strict=True))
        jobs, at, start, end = self._ordered(jobs, at, starts, len(known[0]))
        same = np.r_[False, jobs[1:] == jobs[:-1]]
        in_time = np.r_[False, at[1:] <= at[:-1] + self.limit * 1000]
        # The end of an attempt and the start of the next one if an attempt was running, else one that took no time.
        after = start & end & same & in_time
        said = np.maximum.accumulate(np.where(after, 0, np.arange(len(jobs))))
        runs = (start & ~end)[said]
        late = np.flatnonzero(runs[:-1] & same[1:] & ~in_time[1:])
        left = runs & np.r_[~same[1:], True]
        self._keep(jobs[left], at[left])
        self._timer(known[1], at[left])
        return iter([self._found(jobs[late], at[late])] if len(late) else [])

    def _timer(self, before: np.ndarray, now: np.ndarray) -> None:
        before, now = (self._due(int(x.min())) if len(x) else None for x in (before, now))
        if before != now:
            if before is not None:
                self.handle.deleteTimer(before)
            if now is not None:
                self.handle.registerTimer(now)

    def _found(self, jobs: np.ndarray, at: np.ndarray) -> pd.DataFrame:
        moments = [pd.DatetimeIndex(x.view("datetime64[us]"), tz="UTC") for x in (at, at + self.limit * 1000)]
        return pd.DataFrame(dict(zip(_FOUND, (jobs, *moments), strict=True)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        jobs, at = self._known()
        beyond = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        gone = self._due(at) <= beyond
        self._keep(jobs[~gone], at[~gone])
        if not gone.all():
            self.handle.registerTimer(self._due(int(at[~gone].min())))
        if gone.any():
            yield self._found(jobs[gone], at[gone])

    def close(self) -> None:
        pass


def attempts_timed_out(changes: DataFrame, seconds: float, late: str = "0 seconds", parts: int = PARTS) -> DataFrame:
    """Of changes of state (job_id, at, status), jobs still running ``seconds`` after their start, as soon as the stream's
    clock (its watermark, in milliseconds) has come to that moment; no further row of the job is needed. Rows of a job may come
    in any order within a batch, and one that lies beyond the moment shows the timeout too. Of an end and a start at one moment the end
    comes first if an attempt was running, else last. Rows without a job or moment say nothing.

    A state and a timer for each job would cost several calls between Python and the store for each. So jobs are dealt into
    ``parts`` by hash, and a part's running attempts are one state; a task holds one part's rows of a batch at a time. A stream
    keeps its number of parts for as long as it keeps its checkpoint."""
    with_state_store(changes.sparkSession)
    rows = changes.filter("job_id is not null and at is not null").select(
        F.pmod(F.xxhash64("job_id"), F.lit(parts)).alias("part"), F.col("job_id").cast("long").alias("job_id"), F.col("at").cast("timestamp").alias("at"),
        F.unix_micros(F.col("at").cast("timestamp")).alias("us"), F.col("status").eqNullSafe("running").alias("running"),
    ).withWatermark("at", late)
    return rows.groupBy("part").transformWithStateInPandas(statefulProcessor=_Watch(seconds), outputStructType=TIMED_OUT, outputMode="append", timeMode="EventTime")


class _Once(StatefulProcessor):
    """Says of each key whether it was seen before; forgets it after a time without use."""

    def __init__(self, seconds: float) -> None:
        self.idle = int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long", self.idle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = self.seen.get()[0] if self.seen.exists() else 0
        out = []
        for part in rows:
            for at in part["at"]:
                out.append((key[0], at, n == 0))
                n += 1
        self.seen.update((n,))
        yield pd.DataFrame(out, columns=["key", "at", "first"])

    def close(self) -> None:
        pass


def warned_once(rows: DataFrame, idle: float) -> DataFrame:
    """(key, at, first) of rows (key, at): ``first`` for the first row of a key, and for one after ``idle`` seconds in which the
    key had none, by the cluster's clock; the state of idle keys goes by itself."""
    with_state_store(rows.sparkSession)
    return rows.select("key", F.col("at").cast("timestamp").alias("at")).groupBy("key").transformWithStateInPandas(statefulProcessor=_Once(idle), outputStructType="key string, at timestamp, first boolean", outputMode="append", timeMode="ProcessingTime")
