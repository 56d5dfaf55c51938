"""State transitions: each reads the affected rows once and gives their new values, attempts and events."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.columns import TRANSITIONS, counted_up, lease_expired, merged, moment, past_deadline, promotable, seconds

DEADLINE = "schedule_to_close reached before next dispatch"


@dataclass
class Transition:
    """``rows`` are new values by id; ``attempts`` and ``events`` are to be appended."""

    rows: DataFrame
    attempts: DataFrame
    events: DataFrame

    def apply(self, jobs: DataFrame) -> DataFrame:
        """``jobs`` with the new values in place of the old; one join by id."""
        new = [c for c in self.rows.columns if c in jobs.columns and c != "id"]
        delta = self.rows.select("id", F.struct(*new).alias("_new"))
        joined = jobs.join(delta, "id", "left")
        return joined.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns])


def _changed(jobs: DataFrame, affected: Column, now, **new: Column) -> DataFrame:
    """Affected rows with their former state and the new values."""
    rows = jobs.filter(affected)
    keep = [c for c in ("id", "actor", "queue", "attempt", "max_attempts", "retry_kind", "scheduled_at", "started_at", "finished_at", "cancel_phase", "metadata") if c in jobs.columns]
    return rows.select(*[new.get(c, F.col(c)).alias(c) for c in keep], F.col("status").alias("from_state"), new.get("status", F.col("status")).alias("status"), *[v.alias(c) for c, v in new.items() if c not in keep and c != "status"])


def _audit(rows: DataFrame, now, outcome, error: Column | None = None, reason: str | None = None, to_state: Column | None = None) -> tuple[DataFrame, DataFrame]:
    at = moment(now)
    attempts = rows.select(F.col("id").alias("job_id"), "attempt", F.coalesce("started_at", at).alias("started_at"), at.alias("finished_at"), (outcome if isinstance(outcome, Column) else F.lit(outcome)).alias("outcome"), (error if error is not None else F.lit(None).cast("string")).alias("error_class"))
    detail = F.to_json(F.struct(F.col("from_state").alias("from"), (to_state if to_state is not None else F.col("status")).alias("to"), F.lit(reason).alias("reason")))
    return attempts, rows.select(F.col("id").alias("job_id"), at.alias("occurred_at"), F.lit("state_change").alias("kind"), detail.alias("detail"))


def _owned(worker: int | None) -> Column:
    own = F.col("status") == "running"
    return own if worker is None else own & (F.col("locked_by_worker") == worker)


def _plain(jobs: DataFrame, affected: Column, now, status, outcome, error: str | None = None, to_state=None, **new) -> Transition:
    status = status if isinstance(status, Column) else F.lit(status)
    error_class = F.lit(error).cast("string")
    values = {"status": status, "finished_at": moment(now), "locked_by_worker": F.lit(None).cast("long"), "lock_expires_at": F.lit(None).cast("timestamp_ntz"), "error_class": error_class} | new
    rows = _changed(jobs, affected, now, **values)
    return Transition(rows, *_audit(rows, now, outcome, error_class, to_state=to_state))


def succeed(jobs: DataFrame, actor_config: DataFrame, now, worker: int | None = None, result: str = "{}") -> Transition:
    """Results over 64 KiB are errors; they expire after the actor's time to live, if it has one."""
    if len(result.encode()) > 65_536:
        raise ValueError("the result is larger than 65536 bytes")
    met = jobs.join(actor_config.select("actor", "result_ttl"), "actor", "left")
    expires = F.when(F.col("result_ttl").isNotNull(), moment(now) + seconds(F.col("result_ttl").cast("decimal(18,6)")))
    return _plain(met, _owned(worker), now, "succeeded", "succeeded", result=F.lit(result), result_size_bytes=F.lit(len(result.encode())), result_expires_at=expires)


def fail(jobs: DataFrame, now, worker: int | None = None, error: str = "Error") -> Transition:
    return _plain(jobs, _owned(worker), now, "failed", "failed", error)


def retry(jobs: DataFrame, now, delay: float, worker: int | None = None, error: str = "Error") -> Transition:
    """Scheduled if its time lies ahead, else pending; the event says scheduled in either case."""
    status = F.when(F.lit(delay) > 0, "scheduled").otherwise("pending")
    return _plain(jobs, _owned(worker), now, status, "failed", error, F.lit("scheduled"), scheduled_at=moment(now) + seconds(delay), finished_at=F.lit(None).cast("timestamp_ntz"))


def cancel(jobs: DataFrame, now, worker: int | None = None) -> Transition:
    return _plain(jobs, _owned(worker), now, "cancelled", "cancelled")


def escalate(jobs: DataFrame, now, worker: int | None = None) -> Transition:
    rows = _changed(jobs, _owned(worker) & (F.col("cancel_phase") == 1), now, cancel_phase=F.lit(2))
    _, events = _audit(rows, now, None, reason="phase 2")
    return Transition(rows, rows.limit(0), events)


def abandon(jobs: DataFrame, now) -> Transition:
    """Needs phase 2; the attempt counts as cancelled, and the lock columns stay."""
    rows = _changed(jobs, (F.col("status") == "running") & (F.col("cancel_phase") == 2), now, status=F.lit("abandoned"), finished_at=moment(now))
    return Transition(rows, *_audit(rows, now, "cancelled"))


def _in_time(now, delay: float) -> Column:
    return F.col("schedule_to_close").isNull() | (moment(now) + seconds(delay) <= F.col("schedule_to_close"))


def _branched(jobs: DataFrame, worker: int | None, now, delay: float, branch: Column, more: bool, metadata: Column | None = None, outcome: str = "snoozed") -> Transition:
    rows = jobs.filter(_owned(worker)).withColumn("branch", branch)
    waits = F.col("branch") == "snoozed"
    idle = F.col("branch") == "noop"
    status = F.when(idle, F.col("status")).when(waits, F.lit("scheduled" if delay > 0 else "pending")).otherwise("failed")
    error = F.when(F.col("branch") == "max_attempts_failed", "MaxAttemptsExceeded").when(F.col("branch") == "deadline_failed", "DeadlineExceeded")
    new = {
        "status": status,
        "scheduled_at": F.when(waits, moment(now) + seconds(delay)).otherwise(F.col("scheduled_at")),
        "finished_at": F.when(~waits & ~idle, moment(now)),
        "max_attempts": F.when(waits & F.lit(more), F.col("max_attempts") + 1).otherwise(F.col("max_attempts")),
        "error_class": error,
        "branch": F.col("branch"),
    }
    if metadata is not None:
        new["metadata"] = F.when(waits, metadata).otherwise(F.col("metadata"))
    out = _changed(rows, F.lit(True), now, **new)
    live = out.filter("branch <> 'noop'")
    return Transition(out, *_audit(live, now, F.when(F.col("branch") == "snoozed", outcome).otherwise("failed"), F.col("error_class")))


def snooze(jobs: DataFrame, now, delay: float, worker: int | None = None, metadata: str | None = None, count: bool | None = None, outcome: str = "snoozed") -> Transition:
    """Waits without using an attempt if the deadline allows, else fails. ``metadata`` is merged into the job's; without
    it the job's ``snooze_count`` goes up by one, unless ``count`` says otherwise."""
    branch = F.when(_in_time(now, delay), "snoozed").otherwise("deadline_failed")
    new = None
    if "metadata" in jobs.columns:
        new = merged(F.col("metadata"), F.lit(metadata)) if metadata is not None else F.col("metadata")
        new = counted_up(new, "snooze_count") if (metadata is None if count is None else count) else new
    return _branched(jobs, worker, now, delay, branch, True, new, outcome)


def deny(jobs: DataFrame, now, delay: float, bucket: str, worker: int | None = None) -> Transition:
    """A reservation or limit had nothing to give: waits like a snooze, noting for what instead of counting."""
    return snooze(jobs, now, delay, worker, json.dumps({"awaiting": f"reservation:{bucket}"}), False, "reservation_denied")


def retry_after(jobs: DataFrame, now, delay: float, consume: bool = True, worker: int | None = None) -> Transition:
    """With ``consume`` an attempt is used up. A non-retryable job without attempts left matches no branch: ``noop``."""
    if not consume:
        return snooze(jobs, now, delay, worker, count=False)
    timely = _in_time(now, delay)
    left = (F.col("retry_kind") == "indefinite") | (F.col("attempt") < F.col("max_attempts"))
    spent = (F.col("retry_kind") == "transient") & (F.col("attempt") >= F.col("max_attempts"))
    branch = F.when(timely & left, "snoozed").when(timely & spent, "max_attempts_failed").when(~timely, "deadline_failed").otherwise("noop")
    return _branched(jobs, worker, now, delay, branch, False)


def request_cancel(jobs: DataFrame, ids: DataFrame, now) -> Transition:
    """Waiting jobs are cancelled at once, running ones enter phase 1; the rest say no."""
    rows = jobs.join(ids.select("id").distinct(), "id", "left_semi")
    waits = F.col("status").isin("pending", "scheduled")
    asks = (F.col("status") == "running") & (F.col("cancel_phase") == 0)
    out = _changed(rows, F.lit(True), now, status=F.when(waits, "cancelled").otherwise(F.col("status")), finished_at=F.when(waits, moment(now)).otherwise(F.col("finished_at")), cancel_phase=F.when(asks, 1).otherwise(F.col("cancel_phase")), initiated=waits | asks)
    done = out.filter("initiated")
    attempts, events = _audit(done, now, "cancelled", reason="cancel_request")
    return Transition(out, attempts.limit(0), events)


def retry_by_hand(jobs: DataFrame, ids: DataFrame, now) -> Transition:
    """Failed, crashed and cancelled jobs start over; abandoned ones don't. No event is written."""
    rows = _changed(jobs.join(ids.select("id").distinct(), "id", "left_semi"), F.col("status").isin("failed", "crashed", "cancelled"), now, status=F.lit("pending"), attempt=F.lit(0), scheduled_at=moment(now), finished_at=F.lit(None).cast("timestamp_ntz"))
    attempts, events = _audit(rows, now, None)
    return Transition(rows, attempts.limit(0), events.limit(0))


def _reclaimed(jobs: DataFrame, affected: Column, now, error: str, wait: float, reason: str | None) -> Transition:
    again = (F.col("attempt") < F.col("max_attempts")) & (F.col("retry_kind") != "non_retryable")
    rows = _changed(jobs, affected, now, status=F.when(again, "pending").otherwise("crashed"), scheduled_at=F.when(again, moment(now) + seconds(wait)).otherwise(F.col("scheduled_at")), finished_at=F.when(~again, moment(now)), error_class=F.lit(error))
    attempts, events = _audit(rows, now, "crashed", F.lit(error), reason)
    return Transition(rows, attempts, events if reason else events.limit(0))


def reclaim(jobs: DataFrame, now, grace: float = 30, cleanup: float = 10) -> Transition:
    return _reclaimed(jobs, lease_expired(now, grace, cleanup), now, "WorkerCrashed", 5, "lock_expired")


def isolate(jobs: DataFrame, now, worker: int) -> Transition:
    return _reclaimed(jobs, _owned(worker), now, "HeartbeatLost", 5, None)


def expire_deadlines(jobs: DataFrame, now) -> Transition:
    rows = _changed(jobs, past_deadline(now), now, status=F.lit("failed"), finished_at=moment(now), error_class=F.lit("DeadlineExceeded"), error_message=F.lit(DEADLINE))
    return Transition(rows, *_audit(rows, now, "failed", F.lit("DeadlineExceeded"), "deadline"))


def promote(jobs: DataFrame, now) -> Transition:
    rows = _changed(jobs, promotable(now), now, status=F.lit("pending"))
    attempts, events = _audit(rows, now, None)
    return Transition(rows, attempts.limit(0), events)


def drain(jobs: DataFrame, now, worker: int) -> Transition:
    """Claimed rows that never started go back; neither attempts nor events are written."""
    rows = _changed(jobs, _owned(worker) & F.col("started_at").isNull(), now, status=F.lit("pending"), locked_by_worker=F.lit(None).cast("long"))
    attempts, events = _audit(rows, now, None)
    return Transition(rows, attempts.limit(0), events.limit(0))


def release_slots(slots: DataFrame, now) -> DataFrame:
    """Slots with leaked leases, emptied."""
    return slots.filter((F.col("lease_expires_at") < moment(now)) & F.col("job_id").isNotNull()).select("bucket_name", "slot_index", F.lit(None).cast("long").alias("job_id"), F.lit(None).cast("timestamp_ntz").alias("lease_expires_at"))


def expire_results(jobs: DataFrame, now, ttl: float) -> DataFrame:
    """Ids whose results have outlived ``ttl`` seconds after the end."""
    return jobs.filter((F.col("status") == "succeeded") & (F.col("finished_at") + seconds(ttl) < moment(now))).select("id", F.lit(None).cast("string").alias("result"))


def heartbeat(jobs: DataFrame, workers: DataFrame, worker: int, now, lease: float) -> tuple[DataFrame, DataFrame]:
    """The worker as seen now, and its running jobs with longer leases."""
    seen = workers.filter(F.col("id") == worker).withColumn("last_seen_at", moment(now))
    return seen, jobs.filter(_owned(worker)).select("id", moment(now).alias("last_heartbeat_at"), (moment(now) + seconds(lease)).alias("lock_expires_at"))


def progress_parts(updates: DataFrame) -> DataFrame:
    """(job_id, worker_id, key, turn, value, delta) of updates (job_id, worker_id, turn, delta, state): a row for each key of
    a state, and one without key that carries the delta. A null delta counts as none, a state that is null or no object
    has no keys."""
    entries = F.transform(F.map_entries(F.from_json("state", "map<string,variant>")), lambda e: F.struct(e["key"].alias("key"), F.coalesce(F.to_json(e["value"]), F.lit("null")).alias("value"), F.lit(None).cast("long").alias("delta")))
    count = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"), F.coalesce(F.col("delta").cast("long"), F.lit(0)).alias("delta")))
    parts = F.concat(count, F.coalesce(entries, F.filter(count, lambda e: F.lit(False))))
    return updates.select("job_id", "worker_id", F.col("turn").cast("long").alias("turn"), F.explode(parts).alias("p")).select("job_id", "worker_id", "p.key", "turn", "p.value", "p.delta")


def folded_parts(parts: DataFrame) -> DataFrame:
    """Parts once for each job, worker and key: deltas add up; of one key the highest ``turn`` wins, then the larger text.
    In any order and grouping the result is the same."""
    best = F.max(F.struct("turn", "value"))
    return parts.groupBy("job_id", "worker_id", "key").agg(best.alias("b"), F.sum("delta").alias("delta")).select("job_id", "worker_id", "key", "b.turn", "b.value", "delta")


def flush_parts(jobs: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, progress_seq, progress_state) of running jobs that their own worker reported on, one row for each: the sum of
    all deltas on top of the job's number, and all states merged into its state."""
    quoted = F.to_json(F.struct(F.col("key").alias("k")))  # {"k":...}
    entry = F.when(F.col("key").isNotNull(), F.struct("key", F.concat(quoted.substr(F.lit(6), F.length(quoted) - 6), F.lit(":"), F.col("value")).alias("text")))
    by_job = parts.groupBy("job_id", "worker_id").agg(F.sum("delta").alias("delta"), F.array_sort(F.collect_list(entry)).alias("entries"))
    state = F.when(F.size("entries") > 0, F.concat(F.lit("{"), F.array_join(F.transform("entries", lambda e: e["text"]), ","), F.lit("}")))
    own = jobs.filter("status = 'running'").select("id", "locked_by_worker", "progress_seq", "progress_state")
    met = own.join(by_job.select("job_id", "worker_id", "delta", state.alias("state")), (F.col("id") == F.col("job_id")) & (F.col("locked_by_worker") == F.col("worker_id")))
    return met.select("id", (F.coalesce("progress_seq", F.lit(0)) + F.coalesce("delta", F.lit(0))).cast("int").alias("progress_seq"), merged(F.col("progress_state"), F.col("state")).alias("progress_state"))


def flush_progress(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """``flush_parts`` of updates (job_id, worker_id, turn, delta, state), several for a job or none."""
    return flush_parts(jobs, folded_parts(progress_parts(updates)))


def illegal(events: DataFrame) -> DataFrame:
    """Events whose change of state isn't in the table of transitions."""
    allowed = events.sparkSession.createDataFrame(TRANSITIONS, "f string, t string")
    return events.join(F.broadcast(allowed), F.col("from_state").eqNullSafe(F.col("f")) & (F.col("to_state") == F.col("t")), "left_anti")


def cancel_phase(cancel_requested_at: Column, now, grace: float, cleanup: float) -> Column:
    """Phase by time since the request: 1, 2 from the grace period on, abandoned after the cleanup period too."""
    waited = moment(now) - cancel_requested_at
    return F.when(waited >= seconds(grace + cleanup), "abandoned").when(waited >= seconds(grace), "phase2").otherwise("phase1")


def classified(failures: DataFrame, now, delay: Column) -> DataFrame:
    """What follows a failure, in this order: type, payload, kind, attempts, deadline."""
    again_at = moment(now) + F.make_dt_interval(secs=delay.cast("decimal(18,6)"))
    late = F.col("schedule_to_close").isNotNull() & (again_at >= F.col("schedule_to_close"))
    spent = (F.col("retry_kind") == "transient") & (F.col("attempt") >= F.col("max_attempts"))
    decision = F.when(F.col("non_retryable_type"), "fail:NonRetryable").when(F.col("payload_error"), "fail:PayloadError").when(F.col("retry_kind") == "non_retryable", "fail:NonRetryable").when(spent, "fail:MaxAttempts").when(late, "fail:DeadlineExceeded").otherwise("retry")
    return failures.withColumn("decision", decision).withColumn("delay", F.when(F.col("decision") == "retry", delay))
