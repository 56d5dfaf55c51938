"""What attempts ended with, applied to their jobs: one transition in which every row takes its own branch.

| outcome | in time, attempts left | else |
|---|---|---|
| ``succeeded`` | succeeded, result kept, children enqueued | result over 64 KiB: as ``retry`` with ``ResultTooLarge`` |
| ``cancelled`` | cancelled | |
| ``failed`` | failed with its error class | |
| ``retry`` | scheduled after the backoff (or the outcome's own delay) | failed with its error class |
| ``snoozed`` | scheduled, one more attempt allowed, ``snooze_count`` up | ``DeadlineExceeded`` |
| ``retry_after`` | scheduled, an attempt used | ``MaxAttemptsExceeded``, ``DeadlineExceeded``, or nothing |
| ``retry_after_free``, ``actor_not_found`` | scheduled, one more attempt allowed | ``DeadlineExceeded`` |
| ``reservation_denied`` | scheduled, one more attempt allowed, ``awaiting`` the bucket | ``DeadlineExceeded`` |

Jobs that aren't running any more, or not for that worker, take no outcome; of several outcomes for one job in a batch the
one that sorts first counts, so that a job gets one row. Unknown and null outcomes leave the job as it is. A null delay is
none. Where outcomes carry ``progress_seq`` and ``progress_state`` these are written too: the number as it is, the state merged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.columns import backoff, counted_up, merged, moment, result_bytes, seconds
from jobloom.plans.transitions import Transition, _audit, _changed, _owned

MOST_RESULT_BYTES = 65_536
WAITS = ("snoozed", "retry_after", "retry_after_free", "actor_not_found", "reservation_denied")
_TOLD = {"outcome": "string", "result": "string", "error_class": "string", "delay": "double", "bucket": "string", "progress_seq": "int", "progress_state": "string", "children": "array<struct<actor:string,payload:string>>"}
_LATE = ("deadline_failed", "max_attempts_failed", "retries_failed", "failed")


@dataclass
class Applied(Transition):
    """Besides rows, attempts and events: jobs to enqueue (parent_id, ordinal, actor, payload), and jobs that are dead
    (job_id, actor, attempt, cause, error_class), for hooks and reports."""

    children: DataFrame
    exhausted: DataFrame


def _told(outcomes: DataFrame) -> DataFrame:
    """One struct of all known columns for each id; missing ones are null."""
    known = [(F.col(c).cast(t) if c in outcomes.columns else F.lit(None).cast(t)).alias(c) for c, t in _TOLD.items()]
    return outcomes.filter("id is not null").groupBy("id").agg(F.min(F.struct(*known)).alias("_told"))


def _branch(now, delay: Column) -> Column:
    """By outcome, deadline and attempts; deadlines of retries exclude the moment itself, those of waits include it."""
    said, at, close = F.col("_told.outcome"), moment(now) + seconds(delay.cast("decimal(18,6)")), F.col("schedule_to_close")
    timely = close.isNull() | (at <= close)
    spent = (F.col("retry_kind") == "transient") & (F.col("attempt") >= F.col("max_attempts"))
    left = (F.col("retry_kind") == "indefinite") | (F.col("attempt") < F.col("max_attempts"))
    dead = (F.col("retry_kind") == "non_retryable") | spent | (close.isNotNull() & (at >= close))
    large = result_bytes(F.col("_told.result")) > MOST_RESULT_BYTES
    again = F.when(dead, "retries_failed").otherwise("retried")
    after = F.when(timely & left, "snoozed").when(timely & spent, "max_attempts_failed").when(~timely, "deadline_failed").otherwise("noop")
    found = F.when(said == "succeeded", F.when(F.coalesce(large, F.lit(False)), again).otherwise("succeeded")).when(said.isin("cancelled", "failed"), said).when(said == "retry", again).when(said == "retry_after", after)
    return found.when(said.isin(*WAITS), F.when(timely, "snoozed").otherwise("deadline_failed")).otherwise("noop")


def apply_outcomes(jobs: DataFrame, outcomes: DataFrame, now, worker: int | None = None, actor_config: DataFrame | None = None, retry: tuple[str, float, float, float] = ("exponential", 1.0, 3600.0, 86_400.0)) -> Applied:
    """Outcomes (id, outcome, ...; see ``actors.OUTCOMES``) of running jobs. ``retry`` is kind, base, cap and overall cap
    of the backoff; ``actor_config`` (actor, result_ttl) says how long results stay.

    One join by id, over outcomes that were first reduced to a row for each job, which needs the same shuffle.
    """
    met = jobs.filter(_owned(worker)).join(_told(outcomes), "id")
    told = lambda c: F.col(f"_told.{c}")
    if actor_config is not None:
        met = met.join(actor_config.select("actor", "result_ttl"), "actor", "left")
    met = met.withColumn("_delay", F.when(told("outcome").isin("retry", "succeeded"), F.coalesce(told("delay"), backoff(F.col("attempt"), *retry))).otherwise(F.coalesce(told("delay"), F.lit(0.0))))
    met = met.withColumn("branch", _branch(now, F.col("_delay")))
    branch, at = F.col("branch"), moment(now)
    then = at + seconds(F.col("_delay").cast("decimal(18,6)"))
    waits = branch.isin("snoozed", "retried")
    idle = branch == "noop"
    status = F.when(idle, F.col("status")).when(waits, F.when(F.col("_delay") > 0, "scheduled").otherwise("pending")).when(branch.isin("succeeded", "cancelled"), branch).otherwise("failed")
    large = (told("outcome") == "succeeded") & branch.isin("retried", "retries_failed")
    error = F.when(branch == "deadline_failed", "DeadlineExceeded").when(branch == "max_attempts_failed", "MaxAttemptsExceeded").when(large, "ResultTooLarge").when(branch.isin("failed", "retried", "retries_failed"), told("error_class"))
    more = (branch == "snoozed") & (told("outcome") != "retry_after")
    noted = F.when((branch == "snoozed") & (told("outcome") == "snoozed"), counted_up(F.col("metadata"), "snooze_count"))
    noted = noted.when((branch == "snoozed") & (told("outcome") == "reservation_denied"), merged(F.col("metadata"), F.to_json(F.struct(F.concat(F.lit("reservation:"), F.coalesce(told("bucket"), F.lit(""))).alias("awaiting")))))
    kept = branch == "succeeded"
    new = {
        "status": status,
        "scheduled_at": F.when(waits, then).otherwise(F.col("scheduled_at")),
        "finished_at": F.when(idle | waits, F.lit(None)).otherwise(at),
        "max_attempts": F.when(more, F.col("max_attempts") + 1).otherwise(F.col("max_attempts")),
        "metadata": noted.otherwise(F.col("metadata")),
        "error_class": error,
        "locked_by_worker": F.when(idle, F.col("locked_by_worker")),
        "lock_expires_at": F.when(idle, F.col("lock_expires_at")),
        "branch": branch,
        "result": F.when(kept, told("result")),
        "result_size_bytes": F.when(kept, result_bytes(told("result"))),
        "_told": F.col("_told"),
    }
    if actor_config is not None:
        new["result_expires_at"] = F.when(kept & F.col("result_ttl").isNotNull(), at + seconds(F.col("result_ttl").cast("decimal(18,6)")))
    if "progress_seq" in jobs.columns:
        new["progress_seq"] = F.when(idle, F.col("progress_seq")).otherwise(F.coalesce(told("progress_seq"), F.col("progress_seq")))
        new["progress_state"] = F.when(idle | told("progress_state").isNull(), F.col("progress_state")).otherwise(merged(F.coalesce("progress_state", F.lit("{}")), told("progress_state")))
    out = _changed(met, F.lit(True), now, **new)
    live = out.filter("branch <> 'noop'")
    attempt = F.when(branch == "snoozed", F.when(told("outcome") == "reservation_denied", "reservation_denied").otherwise("snoozed")).when(branch.isin("succeeded", "cancelled"), branch).otherwise("failed")
    attempts, events = _audit(live, now, attempt, F.col("error_class"), to_state=F.when(branch == "retried", "scheduled").otherwise(F.col("status")))
    asked = out.filter("branch = 'succeeded'").select(F.col("id").alias("parent_id"), F.posexplode("_told.children").alias("ordinal", "child"))
    cause = F.when(branch == "retries_failed", F.when(F.col("retry_kind") == "non_retryable", "NonRetryable").when((F.col("retry_kind") == "transient") & (F.col("attempt") >= F.col("max_attempts")), "MaxAttempts").otherwise("DeadlineExceeded")).otherwise(F.col("error_class"))
    dead = out.filter(branch.isin(*_LATE)).select(F.col("id").alias("job_id"), "actor", "attempt", cause.alias("cause"), "error_class")
    return Applied(out.drop("_told"), attempts, events, asked.select("parent_id", "ordinal", "child.actor", "child.payload"), dead)
