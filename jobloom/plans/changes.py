"""Queries over dispatch, transitions, enqueueing, lifecycle, rate limits, cron, streams and actors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions import columns as C
from jobloom.operators import actors, cron, ratelimit
from jobloom.plans import dispatch, enqueue, lifecycle, schedules, transitions
from jobloom.plans.registry import query
from jobloom.sources.fixtures import NOW, Tables
from jobloom.sources.shared import new_folder
from jobloom.streaming import streams

ORDER = "priority desc, scheduled_at, id"
_DUE = "status = 'pending' and scheduled_at <= NOW and (schedule_to_close is null or schedule_to_close > NOW)"


def shared_path(t: Tables, label: str) -> str:
    return new_folder(t.spark, label)


# Dispatch


def _dispatch_sql(limit: int, oversample: int, fair: bool, queues: str = "'q0', 'q1', 'q2'") -> str:
    keys = "j.actor, j.queue" + (", coalesce(j.fairness_key, '__null__')" if fair else "")
    f = "fairness_rank, " if fair else ""
    return f"""with cap as (select a.actor, a.max_concurrent, coalesce(r.n, 0) as in_flight, case when a.max_concurrent is null then {limit} else greatest(a.max_concurrent - coalesce(r.n, 0), 0) end as residual
        from actor_config a left join (select actor, count(*) as n from jobs where status = 'running' group by actor) r on a.actor = r.actor),
      cand as (select * from (select j.*, c.max_concurrent, c.in_flight, c.residual, row_number() over (partition by {keys} order by {ORDER}) as fairness_rank from jobs j join cap c on j.actor = c.actor where j.queue in ({queues}) and {_DUE} and residual > 0) where fairness_rank <= residual * {oversample}),
      ident as (select * exclude (n) from (select *, row_number() over (partition by actor, identity_key order by {ORDER}) as n from cand where identity_key is not null and (actor, identity_key) not in (select actor, identity_key from jobs where status = 'running' and identity_key is not null)) where n = 1
        union all select * from cand where identity_key is null),
      ranked as (select *, row_number() over (partition by actor order by {f}{ORDER}) as pending_rank from ident),
      locked as (select * from ranked order by pending_rank, {ORDER} limit {limit}),
      elig as (select *, row_number() over (partition by actor order by {f}{ORDER}) as actor_rank from locked)
      select id, actor, queue, pending_rank from elig where max_concurrent is null or actor_rank <= max_concurrent - in_flight order by pending_rank, {f}{ORDER} limit {limit}"""


def _dispatch(name: str, limit: int, fair: bool, oversample: int = 2) -> None:
    @query(name, _dispatch_sql(limit, oversample, fair))
    def run(t: Tables) -> DataFrame:
        return dispatch.dispatch(t.jobs, t.actor_config, ["q0", "q1", "q2"], limit, NOW, oversample, fair).select("id", "actor", "queue", "pending_rank")


_dispatch("dml1_dispatch_fifo", 50, False)
_dispatch("dml1_dispatch_fifo_5000", 5000, False)
_dispatch("dml2_dispatch_round_robin", 50, True)
_dispatch("dml2_dispatch_round_robin_5000", 5000, True)
_dispatch("srt7_eligible_order", 20, True)
_dispatch("srt8_limit_before_caps", 200, False)


@query("dml1_claimed_rows", f"select id, 'running' as status, 1 as attempt, cast(9 as bigint) as locked_by_worker, NOW + interval '60' second as lock_expires_at from ({_dispatch_sql(50, 2, False)})")
def claimed(t: Tables) -> DataFrame:
    chosen = dispatch.dispatch(t.jobs, t.actor_config, ["q0", "q1", "q2"], 50, NOW)
    return dispatch.claimed(chosen, 9, NOW, 60).select("id", "status", "attempt", "locked_by_worker", "lock_expires_at")


# Enqueue


def _requests(t: Tables) -> DataFrame:
    return t.sql(_REQUESTS)


_REQUESTS = """select o_orderkey as ordinal, case when o_orderkey%4=0 then 'click' when o_orderkey%4=1 then 'view' when o_orderkey%4=2 then 'purchase' else 'signup' end as actor,
  case when o_orderkey%5=0 then concat('u', cast(o_orderkey%150 as varchar(9))) end as identity_key, case when o_orderkey%3=0 then concat('k', cast(o_custkey*2 as varchar(9))) end as idempotency_key,
  case when o_orderkey%7=0 then timestamp '2024-02-01 00:00:00' end as scheduled_at, '{}' as metadata, o_custkey from orders"""


@query("snk1_initial_status", f"select ordinal, case when coalesce(scheduled_at, NOW) > NOW then 'scheduled' else 'pending' end as status from ({_REQUESTS})")
def snk1(t: Tables) -> DataFrame:
    return _requests(t).select("ordinal", C.initial_status(F.col("scheduled_at"), NOW).alias("status"))


_ENQ = f"""with r as ({_REQUESTS}), uq as (select actor, identity_key, arg_max(id, created_at) as unique_id from jobs where created_at > NOW - interval '2' day and status in ('pending','scheduled','running') and identity_key is not null group by actor, identity_key),
  k as (select idempotency_key, id as existing_id from jobs where idempotency_key is not null), w as (select actor, count(*) as waiting from jobs where status in ('pending','scheduled') group by actor),
  a as (select r.*, unique_id, k.existing_id, r.idempotency_key is null or row_number() over (partition by r.idempotency_key order by ordinal) = 1 as first_key from r left join uq on r.actor = uq.actor and r.identity_key = uq.identity_key left join k on r.idempotency_key = k.idempotency_key),
  b as (select a.*, coalesce(count(*) filter (where unique_id is null and a.existing_id is null and first_key) over (partition by a.actor order by ordinal rows between unbounded preceding and 1 preceding), 0) as bf from a)
  select ordinal, b.actor, case when unique_id is not null then 'unique' when c.max_pending is not null and coalesce(w.waiting, 0) + bf >= c.max_pending then 'max_pending' when existing_id is not null or not first_key then 'existing' else 'inserted' end as outcome
  from b left join actor_config c on b.actor = c.actor left join w on b.actor = w.actor"""


@query("dml3_enqueue", _ENQ)
def dml3(t: Tables) -> DataFrame:
    return enqueue.enqueue(t.jobs, _requests(t), t.actor_config, NOW, 2 * 86400).select("ordinal", "actor", "outcome")


_BATCH = f"""with r as ({_REQUESTS}), w as (select actor, count(*) as waiting from jobs where status in ('pending','scheduled') group by actor), n as (select actor, count(*) as wanted from r group by actor),
  f as (select n.actor, coalesce(coalesce(w.waiting, 0) + n.wanted >= c.max_pending, false) as refused from n left join actor_config c on n.actor = c.actor left join w on n.actor = w.actor),
  k as (select idempotency_key, id as existing_id from jobs where idempotency_key is not null)
  select ordinal, r.actor, case when refused then 'max_pending' when existing_id is not null or (r.idempotency_key is not null and min(ordinal) over (partition by r.idempotency_key) < ordinal) then 'existing' else 'inserted' end as outcome, existing_id
  from r join f on r.actor = f.actor left join k on r.idempotency_key = k.idempotency_key"""


@query("dml4_enqueue_batch", _BATCH)
def dml4(t: Tables) -> DataFrame:
    return enqueue.enqueue_batch(t.jobs, _requests(t), t.actor_config, NOW).select("ordinal", "actor", "outcome", "existing_id")


@query("snk2_batch_returning", f"select ordinal, existing_id from ({_BATCH}) where outcome = 'existing'")
def snk2(t: Tables) -> DataFrame:
    return enqueue.enqueue_batch(t.jobs, _requests(t), t.actor_config, NOW).filter("outcome = 'existing'").select("ordinal", "existing_id")


query("joi19_batch_rows_in_order", f"select ordinal, outcome from ({_BATCH}) order by ordinal")(lambda t: dml4(t).orderBy("ordinal").select("ordinal", "outcome"))


@query("dml5_bulk_load", f"select count(*) as loaded from ({_REQUESTS})")
def dml5(t: Tables) -> DataFrame:
    rows = enqueue.job_rows(enqueue.bulk_load(t.jobs, _requests(t).withColumn("idempotency_key", F.concat(F.lit("bulk"), F.col("ordinal").cast("string")))), t.actor_config, NOW)
    path = shared_path(t, "bulk")
    rows.write.parquet(path)
    return t.spark.read.schema(rows.schema).parquet(path).agg(F.count("*").alias("loaded"))


_SURROGATE = "substr(lpad(lower(to_hex(epoch_ms(NOW))), 12, '0'), 1, 8) || '-' || substr(lpad(lower(to_hex(epoch_ms(NOW))), 12, '0'), 9) || '-7000-8' || substr(lpad(lower(to_hex(ordinal)), 16, '0'), 2, 3) || '-' || substr(lpad(lower(to_hex(ordinal)), 16, '0'), 5)"
_ROWS = f"""select {_SURROGATE} as id, ordinal, r.actor, coalesce(c.queue, 'default') as queue, identity_key, idempotency_key, cast(null as varchar) as fairness_key, 0 as priority, case when coalesce(scheduled_at, NOW) > NOW then 'scheduled' else 'pending' end as status, 0 as attempt,
  coalesce(c.max_attempts, 3) as max_attempts, 'transient' as retry_kind, NOW as created_at, coalesce(scheduled_at, NOW) as scheduled_at, cast(null as timestamp) as started_at, cast(null as timestamp) as finished_at, cast(null as timestamp) as schedule_to_close, cast(null as timestamp) as lock_expires_at,
  '{{}}' as payload, metadata, cast(null as bigint) as locked_by_worker, 0 as cancel_phase, cast(null as varchar) as result from ({_REQUESTS}) r left join actor_config c on r.actor = c.actor"""
query("snk3_bulk_rows", _ROWS)(lambda t: _written(t, enqueue.job_rows(_requests(t), t.actor_config, NOW)))


def _written(t: Tables, rows: DataFrame) -> DataFrame:
    path = shared_path(t, "sink")
    rows.write.parquet(path)
    return t.spark.read.schema(rows.schema).parquet(path)


# Transitions

_AGAIN = "attempt < max_attempts and retry_kind <> 'non_retryable'"
_EXPIRED = "status = 'running' and lock_expires_at < NOW and (cancel_phase = 0 or lock_expires_at < NOW - interval '100' second)"


def _moved(name: str, sql: str, make, *cols) -> None:
    @query(name, sql)
    def run(t: Tables, make=make, cols=cols) -> DataFrame:
        return make(t).rows.select("id", *cols)


_moved("dml6_mark_succeeded", "select j.id, 'succeeded' as status, NOW + c.result_ttl * interval '1' second as result_expires_at from jobs j left join actor_config c on j.actor = c.actor where status = 'running'", lambda t: transitions.succeed(t.jobs, t.actor_config, NOW), "status", "result_expires_at")
_moved("dml7_mark_failed", "select id, 'failed' as status, 'Boom' as error_class from jobs where status = 'running' and locked_by_worker = 5", lambda t: transitions.fail(t.jobs, NOW, 5, "Boom"), "status", "error_class")
_moved("dml8_mark_retry", "select id, 'scheduled' as status, NOW + interval '30' second as scheduled_at from jobs where status = 'running'", lambda t: transitions.retry(t.jobs, NOW, 30), "status", "scheduled_at")
_moved("dml9_mark_cancelled", "select id, 'cancelled' as status, NOW as finished_at from jobs where status = 'running' and locked_by_worker = 8", lambda t: transitions.cancel(t.jobs, NOW, 8), "status", "finished_at")
_moved("dml10_escalate", "select id, 2 as cancel_phase from jobs where status = 'running' and cancel_phase = 1", lambda t: transitions.escalate(t.jobs, NOW), "cancel_phase")
_moved("dml11_mark_abandoned", "select id, 'abandoned' as status from jobs where status = 'running' and cancel_phase = 2", lambda t: transitions.abandon(t.jobs, NOW), "status")
_TIMELY = "(schedule_to_close is null or NOW + interval '3600' second <= schedule_to_close)"
_moved("dml12_mark_snoozed", f"select id, case when {_TIMELY} then 'scheduled' else 'failed' end as status, case when {_TIMELY} then max_attempts + 1 else max_attempts end as max_attempts, case when {_TIMELY} then null else 'DeadlineExceeded' end as error_class from jobs where status = 'running'", lambda t: transitions.snooze(t.jobs, NOW, 3600), "status", "max_attempts", "error_class")
_LEFT = "(retry_kind = 'indefinite' or attempt < max_attempts)"
_moved("dml13_retry_after", f"select id, case when {_TIMELY} and {_LEFT} then 'snoozed' when {_TIMELY} and retry_kind = 'transient' then 'max_attempts_failed' when not {_TIMELY} then 'deadline_failed' else 'noop' end as branch, case when {_TIMELY} and {_LEFT} then 'scheduled' when {_TIMELY} and retry_kind = 'non_retryable' then 'running' else 'failed' end as status from jobs where status = 'running'", lambda t: transitions.retry_after(t.jobs, NOW, 3600), "branch", "status")
_moved("dml14_retry_after_free", f"select id, case when {_TIMELY} then 'scheduled' else 'failed' end as status, case when {_TIMELY} then max_attempts + 1 else max_attempts end as max_attempts from jobs where status = 'running'", lambda t: transitions.retry_after(t.jobs, NOW, 3600, consume=False), "status", "max_attempts")
query("set4_outcome_branches", f"select case when {_TIMELY} then 'snoozed' else 'deadline_failed' end as branch, count(*) as n from jobs where status = 'running' group by 1")(lambda t: transitions.snooze(t.jobs, NOW, 3600).rows.groupBy("branch").agg(F.count("*").alias("n")))


#: Ids that somebody asks for.
_ASKED = "select p_partkey from part where p_size > 40"


def _ids(t: Tables) -> DataFrame:
    return t.sql(_ASKED).select(F.col("p_partkey").alias("id"))


_moved("dml15_request_cancel", "select id, case when status in ('pending','scheduled') then 'cancelled' else status end as status, case when status = 'running' and cancel_phase = 0 then 1 else cancel_phase end as cancel_phase, status in ('pending','scheduled') or (status = 'running' and cancel_phase = 0) as initiated from jobs where id in (" + _ASKED + ")", lambda t: transitions.request_cancel(t.jobs, _ids(t), NOW), "status", "cancel_phase", "initiated")
_moved("dml16_retry_job", "select id, 'pending' as status, 0 as attempt from jobs where id in (" + _ASKED + ") and status in ('failed','crashed','cancelled')", lambda t: transitions.retry_by_hand(t.jobs, _ids(t), NOW), "status", "attempt")
_moved("dml17_reclaim", f"select id, case when {_AGAIN} then 'pending' else 'crashed' end as status, case when {_AGAIN} then NOW + interval '5' second else scheduled_at end as scheduled_at from jobs where {_EXPIRED}", lambda t: transitions.reclaim(t.jobs, NOW), "status", "scheduled_at")
_moved("dml18_deadlines", "select id, 'failed' as status, 'DeadlineExceeded' as error_class from jobs where status in ('pending','scheduled') and schedule_to_close < NOW", lambda t: transitions.expire_deadlines(t.jobs, NOW), "status", "error_class")
_moved("dml19_promote", "select id, 'pending' as status from jobs where status = 'scheduled' and scheduled_at <= NOW", lambda t: transitions.promote(t.jobs, NOW), "status")
query("dml20_leaked_slots", "select bucket_name, slot_index, cast(null as bigint) as job_id from reservation_slots where lease_expires_at < NOW and job_id is not null")(lambda t: transitions.release_slots(t.reservation_slots, NOW).select("bucket_name", "slot_index", "job_id"))
query("dml21_result_ttl", "select id from jobs where status = 'succeeded' and finished_at + interval '864000' second < NOW")(lambda t: transitions.expire_results(t.jobs, NOW, 864000).select("id"))
query("dml22_heartbeat", "select id, NOW + interval '60' second as lock_expires_at from jobs where status = 'running' and locked_by_worker = 7")(lambda t: transitions.heartbeat(t.jobs, t.workers, 7, NOW, 60)[1].select("id", "lock_expires_at"))
query("dml22_heartbeat_worker", "select id, NOW as last_seen_at from workers where id = 7")(lambda t: transitions.heartbeat(t.jobs, t.workers, 7, NOW, 60)[0].select("id", "last_seen_at"))
_moved("dml23_isolate", f"select id, case when {_AGAIN} then 'pending' else 'crashed' end as status, 'HeartbeatLost' as error_class from jobs where status = 'running' and locked_by_worker = 7", lambda t: transitions.isolate(t.jobs, NOW, 7), "status", "error_class")
query("dml24_stale_workers", "select id from workers where last_seen_at < NOW - interval '60' second")(lambda t: lifecycle.stale_workers(t.workers, NOW).select("id"))
_moved("dml33_drain", "select id, 'pending' as status from jobs where status = 'running' and locked_by_worker % 7 = 0 and id % 3 = 0", lambda t: transitions.drain(t.jobs.withColumn("started_at", F.when(F.col("id") % 3 != 0, F.col("started_at"))).withColumn("locked_by_worker", F.col("locked_by_worker") % 7), NOW, 0), "status")
_moved("dml32_unknown_actor", "select id, 'scheduled' as status from jobs where status = 'running' and actor = 'error' and (schedule_to_close is null or NOW + interval '10' second <= schedule_to_close) union all select id, 'failed' from jobs where status = 'running' and actor = 'error' and NOW + interval '10' second > schedule_to_close", lambda t: transitions.snooze(t.jobs.filter("actor = 'error'"), NOW, 10), "status")
query("snk4_reclaim_attempts", f"select id as job_id, attempt, 'crashed' as outcome, 'WorkerCrashed' as error_class from jobs where {_EXPIRED}")(lambda t: transitions.reclaim(t.jobs, NOW).attempts.select("job_id", "attempt", "outcome", "error_class"))
query("snk5_reclaim_events", f"""select id as job_id, '{{"from":"running","to":"' || case when {_AGAIN} then 'pending' else 'crashed' end || '","reason":"lock_expired"}}' as detail from jobs where {_EXPIRED}""")(lambda t: transitions.reclaim(t.jobs, NOW).events.select("job_id", "detail"))

query("ext_illegal_transitions", "select count(*) as n from job_events where false")(lambda t: transitions.illegal(t.job_events).agg(F.count("*").alias("n")))
query("cn1_cancel_phases", "select id, case when NOW - created_at >= interval '864000' second then 'abandoned' when NOW - created_at >= interval '432000' second then 'phase2' else 'phase1' end as phase from jobs where status = 'running' and cancel_phase > 0")(lambda t: t.jobs.filter("status = 'running' and cancel_phase > 0").select("id", transitions.cancel_phase(F.col("created_at"), NOW, 432000, 432000).alias("phase")))


def _backoff(kind: str) -> Column:
    return C.backoff(F.col("attempt"), kind, 2.0, 6.0, 5.0)


query("rt1_backoff", "select id, least(least(2.0 * pow(2, attempt - 1), 6.0), 5.0) as exponential, least(least(2.0 * attempt, 6.0), 5.0) as linear, 2.0 as fixed from jobs where attempt > 0")(lambda t: t.jobs.filter("attempt > 0").select("id", _backoff("exponential").alias("exponential"), _backoff("linear").alias("linear"), _backoff("fixed").alias("fixed")))
_DELAY = "(least(30.0 * pow(2, attempt - 1), 3600.0))"
_DECIDE = f"case when id % 13 = 0 then 'fail:NonRetryable' when id % 17 = 0 then 'fail:PayloadError' when retry_kind = 'non_retryable' then 'fail:NonRetryable' when retry_kind = 'transient' and attempt >= max_attempts then 'fail:MaxAttempts' when schedule_to_close is not null and NOW + {_DELAY} * interval '1' second >= schedule_to_close then 'fail:DeadlineExceeded' else 'retry' end"


def _failures(t: Tables) -> DataFrame:
    return t.jobs.filter("status in ('failed', 'crashed')").withColumn("non_retryable_type", F.col("id") % 13 == 0).withColumn("payload_error", F.col("id") % 17 == 0)


query("rt2_classified", f"select id, {_DECIDE} as decision from jobs where status in ('failed', 'crashed')")(lambda t: transitions.classified(_failures(t), NOW, C.backoff(F.col("attempt"), "exponential", 30.0, 3600.0, 3600.0)).select("id", "decision"))


def _classifier(error: str, attempt: int):
    if error == "Timeout":
        return "indefinite", 99.0
    if error == "Bad":
        return "nonsense", 1.0
    raise RuntimeError(error)


@query("rt3_overridden", "select id, case when id % 3 = 0 then 'indefinite' else retry_kind end as kind, case when id % 3 = 0 then 60.0 end as override_delay from jobs where status = 'failed'")
def rt3(t: Tables) -> DataFrame:
    rows = t.jobs.filter("status = 'failed'").withColumn("error_class", F.when(F.col("id") % 3 == 0, "Timeout").when(F.col("id") % 3 == 1, "Bad").otherwise("Other"))
    return actors.overridden(rows, _classifier, 60.0).select("id", "kind", "override_delay")


# Lifecycle

_KEEP = {"succeeded": 5, "failed": 12, "cancelled": 5, "abandoned": 12, "crashed": 12}
_DAYS = "case status when 'succeeded' then 5 when 'cancelled' then 5 else 12 end"
_PRUNE = f"select j.* from jobs j left join (values ('click', 3), ('view', 90)) as o(actor, d) on j.actor = o.actor where status in ('succeeded','failed','cancelled','crashed','abandoned') and finished_at < NOW - least({_DAYS}, coalesce(o.d, 999)) * interval '1' day"


def _overrides(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([("click", '{"retention_days": "3"}'), ("view", '{"retention_days": "90"}'), ("purchase", '{"retention_days": "x"}')], "actor string, metadata string")


query("dml25_prune_archive", f"select id, status, NOW as archived_at, NOW + interval '365' day as expire_at from ({_PRUNE})")(lambda t: lifecycle.archive(t.jobs, t.job_attempts, NOW, _KEEP, _overrides(t))[1].select("id", "status", "archived_at", "expire_at"))
query("dml25_kept_rows", f"select id from jobs where id not in (select id from ({_PRUNE}))")(lambda t: lifecycle.archive(t.jobs, t.job_attempts, NOW, _KEEP, _overrides(t))[0].select("id"))
query("dml25_moved_attempts", f"select job_id, attempt from job_attempts where job_id in (select id from ({_PRUNE}))")(lambda t: lifecycle.archive(t.jobs, t.job_attempts, NOW, _KEEP, _overrides(t))[2].select("job_id", "attempt"))
query("snk6_archive_insert", f"select status, count(*) as n from ({_PRUNE}) group by status")(lambda t: _written(t, lifecycle.archive(t.jobs, t.job_attempts, NOW, _KEEP, _overrides(t))[1].select("id", "status")).groupBy("status").agg(F.count("*").alias("n")))


def _archived(t: Tables) -> DataFrame:
    return t.jobs_archive.withColumn("expire_at", F.col("finished_at") + F.make_dt_interval(days=F.lit(8600)))


query("dml26_expire_archive", "select id from jobs_archive where finished_at + interval '8600' day >= NOW")(lambda t: lifecycle.expire(_archived(t), t.job_attempts_archive, NOW)[0].select("id"))
query("dml26_kept_attempts", "select job_id, attempt from job_attempts_archive where job_id in (select id from jobs_archive where finished_at + interval '8600' day >= NOW)")(lambda t: lifecycle.expire(_archived(t), t.job_attempts_archive, NOW)[1].select("job_id", "attempt"))
query("dml27_ensure_slots", "select 2 as bucket_name, cast(i as int) as slot_index from (select unnest(range(8)) as i) where i not in (select slot_index from reservation_slots where bucket_name = 2)")(lambda t: lifecycle.ensure_slots(t.reservation_slots, 2, 8).select("bucket_name", "slot_index"))
query("dml27_free_slots", "select bucket_name, min(slot_index) as slot_index from reservation_slots where job_id is null or lease_expires_at < NOW group by bucket_name")(lambda t: lifecycle.free_slots(t.reservation_slots, NOW))
_WANTS = "select c_nationkey % 5 as bucket_name, c_custkey as ordinal, c_custkey + 1000 as job_id, c_custkey % 9 as worker_id from customer where c_custkey % 5 <> 3"
_GRANTS = f"""with w as (select *, row_number() over (partition by bucket_name order by ordinal) as turn from ({_WANTS})),
  f as (select bucket_name, slot_index, row_number() over (partition by bucket_name order by slot_index) as turn from reservation_slots where job_id is null or lease_expires_at < NOW) """


def _acquired(t: Tables):
    return lifecycle.acquire_slots(t.reservation_slots, t.sql(_WANTS), NOW, 90)


query("dml27_acquire_slot", _GRANTS + "select f.bucket_name, f.slot_index, w.job_id, w.worker_id as held_by_worker_id, NOW + interval '90' second as lease_expires_at from w join f on w.bucket_name = f.bucket_name and w.turn = f.turn")(lambda t: _acquired(t)[0].drop("acquired_at"))
query("dml27_acquire_outcomes", _GRANTS + "select w.bucket_name, w.ordinal, f.slot_index from w left join f on w.bucket_name = f.bucket_name and w.turn = f.turn")(lambda t: _acquired(t)[1])
_GIVES = "select n_regionkey as bucket_name, 1 as slot_index, n_nationkey % 4 as worker_id from nation"
query("dml27_release_slot", f"select bucket_name, slot_index, cast(null as bigint) as job_id, cast(null as bigint) as held_by_worker_id from reservation_slots s where exists (select 1 from ({_GIVES}) g where g.bucket_name = s.bucket_name and g.slot_index = s.slot_index and g.worker_id = s.held_by_worker_id)")(lambda t: lifecycle.release_held(t.reservation_slots, t.sql(_GIVES)).select("bucket_name", "slot_index", F.col("job_id").cast("long").alias("job_id"), "held_by_worker_id"))
query("dml27_renew_slot", "select bucket_name, slot_index, NOW + interval '45' second as lease_expires_at from reservation_slots where held_by_worker_id = 2 and job_id in (select id from jobs where status in ('pending', 'scheduled', 'running', 'succeeded'))")(lambda t: lifecycle.renew_slots(t.reservation_slots, t.jobs.withColumn("status", F.when(F.col("status").isin("pending", "scheduled", "running", "succeeded"), "running")), 2, NOW, 45).select("bucket_name", "slot_index", "lease_expires_at"))
_NEWCONF = "select 'click' as actor, 60 as max_concurrent, 20000 as max_pending union all select 'error', 5, null"


def _new_config(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([("click", 60, 20000), ("error", 5, None)], "actor string, max_concurrent int, max_pending int")


def _old_config(t: Tables) -> DataFrame:
    return t.actor_config.select("actor", "max_concurrent", "max_pending")


query("snk7_upsert_config", f"select actor, max_concurrent, max_pending from actor_config where actor not in (select actor from ({_NEWCONF})) union all {_NEWCONF}")(lambda t: lifecycle.upsert(_old_config(t), _new_config(t), ["actor"]))
query("snk8_leader_singleton", "select cast(11 as int) as worker_id, NOW as elected_at")(lambda t: lifecycle.upsert(t.maintenance_leader.withColumn("one", F.lit(1)).select("one", "worker_id", "elected_at"), t.spark.range(1).select(F.lit(1).alias("one"), F.lit(11).alias("worker_id"), C.moment(NOW).alias("elected_at")), ["one"]).select("worker_id", "elected_at"))
_STORED, _COMES = "select c_custkey as b, case when c_custkey % 2 = 0 then 'token' else 'window' end as kind, 'old' as state from customer", "select c_custkey as b, 'token' as kind, 'new' as state from customer where c_custkey % 3 <> 1"
query("snk9_guarded_upsert", "select c_custkey as b, case when c_custkey % 2 = 0 and c_custkey % 3 <> 1 then 'new' else 'old' end as state from customer")(lambda t: lifecycle.upsert_if_same(t.sql(_STORED), t.sql(_COMES), "b", "kind").select("b", "state"))
query("snk10_insert_absent", f"select actor, max_concurrent from actor_config union all select actor, max_concurrent from ({_NEWCONF}) where actor = 'error'")(lambda t: lifecycle.insert_absent(_old_config(t), _new_config(t), ["actor"]).select("actor", "max_concurrent"))
query("snk11_deregister", "select id from workers where id not in (select n_nationkey from nation)")(lambda t: lifecycle.deregister_workers(t.workers, t.base("nation").select(F.col("n_nationkey").alias("id"))).select("id"))
_COMING = "select c_custkey + 3 as id, c_name as hostname, 'q9' as queue_list from customer"
query("snk11_register", f"select id, hostname, queue_list, last_seen_at from workers where id not in (select id from ({_COMING})) union all select *, NOW from ({_COMING})")(lambda t: lifecycle.register_workers(t.workers.select("id", "hostname", "queue_list", "last_seen_at"), t.sql(_COMING), NOW))
query("snk11b_register_cron", "select actor, name from cron_schedules union all select 'view', 'new'")(lambda t: lifecycle.insert_absent(t.cron_schedules.select("actor", "name"), t.spark.createDataFrame([("view", "new"), ("click", "s5")], "actor string, name string"), ["actor", "name"]))
query("joi21_config_drift", "select 'click' as actor, 'max_concurrent' as field, '50' as stored, '60' as registered")(lambda t: lifecycle.drift(_old_config(t), _new_config(t), ["max_concurrent", "max_pending"]))
query("dml31_config_sync", f"select actor, max_concurrent from actor_config where actor not in (select actor from ({_NEWCONF})) union all select actor, max_concurrent from ({_NEWCONF})")(lambda t: lifecycle.upsert(_old_config(t), _new_config(t), ["actor"]).select("actor", "max_concurrent"))

# Sinks that tell others

query("snk12_notifications", """select 'wake' as channel, queue as payload from jobs where status = 'pending' group by queue""")(lambda t: streams.published(t.jobs.filter("status = 'pending'").select("queue").distinct().select(F.lit("wake").alias("channel"), F.col("queue").alias("payload")), shared_path(t, "published")))
query("snk13_json_rows", """select '{"status":"' || status || '","n":' || count(*) || '}' as line from jobs group by status""")(lambda t: t.jobs.groupBy("status").agg(F.count("*").alias("n")).select(F.to_json(F.struct("status", "n")).alias("line")))
query("snk14_counters", "select 'consumed' as name, actor, status as outcome, count(*) as value from jobs where finished_at is not null group by actor, status")(lambda t: t.jobs.filter("finished_at is not null").groupBy("actor", F.col("status").alias("outcome")).agg(F.count("*").alias("value")).withColumn("name", F.lit("consumed")))

# Rate limits


def _some(t: Tables) -> DataFrame:
    return t.requests


_LOG = """with recursive r as (select bucket, request_id, epoch_us(ts) as us, row_number() over (partition by bucket order by ts, request_id) as n from requests),
  s as (select bucket, n, request_id, us, true as allowed, [us] as log from r where n = 1
    union all select r.bucket, r.n, r.request_id, r.us, len(list_filter(s.log, lambda x: x > r.us - 36000000000)) < 5, case when len(list_filter(s.log, lambda x: x > r.us - 36000000000)) < 5 then list_append(list_filter(s.log, lambda x: x > r.us - 36000000000), r.us) else list_filter(s.log, lambda x: x > r.us - 36000000000) end
    from s join r on r.bucket = s.bucket and r.n = s.n + 1) select bucket, request_id, allowed from s"""
_TB = """with recursive r as (select bucket, request_id, epoch_us(ts) as us, row_number() over (partition by bucket order by ts, request_id) as n from requests),
  s as (select bucket, n, request_id, us, true as allowed, cast(9.0 as double) as level from r where n = 1
    union all select r.bucket, r.n, r.request_id, r.us, least(10.0, s.level + (r.us - s.us) / 1000000.0 * 0.0005) >= 1.0, cast(case when least(10.0, s.level + (r.us - s.us) / 1000000.0 * 0.0005) >= 1.0 then least(10.0, s.level + (r.us - s.us) / 1000000.0 * 0.0005) - 1.0 else least(10.0, s.level + (r.us - s.us) / 1000000.0 * 0.0005) end as double)
    from s join r on r.bucket = s.bucket and r.n = s.n + 1) select bucket, request_id, allowed from s"""
_GCRA = """with recursive r as (select bucket, request_id, epoch_us(ts) as us, row_number() over (partition by bucket order by ts, request_id) as n from requests),
  s as (select bucket, n, request_id, true as allowed, us + 3600000000 as tat from r where n = 1
    union all select r.bucket, r.n, r.request_id, r.us >= greatest(r.us, s.tat) + 3600000000 - 18000000000, case when r.us >= greatest(r.us, s.tat) + 3600000000 - 18000000000 then greatest(r.us, s.tat) + 3600000000 else s.tat end
    from s join r on r.bucket = s.bucket and r.n = s.n + 1) select bucket, request_id, allowed from s"""
query("rl1_token_bucket", _TB)(lambda t: ratelimit.fixed_tokens(_some(t), 10.0, 0.0005).select("bucket", "request_id", "allowed"))
query("rl4_sliding_log", _LOG)(lambda t: ratelimit.sliding_log(_some(t), 5, 36000.0).select("bucket", "request_id", "allowed"))
query("rl5_gcra", _GCRA)(lambda t: ratelimit.gcra_limit(_some(t), 5, 18000.0).select("bucket", "request_id", "allowed"))


@query("rl1_token_bucket_stream", _TB)
def rl1_stream(t: Tables) -> DataFrame:
    path = shared_path(t, "requests")
    t.requests.write.parquet(path)
    source = streams.file_source(t.spark, path, "bucket string, ts timestamp_ntz, request_id long")
    return streams.drained(streams.limited(source, lambda s, at: ratelimit.token_bucket(s, at, 10.0, 0.0005)), shared_path(t, "limited")).select("bucket", "request_id", "allowed")


query("rl8_keyed_reservations", """with l as (select json_extract_string(props, '$.k') as key, max(ts) as lu from events group by 1), n as (select max(lu) as newest from l),
  r as (select key, lu, lu < newest - interval '36000' second as evicted from l, n), k as (select key from r where not evicted order by lu desc, key limit 20)
  select key, concat('user:', key) as name, key in (select key from k) as ok, evicted from r""")(lambda t: ratelimit.keyed_reservations(t.base("events").select(F.get_json_object("props", "$.k").alias("key"), "ts"), "user", 20, 36000.0))

# Cron

query("cr5_once_a_day", "select id, cast(last_seen_at as date) < cast(NOW as date) as again from workers")(lambda t: t.workers.select("id", (F.to_date("last_seen_at") < F.to_date(C.moment(NOW))).alias("again")))

# Streams


def _progress(t: Tables) -> DataFrame:
    return t.progress.select("job_id", F.col("seq").cast("int").alias("seq"), "status", "detail", "terminal")


def _progress_files(t: Tables) -> str:
    path = shared_path(t, "progress")
    _progress(t).write.parquet(path)
    return path


#: Rows that come after later ones of their job.
_LATE_ROW = "job_id % 2 = 1 and seq = 1"


def _in_two_parts(t: Tables, operator, label: str) -> DataFrame:
    """The operator over most rows and, in a second run on the same state, the late ones with all others repeated."""
    path, out, rows = shared_path(t, label), shared_path(t, f"{label}-out"), _progress(t)
    rows.filter(f"not ({_LATE_ROW})").write.mode("append").parquet(path)
    stream = operator(streams.file_source(t.spark, path, streams.PROGRESS))
    streams.drained(stream, out)
    rows.filter(_LATE_ROW).unionByName(rows.filter(f"not ({_LATE_ROW}) and not terminal")).write.mode("append").parquet(path)
    return streams.drained(stream, out)


_KEPT = f"select job_id, cast(seq as int) as seq, status from progress where terminal or not ({_LATE_ROW})"


@query("st1_state_changes", _KEPT)
def st1(t: Tables) -> DataFrame:
    return _in_two_parts(t, streams.state_changes, "st1").select("job_id", "seq", "status")


@query("st2_monotone_progress", _KEPT)
def st2(t: Tables) -> DataFrame:
    return _in_two_parts(t, streams.monotone, "st2").select("job_id", "seq", "status")


_SEEN = "select conv_id as job_id, cast(conv_id % 3 as int) as last_seq from conversations group by conv_id"


@query("st3_resumed_progress", f"select job_id, seq from ({_KEPT}) where seq > greatest(job_id % 3, 0) or (job_id, seq) in (select job_id, max(seq) from progress group by job_id)")
def st3(t: Tables) -> DataFrame:
    return _in_two_parts(t, lambda stream: streams.monotone(stream, t.sql(_SEEN)), "st3").select("job_id", "seq")


@query("st3_snapshots", f"select p.job_id, cast(p.seq as int) as seq, p.status from progress p join ({_SEEN}) s on p.job_id = s.job_id where p.terminal and p.seq > s.last_seq")
def st3_snapshots(t: Tables) -> DataFrame:
    return streams.snapshots(_progress(t), t.sql(_SEEN)).select("job_id", "seq", "status")


@query("st4_coalesced", "select job_id, cast(max(seq) as int) as seq, arg_max(status, seq) as status, count(*) as updates from progress group by job_id")
def st4(t: Tables) -> DataFrame:
    path = shared_path(t, "st4")
    return streams.sampled(streams.file_source(t.spark, _progress_files(t), streams.PROGRESS), streams.coalesced, path).select("job_id", "seq", "status", "updates")


@query("st5_sampled_depth", "select status, count(*) as n from progress group by status")
def st5(t: Tables) -> DataFrame:
    return streams.sampled(streams.file_source(t.spark, _progress_files(t), streams.PROGRESS), lambda b: b.groupBy("status").agg(F.count("*").alias("n")), shared_path(t, "st5")).select("status", "n")


@query("st6_sweep_tick", "select status, count(*) as n from (select case when status in ('pending','scheduled') and schedule_to_close < NOW then 'failed' when status = 'scheduled' and scheduled_at <= NOW then 'pending' else status end as status from jobs) group by status")
def st6(t: Tables) -> DataFrame:
    state = transitions.expire_deadlines(t.jobs, NOW).apply(t.jobs)
    return transitions.promote(state, NOW).apply(state).groupBy("status").agg(F.count("*").alias("n"))


query("st7_fan_out", "select id from jobs where locked_by_worker is null or locked_by_worker = 7")(lambda t: streams.fan_out(t.jobs.withColumnRenamed("locked_by_worker", "worker_id"), 7).select("id"))
query("st8_global_channel", "select channel, count(*) as n from (select concat('job:', job_id) as channel from progress union all select 'all' from progress) group by channel")(lambda t: streams.with_global_copy(t.progress).groupBy("channel").agg(F.count("*").alias("n")))
query("st11_event_windows", "select time_bucket(interval '1' day, occurred_at) as start, to_state, count(*) as n from job_events group by 1, 2")(lambda t: streams.event_windows(t.job_events, "occurred_at", "1 day"))
query("st11_sessions", """with e as (select actor, id, created_at as c, case when created_at - lag(created_at) over (partition by actor order by created_at, id) < interval '30' minute then 0 else 1 end as fresh from jobs),
  s as (select *, sum(fresh) over (partition by actor order by c, id rows between unbounded preceding and current row) as g from e) select min(c) as start, max(c) + interval '30' minute as "end", actor, count(*) as n from s group by actor, g""")(lambda t: streams.event_sessions(t.jobs, "created_at", "30 minutes"))
query("st12_start_to_close", "select id, actor from jobs where status = 'running' and started_at + interval '86400' second < NOW")(lambda t: streams.timed_out(t.jobs, NOW, 86400))


@query("st10_late_and_repeated", "select job_id, cast(seq as int) as seq from progress")
def st10(t: Tables) -> DataFrame:
    path = shared_path(t, "late")
    rows = _progress(t).filter("not terminal")
    rows.unionByName(rows).unionByName(_progress(t).filter("terminal")).write.parquet(path)
    return streams.drained(streams.monotone(streams.file_source(t.spark, path, streams.PROGRESS)), shared_path(t, "st10")).select("job_id", "seq")


@query("src15_listen", "select id, queue from jobs where status = 'pending'")
def src15(t: Tables) -> DataFrame:
    path = shared_path(t, "wake")
    t.jobs.filter("status = 'pending'").select("id", "queue").write.parquet(path)
    return streams.drained(streams.file_source(t.spark, path, "id long, queue string", 16), shared_path(t, "wake-out"))


query("src16_published", "select job_id, status from progress where terminal")(lambda t: streams.drained(streams.file_source(t.spark, _progress_files(t), streams.PROGRESS).filter("terminal"), shared_path(t, "published")).select("job_id", "status"))
query("src21_reconnect", "select job_id, count(*) as n from progress group by job_id")(lambda t: _restarted(t).groupBy("job_id").agg(F.count("*").alias("n")))


def _restarted(t: Tables) -> DataFrame:
    """The same checkpoint twice: the second run adds nothing."""
    stream, path = streams.file_source(t.spark, _progress_files(t), streams.PROGRESS), shared_path(t, "again")
    streams.drained(stream, path)
    return streams.drained(stream, path)


# Actors


def _click(payload: dict):
    k = int(payload["k"])
    if k % 5 == 0:
        raise actors.Snooze(5)
    if k % 5 == 1:
        raise actors.RetryAfter(7)
    if k % 5 == 2:
        raise actors.Rejected("no")
    if k % 5 == 3:
        raise ValueError("odd")
    return {"k": k}


_ACTORS = {"click": actors.Actor("click", _click, "q0", max_concurrent=50), "view": actors.Actor("view", lambda p: p["k"], "q1", singleton=True)}
_K = "cast(json_extract_string(payload, '$.k') as int)"
_ROUTES = f"case when actor = 'view' then 'succeeded' when actor <> 'click' then 'actor_not_found' when {_K} % 5 = 0 then 'snoozed' when {_K} % 5 = 1 then 'retry_after' when {_K} % 5 = 2 then 'failed' when {_K} % 5 = 3 then 'retry' else 'succeeded' end"
query("udf1_performed", f"select id, {_ROUTES} as outcome from jobs where status = 'running'")(lambda t: actors.performed(t.jobs.filter("status = 'running'"), _ACTORS).select("id", "outcome"))
_OPTIONS = "actor string, max_concurrent int, max_pending int, queue string, max_attempts int, retry_kind string, result_ttl double, metadata string"
query("udf2_options", """select actor, count(*) as jobs, case actor when 'click' then 50 end as max_concurrent, case actor when 'click' then 'q0' when 'view' then 'q1' end as queue, case actor when 'click' then '{}' when 'view' then '{"singleton": true}' end as metadata from jobs group by actor""")(lambda t: t.jobs.groupBy("actor").agg(F.count("*").alias("jobs")).join(F.broadcast(t.spark.createDataFrame(actors.config_rows(_ACTORS), _OPTIONS)), "actor", "left").select("actor", "jobs", "max_concurrent", "queue", "metadata"))
query("udf3_classifier", "select kind, count(*) as n from (select case when id % 3 = 0 then 'indefinite' else retry_kind end as kind from jobs where status = 'failed') group by kind")(lambda t: rt3(t).groupBy("kind").agg(F.count("*").alias("n")))


def _raises(i: int, o: str) -> None:
    raise KeyError(i)


query("udf4_hooks", "select id, case status when 'succeeded' then 'called' when 'failed' then 'KeyError' end as hook from jobs where finished_at is not null")(lambda t: actors.hooked(t.jobs.filter("finished_at is not null").select("id", F.col("status").alias("outcome")), {"succeeded": lambda i, o: None, "failed": _raises}).select("id", "hook"))
query("udf5_key_fn", f"select id, case when {_K} >= 10 then concat('k', {_K}) end as key from jobs")(lambda t: actors.keyed(t.jobs, lambda p: f"k{p['k']}" if p["k"] >= 10 else 1 / 0).select("id", "key"))
query("udf7_control_flow", f"select {_ROUTES} as outcome, count(*) as n from jobs where status = 'running' and actor = 'click' group by 1")(lambda t: actors.performed(t.jobs.filter("status = 'running' and actor = 'click'"), _ACTORS).groupBy("outcome").agg(F.count("*").alias("n")))
query("udf8_routing", f"select id, case when actor = 'click' and {_K} % 5 = 2 then 'Rejected' when actor = 'click' and {_K} % 5 = 3 then 'ValueError' end as error_class from jobs where status = 'running'")(lambda t: actors.performed(t.jobs.filter("status = 'running'"), _ACTORS).select("id", "error_class"))
query("udf9_children", "select id as parent_id, cast(i as int) as child, concat('c', i) as payload from (select id, unnest(range(id % 3)) as i from jobs where status = 'succeeded')")(lambda t: enqueue.children(t.jobs, t.jobs.filter("id % 3 > 0").select(F.col("id").alias("parent_id"), F.transform(F.sequence(F.lit(0), (F.col("id") % 3 - 1).cast("int")), lambda i: F.concat(F.lit("c"), i.cast("string"))).alias("payloads"))))
query("udf10_error_report", "select status as error_kind, count(*) as n, min(id) as first_id from jobs where status in ('failed','crashed') group by status")(lambda t: t.jobs.filter("status in ('failed','crashed')").groupBy(F.col("status").alias("error_kind")).agg(F.count("*").alias("n"), F.min("id").alias("first_id")))


@query("sim1_drained")
def sim1(t: Tables) -> DataFrame:
    jobs = t.jobs.filter("status = 'pending'").select("id", "queue", "priority", C.micros(F.col("scheduled_at")).alias("scheduled_us"), F.lit(60_000_000).cast("long").alias("run_us"))
    return actors.simulated(jobs, 2)
