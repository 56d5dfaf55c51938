"""Queries over what workers report: outcomes applied, progress flushed, several limits taken at once, sequences cut at rests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.functions import columns as C
from jobloom.operators import actors, composition, metrics, ratelimit
from jobloom.plans import counts, outcomes, transitions
from jobloom.plans.reads import META
from jobloom.plans.registry import query
from jobloom.sources import event_log, layout
from jobloom.sources.fixtures import NOW, Tables
from jobloom.sources.shared import new_folder
from jobloom.streaming import progress, streams, timers

# Outcomes


def _click(payload: dict):
    """A handler with every way to end."""
    k = int(payload["k"])
    if k % 9 == 0:
        raise actors.Snooze(3600)
    if k % 9 == 1:
        raise actors.RetryAfter(7)
    if k % 9 == 2:
        raise actors.Rejected("no")
    if k % 9 == 3:
        raise ValueError("odd")
    if k % 9 == 4:
        raise actors.SlotsBusy(3, "api")
    if k % 9 == 5:
        raise actors.RetryAfter(0, consume=False)
    if k % 9 == 6:
        return actors.Children({"k": k}, [("view", {"from": k}), ("click", {})])
    return {"k": k}


HANDLERS = {"click": actors.Actor("click", _click), "purchase": actors.Actor("purchase", _click), "view": actors.Actor("view", lambda p: p["k"])}
BACKOFF = ("exponential", 30.0, 3600.0, 3600.0)

# What each running job's handler ends with, the delay, and the branch that follows from the job's deadline and attempts.
_ENDED = """with m as (select j.*, case when actor not in ('click', 'purchase') then -1 else cast(json_extract_string(payload, '$.k') as int) % 9 end as k from jobs j where status = 'running'),
  e as (select *, case when actor = 'view' then 'succeeded' when k = -1 then 'actor_not_found' when k = 0 then 'snoozed' when k = 1 then 'retry_after' when k = 2 then 'failed' when k = 3 then 'retry' when k = 4 then 'reservation_denied' when k = 5 then 'retry_after_free' else 'succeeded' end as outcome,
    cast(case when actor = 'view' then 0 when k = -1 then 10 when k = 0 then 3600 when k = 1 then 7 when k = 3 then least(30.0 * pow(2, attempt - 1), 3600.0) when k = 4 then 3 else 0 end as int) as delay from m),
  f as (select *, schedule_to_close is null or NOW + delay * interval '1' second <= schedule_to_close as timely,
    retry_kind = 'non_retryable' or (retry_kind = 'transient' and attempt >= max_attempts) or (schedule_to_close is not null and NOW + delay * interval '1' second >= schedule_to_close) as dead from e),
  b as (select *, case when outcome in ('succeeded', 'failed') then outcome when outcome = 'retry' then case when dead then 'retries_failed' else 'retried' end
    when outcome = 'retry_after' then case when timely and (retry_kind = 'indefinite' or attempt < max_attempts) then 'snoozed' when timely and retry_kind = 'transient' then 'max_attempts_failed' when not timely then 'deadline_failed' else 'noop' end
    when timely then 'snoozed' else 'deadline_failed' end as branch from f) """


def _applied(t: Tables) -> outcomes.Applied:
    running = t.jobs.filter("status = 'running'")
    return outcomes.apply_outcomes(t.jobs, actors.performed(running, HANDLERS), NOW, actor_config=t.actor_config, retry=BACKOFF)


@query("udf8_applied", _ENDED + """select b.id, branch, case when branch = 'noop' then 'running' when branch in ('snoozed', 'retried') then case when delay > 0 then 'scheduled' else 'pending' end when branch = 'succeeded' then 'succeeded' else 'failed' end as status,
  case when branch in ('snoozed', 'retried') then NOW + delay * interval '1' second else scheduled_at end as scheduled_at, case when branch = 'snoozed' and outcome <> 'retry_after' then max_attempts + 1 else max_attempts end as max_attempts,
  case when branch = 'deadline_failed' then 'DeadlineExceeded' when branch = 'max_attempts_failed' then 'MaxAttemptsExceeded' when branch = 'failed' then 'Rejected' when branch in ('retried', 'retries_failed') then 'ValueError' end as error_class,
  case when branch = 'snoozed' and outcome = 'snoozed' then replace(replace(metadata, '": "', '":"'), '}', ',"snooze_count":1}') when branch = 'snoozed' and outcome = 'reservation_denied' then replace(replace(metadata, '": "', '":"'), '{', '{"awaiting":"reservation:api",') else metadata end as metadata,
  case when branch = 'succeeded' and b.actor = 'view' then json_extract_string(payload, '$.k') when branch = 'succeeded' then '{"k": ' || json_extract_string(payload, '$.k') || '}' end as result,
  case when branch = 'succeeded' then NOW + c.result_ttl * interval '1' second end as result_expires_at from b left join (select actor, result_ttl from actor_config) c on b.actor = c.actor""")
def udf8_applied(t: Tables) -> DataFrame:
    return _applied(t).rows.select("id", "branch", "status", "scheduled_at", "max_attempts", "error_class", "metadata", "result", "result_expires_at")


query("udf8_applied_attempts", _ENDED + "select id as job_id, attempt, case when branch = 'snoozed' then case when outcome = 'reservation_denied' then outcome else 'snoozed' end when branch = 'succeeded' then branch else 'failed' end as outcome from b where branch <> 'noop'")(lambda t: _applied(t).attempts.select("job_id", "attempt", "outcome"))
query("udf8_applied_events", _ENDED + """select id as job_id, '{"from":"running","to":"' || case when branch = 'retried' then 'scheduled' when branch = 'snoozed' then case when delay > 0 then 'scheduled' else 'pending' end when branch = 'succeeded' then branch else 'failed' end || '"}' as detail from b where branch <> 'noop'""")(lambda t: _applied(t).events.select("job_id", "detail"))
query("udf9_applied_children", _ENDED + """select id as parent_id, i as ordinal, case when i = 0 then 'view' else 'click' end as actor, case when i = 0 then '{"from": ' || json_extract_string(payload, '$.k') || '}' else '{}' end as payload from b, (values (cast(0 as int)), (1)) as v(i) where branch = 'succeeded' and k = 6""")(lambda t: _applied(t).children)
query("udf4_exhausted", _ENDED + """select id as job_id, case when branch = 'retries_failed' then case when retry_kind = 'non_retryable' then 'NonRetryable' when retry_kind = 'transient' and attempt >= max_attempts then 'MaxAttempts' else 'DeadlineExceeded' end
  when branch = 'deadline_failed' then 'DeadlineExceeded' when branch = 'max_attempts_failed' then 'MaxAttemptsExceeded' else 'Rejected' end as cause from b where branch in ('deadline_failed', 'max_attempts_failed', 'retries_failed', 'failed')""")(lambda t: _applied(t).exhausted.select("job_id", "cause"))


def _noted(t: Tables) -> DataFrame:
    return t.jobs.withColumn("metadata", F.expr(META.replace("varchar(9)", "string")))


_SOON = "(schedule_to_close is null or NOW + interval '5' second <= schedule_to_close)"
_PLAIN = """'{"batch_id":"b' || (id % 50) || '","n":1.5,"o":{"a":[1,null,true]},"on":true'"""
query("rt4_snooze_count", f"""select id, {_PLAIN} || ',"snooze_count":' || case when id % 4 = 1 then 4 when id % 4 = 2 then 8 else 1 end || '}}' as metadata from jobs where status = 'running'""")(lambda t: _noted(t).filter("status = 'running'").select("id", C.counted_up(F.col("metadata"), "snooze_count").alias("metadata")))


@query("rt4_snooze_twice", f"""select id, {_PLAIN} || ',"snooze_count":' || case when id % 4 = 1 then 5 when id % 4 = 2 then 9 else 2 end || '}}' as metadata, max_attempts + 2 as max_attempts from jobs where status = 'running' and {_SOON}""")
def rt4_twice(t: Tables) -> DataFrame:
    jobs = _noted(t).filter("status = 'running'")
    again = transitions.snooze(jobs, NOW, 5).apply(jobs).withColumn("status", F.when(F.col("status") == "scheduled", "running").otherwise(F.col("status")))
    return transitions.snooze(again, NOW, 5).rows.filter("branch = 'snoozed'").select("id", "metadata", "max_attempts")


query("rt5_denied", """select id, 'reservation_denied' as outcome, '{"awaiting":"reservation:api","batch_id":"' || json_extract_string(metadata, '$.batch_id') || '"}' as metadata from jobs where status = 'running' and """ + _SOON)(lambda t: _denied(t))


def _denied(t: Tables) -> DataFrame:
    found = transitions.deny(t.jobs, NOW, 5, "api")
    return found.rows.filter("branch = 'snoozed'").select("id", "metadata").join(found.attempts.select(F.col("job_id").alias("id"), "outcome"), "id")


# Progress

#: Rows of a source's table for each file that a stream of three batches takes at a time.
FILE_ROWS = 1_000_000

# Lines of an order are updates of the job with its number; every fifth comes from a worker that doesn't own the job.
_UPDATES = """select l.l_orderkey as job_id, case when l.l_linenumber % 5 = 4 then -1 else j.locked_by_worker end as worker_id, l.l_linenumber as turn, cast(l.l_linenumber as bigint) as delta,
  concat('{"l', cast(l.l_linenumber % 3 as varchar(9)), '": ', cast(cast(l.l_quantity as int) as varchar(9)), ', "last": "', cast(l.l_linenumber as varchar(9)), '"}') as state from lineitem l join jobs j on l.l_orderkey = j.id"""
_REPORTED = f"""with u as ({_UPDATES}), own as (select u.* from u join jobs j on u.job_id = j.id where j.status = 'running' and u.worker_id = j.locked_by_worker),
  k as (select job_id, turn, 'l' || (turn % 3) as key, json_extract(state, '$.l' || (turn % 3))::varchar as value from own union all select job_id, turn, 'last', '"' || turn || '"' from own),
  w as (select job_id, key, value from (select *, row_number() over (partition by job_id, key order by turn desc, value desc) as n from k) where n = 1),
  a as (select job_id, key, value from w union all select id, key, value from jobs, (values ('l0', '0.5'), ('z', 'true')) as v(key, value) where id % 2 = 0 and id in (select job_id from own) and not exists (select 1 from w where w.job_id = id and w.key = v.key)),
  s as (select job_id, '{{' || string_agg('"' || key || '":' || value, ',' order by key) || '}}' as progress_state from a group by job_id) """
_FLUSHED = _REPORTED + "select s.job_id as id, cast(s.job_id % 7 + (select sum(delta) from own where own.job_id = s.job_id) as int) as progress_seq, progress_state from s"


def _jobs_with_progress(t: Tables) -> DataFrame:
    return t.jobs.withColumn("progress_seq", (F.col("id") % 7).cast("int")).withColumn("progress_state", F.when(F.col("id") % 2 == 0, '{"z": true, "l0": 0.5}'))


query("dml30_flush_progress", _FLUSHED)(lambda t: transitions.flush_progress(_jobs_with_progress(t), t.sql(_UPDATES)))


@query("dml30_flush_stream", _FLUSHED)
def dml30_stream(t: Tables) -> DataFrame:
    """The same from a stream of files, of which the last batch comes twice and older batches have been compacted."""
    source, log = new_folder(t.spark, "updates"), progress.Ledger(t.spark, new_folder(t.spark, "ledger"))
    each = -(-t.base("lineitem").count() // FILE_ROWS) or 1
    t.sql(_UPDATES).repartition(3 * each, "job_id", "turn").write.parquet(source)
    stream = t.spark.readStream.schema(progress.REPORTS).option("maxFilesPerTrigger", each).parquet(source)
    log.follow(stream, new_folder(t.spark, "flush"))
    last = max(log.batches())
    log.compact()
    again = t.spark.createDataFrame([(1, 1, 1, 1, "{}")], progress.REPORTS)
    log.add(again, last)  # has been taken before: changes nothing
    return transitions.flush_parts(_jobs_with_progress(t), log.parts())


# Limits


def _offers(t: Tables) -> DataFrame:
    return t.requests.select(F.col("request_id").alias("job_id"), C.micros(F.col("ts")).alias("us"), F.array("bucket").alias("reservations"), F.array(F.lit("api")).alias("limits"), F.lit(40_000_000_000).alias("hold_us"))


_SHARED = """with recursive r as (select bucket, request_id, epoch_us(ts) as us, row_number() over (order by ts, request_id) as n from requests),
  s as (select cast(0 as bigint) as n, cast(null as bigint) as job_id, true as allowed, cast(null as varchar) as denied_by, cast([] as struct(b varchar, till bigint)[]) as held, cast(3.0 as double) as tokens, cast(null as bigint) as seen
    union all select n, request_id, free and full_enough, case when not free then bucket when not full_enough then 'api' end, case when free and full_enough then list_append(held, {'b': bucket, 'till': us + 40000000000}) else held end, case when free and full_enough then now_tokens - 1 when free then now_tokens else tokens end, case when free then us else seen end
    from (select *, len(list_filter(held, lambda x: x.b = bucket)) < 4 as free, now_tokens >= 1 as full_enough from
      (select r.n, r.bucket, r.request_id, r.us, list_filter(s.held, lambda x: x.till > r.us) as held, s.tokens, s.seen, case when s.seen is null then 3.0 else least(3.0, s.tokens + (r.us - s.seen) / 1000000.0 * 0.0001) end as now_tokens from s join r on r.n = s.n + 1)))
  select job_id, allowed, denied_by from s where n > 0"""


@query("rl7_all_or_nothing", _SHARED)
def rl7(t: Tables) -> DataFrame:
    """Five reservations share one limit, so all jobs are one sequence."""
    names = ["click", "view", "purchase", "signup", "error"]
    return composition.all_or_nothing(_offers(t), dict.fromkeys(names, 4), {"api": composition.Limit("tokens", 3.0, 0.0001)}).select("job_id", "allowed", "denied_by")


@query("rl7_many_groups")
def rl7_groups(t: Tables) -> DataFrame:
    """Two reservations and limits of all three kinds for each customer's orders; customers of one nation share a limit."""
    orders = t.base("orders").select(F.col("o_orderkey").alias("job_id"), "o_custkey", C.micros(F.col("o_orderdate").cast("timestamp_ntz")).alias("us"))
    met = orders.join(t.base("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    jobs = met.select("job_id", "us", F.array(name("seat", "o_custkey"), name("desk", "c_nationkey")).alias("reservations"), F.array(F.lit("day"), F.lit("week"), F.lit("pace")).alias("limits"), F.lit(86_400_000_000).alias("hold_us"))
    limits = {"day": composition.Limit("tokens", 40.0, 0.0005), "week": composition.Limit("window", 300, 604_800.0), "pace": composition.Limit("gcra", 50, 86_400.0)}
    return composition.all_or_nothing(jobs, {"seat": 1, "desk": 5}, limits, most_hold_us=86_400_000_000)


_TOKENS = "select bucket, request_id, epoch_us(ts) as us, row_number() over (partition by bucket order by ts, request_id) as n, count(*) over (partition by bucket) as c from requests"
_LAST = f"""with recursive r as ({_TOKENS}),
  s as (select bucket, n, c, us, cast(9.0 as double) as level from r where n = 1
    union all select r.bucket, r.n, r.c, r.us, cast(case when least(10.0, s.level + (r.us - s.us) / 1000000.0 * 0.0005) >= 1.0 then least(10.0, s.level + (r.us - s.us) / 1000000.0 * 0.0005) - 1.0 else least(10.0, s.level + (r.us - s.us) / 1000000.0 * 0.0005) end as double)
    from s join r on r.bucket = s.bucket and r.n = s.n + 1)"""


def _states(t: Tables) -> DataFrame:
    return ratelimit.token_states(t.requests, 10.0, 0.0005)


query("rl3_peek", _LAST + " select bucket, round(least(10.0, level + 600 * 0.0005), 4) as tokens, least(10.0, level + 600 * 0.0005) <= 0 as exhausted from s where n = c")(lambda t: ratelimit.peeked(_states(t), F.col("at_us") + 600_000_000, 10.0, 0.0005).select("bucket", F.round("tokens", 4).alias("tokens"), "exhausted"))
query("rl2_refund", _LAST + " select bucket, round(least(10.0, level + 1), 4) as refunded from s where n = c")(lambda t: ratelimit.refunded(_states(t), _states(t).select("bucket", "at_us", F.lit(1.0).alias("tokens")), 10.0, 0.0005).select("bucket", F.round("tokens", 4).alias("refunded")))


@query("rl2_refund_peek_reset", _LAST + " select bucket, round(least(10.0, least(10.0, level + 1) + 600 * 0.0005), 4) as tokens from s where n = c and bucket <> 'click'")
def rl2(t: Tables) -> DataFrame:
    """A token given back to every bucket, one bucket reset, the rest looked at ten minutes later."""
    states = _states(t)
    left = ratelimit.reset(ratelimit.refunded(states, states.select("bucket", "at_us", F.lit(1.0).alias("tokens")), 10.0, 0.0005), t.spark.range(1).select(F.lit("click").alias("bucket")))
    return ratelimit.peeked(left, F.col("at_us") + 600_000_000, 10.0, 0.0005).select("bucket", F.round("tokens", 4).alias("tokens"))


query("rl6_gcra_refund", "select cast(c_custkey as varchar) as bucket, case when c_custkey % 3 = 0 then c_custkey * 1.5 else c_custkey * 2.0 end as tat from customer")(lambda t: ratelimit.arrivals_refunded(_arrivals(t), t.base("customer").select(F.col("c_custkey").cast("string").alias("bucket"), (F.col("c_custkey") * 1.5).alias("before"), (F.col("c_custkey") * F.when(F.col("c_custkey") % 3 == 0, 2.0).otherwise(2.5)).alias("after"))))


def _arrivals(t: Tables) -> DataFrame:
    return t.base("customer").select(F.col("c_custkey").cast("string").alias("bucket"), (F.col("c_custkey") * 2.0).alias("tat"))


def _by_user(t: Tables) -> DataFrame:
    return t.base("events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("bucket"), "ts", F.col("event_id").alias("request_id"))


query("rl4_resting_logs", """with recursive r as (select concat('u', user_id) as bucket, event_id as request_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as n from events),
  s as (select bucket, n, request_id, true as allowed, [us] as log from r where n = 1
    union all select r.bucket, r.n, r.request_id, len(list_filter(s.log, lambda x: x > r.us - 1800000000)) < 2, case when len(list_filter(s.log, lambda x: x > r.us - 1800000000)) < 2 then list_append(list_filter(s.log, lambda x: x > r.us - 1800000000), r.us) else list_filter(s.log, lambda x: x > r.us - 1800000000) end
    from s join r on r.bucket = s.bucket and r.n = s.n + 1) select bucket, request_id, allowed from s""")(lambda t: ratelimit.sliding_log(_by_user(t), 2, 1800.0).select("bucket", "request_id", "allowed"))

# Event log, timers, instruments


def _changes(t: Tables) -> DataFrame:
    """Every change of state on its job's channel, numbered as in the table."""
    return t.job_events.select("id", F.concat(F.lit("job:"), F.col("job_id").cast("string")).alias("channel"), F.col("to_state").alias("payload"))


def _logged(t: Tables, rows: DataFrame, batches: int = 2) -> tuple[str, object, str]:
    """A log with the rows in so many batches, the stream behind it and its checkpoint."""
    source, log, state = (new_folder(t.spark, label) for label in ("changes", "log", "publish"))
    # As many files as tasks have written, so that these and the log's writers share the work.
    rows.write.parquet(source)
    each = max(1, -(-len(t.spark.read.schema(event_log.EVENT).parquet(source).inputFiles()) // batches))
    stream = t.spark.readStream.schema(event_log.EVENT).option("maxFilesPerTrigger", each).parquet(source)
    event_log.publish(stream, log, state)
    return log, stream, state


@query("snk12_event_log", "select 'job:' || job_id as channel, count(*) as n from job_events where to_state <> 'running' group by job_id")
def snk12_log(t: Tables) -> DataFrame:
    """Published twice from one checkpoint: the second time there is nothing left to publish."""
    log, stream, state = _logged(t, _changes(t).filter("payload <> 'running'"))
    event_log.publish(stream, log, state)
    return event_log.read(t.spark, log).groupBy("channel").agg(F.count("*").alias("n"))


@query("src21_resumed", "select id, 'job:' || job_id as channel, to_state as payload from job_events where id > (select max(id) from job_events) // 2 and to_state in ('failed', 'crashed')")
def src21_resumed(t: Tables) -> DataFrame:
    """A follower that comes back with the last id it saw, and is started twice from its own checkpoint."""
    rows = _changes(t).filter("payload in ('failed', 'crashed')")
    last = t.job_events.agg(F.max("id")).first()[0] // 2
    log, _, _ = _logged(t, rows)
    out = new_folder(t.spark, "followed")
    streams.drained(event_log.follow(t.spark, log, after=last), out)
    return streams.drained(event_log.follow(t.spark, log, after=last), out).select("id", "channel", "payload")


@query("st12_timeouts", "select id as job_id, started_at + interval '30' minute as timed_out_at from jobs where started_at is not null and (finished_at is null or finished_at > started_at + interval '30' minute) and started_at + interval '30' minute <= (select max(coalesce(finished_at, started_at)) from jobs)")
def st12_timeouts(t: Tables) -> DataFrame:
    """Attempts still running half an hour after their start, found by timers over the stream of all starts and ends."""
    starts = t.jobs.filter("started_at is not null").select(F.col("id").alias("job_id"), F.col("started_at").alias("at"), F.lit("running").alias("status"))
    ends = t.jobs.filter("finished_at is not null").select(F.col("id").alias("job_id"), F.col("finished_at").alias("at"), "status")
    path = new_folder(t.spark, "states")
    starts.unionByName(ends).write.parquet(path)
    stream = t.spark.readStream.schema("job_id long, at timestamp_ntz, status string").parquet(path)
    found = streams.drained(timers.attempts_timed_out(stream, 1800), new_folder(t.spark, "timed"))
    return found.select("job_id", F.col("timed_out_at").cast("timestamp_ntz").alias("timed_out_at"))


def _instruments(t: Tables) -> list[DataFrame]:
    jobs, ended = t.jobs, t.jobs.filter("finished_at is not null")
    swept = transitions.expire_deadlines(jobs, NOW).rows
    return [
        metrics.counter(jobs, "jobs.published", ["actor", "queue"]),
        metrics.counter(ended.withColumnRenamed("status", "outcome"), "jobs.consumed", ["actor", "queue", "outcome"]),
        metrics.counter(jobs.filter("cancel_phase > 0"), "jobs.cancel_requested", []),
        metrics.counter(swept, "jobs.deadline_failed", ["actor"]),
        metrics.gauge(jobs.filter("status in ('pending', 'scheduled')"), "queue.depth", ["queue"]),
        metrics.gauge(t.reservation_slots.filter("job_id is not null").withColumnRenamed("bucket_name", "bucket"), "slots.used", ["bucket"]),
        metrics.counter(t.jobs_archive, "jobs.archived", ["status"]),
    ]


_COUNTS = """select 'jobs.published' as name, '{"actor":"' || actor || '","queue":"' || queue || '"}' as labels, count(*) as n from jobs group by actor, queue
  union all select 'jobs.consumed', '{"actor":"' || actor || '","outcome":"' || status || '","queue":"' || queue || '"}', count(*) from jobs where finished_at is not null group by actor, status, queue
  union all select 'jobs.cancel_requested', '{}', count(*) from jobs where cancel_phase > 0
  union all select 'jobs.deadline_failed', '{"actor":"' || actor || '"}', count(*) from jobs where status in ('pending', 'scheduled') and schedule_to_close < NOW group by actor
  union all select 'queue.depth', '{"queue":"' || queue || '"}', count(*) from jobs where status in ('pending', 'scheduled') group by queue
  union all select 'slots.used', '{"bucket":"' || bucket_name || '"}', count(*) from reservation_slots where job_id is not null group by bucket_name
  union all select 'jobs.archived', '{"status":"' || status || '"}', count(*) from jobs_archive group by status"""
query("snk14_instruments", _COUNTS)(lambda t: metrics.merged(*_instruments(t)).select("name", "labels", "n"))

# Milliseconds are whole, so only powers of two lie on a bound.
_PLACE = "case when v > 0 then case when pow(2, round(log2(v))) = v then cast(round(log2(v)) * 8 as bigint) else cast(ceil(log2(v) * 8) as bigint) end - 1 end"


@query("agg18_histograms", f"""with x as (select '{{"actor":"' || actor || '"}}' as labels, (epoch_us(finished_at) - epoch_us(started_at)) // 1000 as v from jobs where finished_at is not null union all select '{{"actor":"' || actor || '"}}', duration_ms from jobs_archive a join job_attempts_archive t on t.job_id = a.id)
  select labels, 3 as scale, {_PLACE} as bucket, count(*) as n, min(v)::double as least, max(v)::double as most from x group by 1, 3""")
def agg18(t: Tables) -> DataFrame:
    """Durations of live and archived attempts, one histogram each, merged."""
    live = metrics.histogram(t.jobs.filter("finished_at is not null"), "attempt.duration", ["actor"], C.whole_ms(F.col("started_at"), F.col("finished_at")))
    old = t.jobs_archive.select("id", "actor").join(t.job_attempts_archive.select(F.col("job_id").alias("id"), "duration_ms"), "id")
    return metrics.merged(live, metrics.histogram(old, "attempt.duration", ["actor"], F.col("duration_ms"))).select("labels", "scale", "bucket", "n", "least", "most")


# Hooks, counts, lookups


def _sulks(job: int, cause: str) -> None:
    raise PermissionError(cause)


def _fussy(job: int, cause: str) -> None:
    if cause == "Rejected":
        raise ConnectionError(cause)


query("udf10_reported", _ENDED + """select id as job_id, case when actor = 'purchase' then 'PermissionError' when actor = 'click' then 'called' end as hook, case when branch = 'failed' then 'ConnectionError' else 'called' end as report
  from b where branch in ('deadline_failed', 'max_attempts_failed', 'retries_failed', 'failed')""")(lambda t: actors.told(_applied(t).exhausted, {"click": lambda job, cause: None, "purchase": _sulks}, _fussy))

_STATE3 = """with a as (select *, case when status = 'scheduled' and scheduled_at <= NOW then 'pending' else status end as s1 from jobs),
  b as (select *, case when s1 = 'running' and lock_expires_at < NOW and (cancel_phase = 0 or lock_expires_at < NOW - interval '100' second) then case when attempt < max_attempts and retry_kind <> 'non_retryable' then 'pending' else 'crashed' end else s1 end as s2 from a),
  c as (select *, case when s2 in ('pending', 'scheduled') and schedule_to_close < NOW then 'failed' else s2 end as s3 from b) """


def _kept(t: Tables) -> DataFrame:
    """Counts after three sweeps, from those before and what the sweeps changed."""
    jobs, deltas = t.jobs, []
    for sweep in (transitions.promote, transitions.reclaim, transitions.expire_deadlines):
        found = sweep(jobs, NOW)
        deltas.append(counts.changes(found))
        jobs = found.apply(jobs)
    return counts.kept(counts.counted(t.jobs), *deltas)


query("agg7_kept_counts", _STATE3 + "select actor, queue, s3 as status, count(*) as n from c group by actor, queue, s3")(lambda t: _kept(t))
query("agg3_kept_waiting", _STATE3 + "select actor, count(*) as n from c where s3 in ('pending', 'scheduled') group by actor")(lambda t: counts.waiting(_kept(t)))


@query("src3_laid_out", "select id, idempotency_key, status from jobs where idempotency_key in ('k2', 'k10', 'k11', 'k400') union all select id, idempotency_key, status from jobs where id in (7, 77, 777)")
def src3(t: Tables) -> DataFrame:
    """Lookups in a table that was laid out for them: two by key, three by id."""
    path = new_folder(t.spark, "laid-out")
    layout.lay_out(t.jobs.select("id", "idempotency_key", "status", "actor", "created_at"), path, keys=["idempotency_key"])
    keys = layout.by_key(t.spark, path, "idempotency_key", ["k2", "k10", "k11", "k400", None])
    ids = layout.by_ids(t.spark, path, [7, 77, 777, 7, None])
    return keys.unionByName(ids).select("id", "idempotency_key", "status")
