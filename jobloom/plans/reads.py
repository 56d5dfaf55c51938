"""Queries over sources, filters, projections, joins, aggregates, windows, sorts, sets and scalars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.functions import columns as C
from jobloom.operators.selection import percentiles
from jobloom.plans.registry import query
from jobloom.sources.fixtures import NOW, Tables
from jobloom.sources.shared import written

ROW = ["id", "actor", "queue", "status", "priority"]


# Sources


@query("src1_point_lookup", "select id, actor, queue, status, priority from jobs where id = 42")
def src1(t: Tables) -> DataFrame:
    return t.jobs.filter("id = 42").select(*ROW)


@query("src2_multi_get", "select id, actor, queue, status, priority from jobs where id in (select p_partkey from part where p_size > 40)")
def src2(t: Tables) -> DataFrame:
    return t.jobs.join(t.base("part").filter("p_size > 40").select(F.col("p_partkey").alias("id")), "id", "left_semi").select(*ROW)


@query("src3_by_idempotency_key", "select id, idempotency_key, status from jobs where idempotency_key in ('k2', 'k10', 'k11', 'k400')")
def src3(t: Tables) -> DataFrame:
    return t.jobs.filter(F.col("idempotency_key").isin("k2", "k10", "k11", "k400")).select("id", "idempotency_key", "status")


@query("src4_list_schedules", "select id, actor, name, cron_expr, enabled from cron_schedules where actor = 'click' and enabled")
def src4(t: Tables) -> DataFrame:
    return t.cron_schedules.filter(C.matches(actor="click", enabled=True)).select("id", "actor", "name", "cron_expr", "enabled")


@query("src5_attempts_of_job", "select job_id, attempt, duration_ms from job_attempts_archive where job_id in (7, 8, 9) order by job_id, attempt")
def src5(t: Tables) -> DataFrame:
    return t.job_attempts_archive.filter(F.col("job_id").isin(7, 8, 9)).orderBy("job_id", "attempt").select("job_id", "attempt", "duration_ms")


@query("src6_events_of_job", "select id, occurred_at, from_state, to_state from job_events where job_id = 77 order by occurred_at, id")
def src6(t: Tables) -> DataFrame:
    return t.job_events.filter("job_id = 77").orderBy("occurred_at", "id").select("id", "occurred_at", "from_state", "to_state")


@query("src7_archive_fallback", """select id, actor, status, false as is_archived from jobs
  union all select id, actor, status, true from jobs_archive a where not exists (select 1 from jobs j where j.id = a.id)""")
def src7(t: Tables) -> DataFrame:
    live, old = t.jobs, t.jobs_archive
    return live.select("id", "actor", "status", F.lit(False).alias("is_archived")).unionByName(old.join(live, "id", "left_anti").select("id", "actor", "status", F.lit(True).alias("is_archived")))


@query("src8_rows_from_arrays", "select s_suppkey, unnest([s_suppkey, s_nationkey, -1]) as id, unnest([s_name, 'b', null]) as actor, unnest([5, null, 7]) as priority from supplier")
def src8(t: Tables) -> DataFrame:
    ids, names, ranks = F.array("s_suppkey", "s_nationkey", F.lit(-1)), F.array("s_name", F.lit("b"), F.lit(None)), F.array(F.lit(5), F.lit(None), F.lit(7))
    return t.base("supplier").select("s_suppkey", F.inline(F.arrays_zip(ids.alias("id"), names.alias("actor"), ranks.alias("priority"))))


@query("src9_generate_slots", "select n_nationkey as bucket, unnest(range(0, n_nationkey % 7 + 1)) as slot_index from nation")
def src9(t: Tables) -> DataFrame:
    return t.base("nation").select(F.col("n_nationkey").alias("bucket"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_nationkey").cast("long") % 7)).alias("slot_index"))


@query("src10_parameter_row", "select count(*) as n from jobs, (select NOW as at, 'q1' as q) p where queue = p.q and created_at < p.at")
def src10(t: Tables) -> DataFrame:
    return t.jobs.filter((F.col("queue") == "q1") & (F.col("created_at") < C.moment(NOW))).agg(F.count("*").alias("n"))


# Versions that a release knows, and those that an installation has applied, one of them unknown to the release.
_KNOWN = "select lpad(cast(p_size as varchar(9)), 2, '0') as major, min(p_partkey) as checksum from part group by 1"
_APPLIED = "select lpad(cast(p_size as varchar(9)), 2, '0') as major, min(p_partkey) + max(case when p_size = 7 then 1 else 0 end) as checksum from part where p_size < 30 group by 1 union all select '99', 1 from region where r_regionkey = 0"


@query("src11_pending_versions", f"select coalesce(k.major, a.major) as v, case when a.major is null then 'pending' when k.major is null then 'unknown' when k.checksum <> a.checksum then 'changed' else 'applied' end as state from ({_KNOWN}) k full join ({_APPLIED}) a on k.major = a.major")
def src11(t: Tables) -> DataFrame:
    return versions(t.sql(_KNOWN), t.sql(_APPLIED))


def versions(known: DataFrame, applied: DataFrame | None) -> DataFrame:
    """(v, state) of versions (major, checksum); without a table of applied ones all are pending."""
    if applied is None:
        return known.select(F.col("major").alias("v"), F.lit("pending").alias("state"))
    a = applied.select(F.col("major").alias("done"), F.col("checksum").alias("sum"))
    state = F.when(F.col("done").isNull(), "pending").when(F.col("major").isNull(), "unknown").when(F.col("checksum") != F.col("sum"), "changed").otherwise("applied")
    return known.join(a, F.col("major") == F.col("done"), "full").select(F.coalesce("major", "done").alias("v"), state.alias("state"))


@query("src12_queue_modes", "select a.name, coalesce(q.mode, 'strict_fifo') as mode from (values ('q0'), ('q1'), ('q2')) as a(name) left join queues q on a.name = q.name")
def src12(t: Tables) -> DataFrame:
    from jobloom.plans.dispatch import resolved_modes

    return resolved_modes(t.queues, ["q0", "q1", "q2", "q1"])


@query("src13_actor_config", "select actor, max_concurrent, max_pending from actor_config where actor in ('click', 'signup', 'none')")
def src13(t: Tables) -> DataFrame:
    return t.actor_config.filter(F.col("actor").isin("click", "signup", "none")).select("actor", "max_concurrent", "max_pending")


@query("src14_running_of_worker", "select id, actor, attempt from jobs where status = 'running' and locked_by_worker = 7")
def src14(t: Tables) -> DataFrame:
    return t.jobs.filter(C.matches(status="running", locked_by_worker=7)).select("id", "actor", "attempt")


@query("src17_polled_changes", """select job_id, seq, status from (select job_id, seq, status, lag(status) over (partition by job_id order by seq) as b, row_number() over (partition by job_id order by seq) as n from progress) where n = 1 or b is distinct from status""")
def src17(t: Tables) -> DataFrame:
    from jobloom.streaming.streams import snapshot_changes

    return snapshot_changes(t.progress, ["job_id"], ["status"], "seq").select("job_id", "seq", "status")


@query("src18_worker_health", "select workgroup_instance, worker_label, id from (select *, row_number() over (partition by workgroup_instance, worker_label order by last_seen_at desc, id) as n from workers) where n = 1")
def src18(t: Tables) -> DataFrame:
    best = F.min_by("id", F.struct(-C.micros(F.col("last_seen_at")), F.col("id")))
    return t.workers.groupBy("workgroup_instance", "worker_label").agg(best.alias("id"))


@query("src19_handle_result", "select id, case when status not in ('pending','scheduled','running') then case when status <> 'succeeded' then 'error' when result is not null then 'result' else 'unavailable' end else 'waiting' end as answer from jobs")
def src19(t: Tables) -> DataFrame:
    s = F.col("status")
    answer = F.when(~s.isin(*C.TERMINAL), "waiting").when(s != "succeeded", "error").when(F.col("result").isNotNull(), "result").otherwise("unavailable")
    return t.jobs.select("id", answer.alias("answer"))


@query("src20_next_scheduled", "select min(scheduled_at) as at from jobs where status = 'scheduled' and scheduled_at > NOW")
def src20(t: Tables) -> DataFrame:
    return t.jobs.filter((F.col("status") == "scheduled") & (F.col("scheduled_at") > C.moment(NOW))).agg(F.min("scheduled_at").alias("at"))


# Filters


def _filter(name: str, where: str, make) -> None:
    @query(name, f"select id, actor, queue, status, priority from jobs where {where}")
    def run(t: Tables, make=make) -> DataFrame:
        return t.jobs.filter(make()).select(*ROW)


_filter("fil1_equalities", "queue = 'q1' and status = 'pending' and actor = 'view'", lambda: C.matches(queue="q1", status="pending", actor="view", identity_key=None))
_filter("fil2_json_contains", "json_extract_string(metadata, '$.batch_id') = 'b7'", lambda: C.json_equals(F.col("metadata"), "batch_id", "b7"))
_filter("fil4_tags_overlap", "list_has_any(string_split(tag_list, ','), ['tag1', 'tag6'])", lambda: C.overlaps(C.tags(F.col("tag_list")), ["tag1", "tag6"]))
_filter("fil5_status_in", "status in ('failed', 'crashed')", lambda: F.col("status").isin("failed", "crashed"))
_filter("fil7_substring", "actor ilike '%IC%'", lambda: C.contains_text(F.col("actor"), "IC"))
_filter("fil8_free_text", "(cast(id as varchar) ilike '%99%' or actor ilike '%99%')", lambda: C.free_text("99"))
_filter("fil9_optional_parameter", "actor = 'click'", lambda: C.matches(actor="click", queue=None))
_filter("fil10_time_range", "created_at >= NOW - interval '7' day and created_at <= NOW", lambda: C.within_last(F.col("created_at"), "7d", NOW) & C.between(F.col("created_at"), end=NOW))
_filter("fil11_keyset_dispatch", "status = 'pending' and (priority < 2 or (priority = 2 and scheduled_at > timestamp '2024-01-10 00:00:00') or (priority = 2 and scheduled_at = timestamp '2024-01-10 00:00:00' and id > 50))", lambda: (F.col("status") == "pending") & C.after_dispatch_key(2, "2024-01-10 00:00:00", 50))
_filter("fil12_keyset_row_value", "(created_at, id) < (timestamp '2024-01-12 00:00:00', 5000)", lambda: C.keyset(["created_at", "id"], ["2024-01-12 00:00:00", 5000], ["timestamp_ntz", "long"], ascending=False))
_filter("fil13_keyset_nulls_far", "(coalesce(finished_at, timestamp '9999-12-31 23:59:59'), id) < (timestamp '2024-01-12 00:00:00', 5000)", lambda: F.struct(C.or_far(F.col("finished_at")).alias("a"), F.col("id").alias("b")) < F.struct(C.moment("2024-01-12 00:00:00").alias("a"), F.lit(5000).cast("long").alias("b")))
_filter("fil14_due", "status = 'pending' and scheduled_at <= NOW and (schedule_to_close is null or schedule_to_close > NOW)", lambda: C.due(NOW))
_filter("fil15_lease_expired", "status = 'running' and lock_expires_at < NOW and (cancel_phase = 0 or lock_expires_at < NOW - interval '100' second)", lambda: C.lease_expired(NOW))
_filter("fil16_deadline", "status in ('pending', 'scheduled') and schedule_to_close < NOW", lambda: C.past_deadline(NOW))
_filter("fil17_promote", "status = 'scheduled' and scheduled_at <= NOW", lambda: C.promotable(NOW))
_filter("fil18_ttl", "finished_at < NOW - interval '10' day", lambda: C.older_than(F.col("finished_at"), NOW, 10 * 86400))
_filter("fil19_recency", "created_at > NOW - interval '2' day and status in ('pending', 'running')", lambda: C.recent(NOW, 2 * 86400, ["pending", "running"]))
_filter("fil22_cancel_flags", "status = 'running' and locked_by_worker = 3 and cancel_phase > 0", lambda: C.matches(status="running", locked_by_worker=3) & (F.col("cancel_phase") > 0))
_filter("fil23_checked_states", "status in ('pending', 'crashed')", lambda: F.col("status").isin(*C.checked_states(["pending", "crashed"])))


_FLAGS = """select event_id as i, case event_id % 5 when 0 then '{"singleton": true}' when 1 then '{"singleton": "true"}' when 2 then '{}' when 4 then '{"singleton": false}' end as m from events"""


@query("fil3_json_boolean", f"select i from ({_FLAGS}) where json_type(m, '$.singleton') = 'BOOLEAN' and json_extract_string(m, '$.singleton') = 'true'")
def fil3(t: Tables) -> DataFrame:
    return t.sql(_FLAGS).filter(C.json_true(F.col("m"), "singleton")).select("i")


@query("fil6_array_member", "select id from workers where list_contains(string_split(queue_list, ','), 'q3')")
def fil6(t: Tables) -> DataFrame:
    return t.workers.filter(F.array_contains(C.tags(F.col("queue_list")), "q3")).select("id")


@query("fil20_json_number", """select id, cast(json_extract_string(props, '$.k') as int) as k from (select event_id as id, props from events) where regexp_full_match(json_extract_string(props, '$.k'), '[0-9]+') and cast(json_extract_string(props, '$.k') as int) < 20""")
def fil20(t: Tables) -> DataFrame:
    return t.base("events").select(F.col("event_id").alias("id"), C.whole_number(F.col("props"), "k").alias("k")).filter("k < 20")


@query("fil21_due_schedules", "select id, actor from cron_schedules where enabled and next_fire_at <= NOW order by next_fire_at, id")
def fil21(t: Tables) -> DataFrame:
    return t.cron_schedules.filter(F.col("enabled") & (F.col("next_fire_at") <= C.moment(NOW))).orderBy("next_fire_at", "id").select("id", "actor")


# Projections

_US = "(epoch_us(finished_at) - epoch_us(started_at))"


@query("prj1_duration_ms", f"select id, {_US} / 1000.0 as duration_ms from jobs")
def prj1(t: Tables) -> DataFrame:
    return t.jobs.select("id", C.duration_ms(F.col("started_at"), F.col("finished_at")).alias("duration_ms"))


_LATE = "finished_at + (id % 3) * interval '30' day - (id % 7) * interval '333' microsecond"


@query("prj2_whole_ms", f"select id, cast(trunc((epoch_us({_LATE}) - epoch_us(started_at)) / 1000.0) as bigint) as duration_ms from jobs union all select -id, cast(trunc((epoch_us(started_at) - epoch_us({_LATE})) / 1000.0) as bigint) from jobs")
def prj2(t: Tables) -> DataFrame:
    start, end = F.col("started_at"), F.expr(_LATE)
    return t.jobs.select("id", C.whole_ms(start, end).alias("duration_ms")).unionByName(t.jobs.select((-F.col("id")).alias("id"), C.whole_ms(end, start).alias("duration_ms")))


@query("prj3_status_rank", "select id, case when status in ('pending','scheduled','running') then 0 else 1 end as status_priority from jobs")
def prj3(t: Tables) -> DataFrame:
    return t.jobs.select("id", C.status_rank(F.col("status")).alias("status_priority"))


@query("prj4_archived_tag", "select is_archived, count(*) as n from (select false as is_archived from jobs union all select true from jobs_archive) group by is_archived")
def prj4(t: Tables) -> DataFrame:
    return t.jobs.select(F.lit(False).alias("is_archived")).unionByName(t.jobs_archive.select(F.lit(True).alias("is_archived"))).groupBy("is_archived").agg(F.count("*").alias("n"))


@query("prj5_is_leader", "select w.id, m.worker_id is not null as is_leader from workers w left join maintenance_leader m on m.worker_id = w.id")
def prj5(t: Tables) -> DataFrame:
    return t.workers.join(F.broadcast(t.maintenance_leader), F.col("id") == F.col("worker_id"), "left").select("id", F.col("worker_id").isNotNull().alias("is_leader"))


@query("prj6_initial_status", "select id, case when coalesce(scheduled_at, NOW) > NOW then 'scheduled' else 'pending' end as initial from jobs")
def prj6(t: Tables) -> DataFrame:
    return t.jobs.select("id", C.initial_status(F.col("scheduled_at"), NOW).alias("initial"))


@query("prj7_next_cursor", "select id from (select id, row_number() over (order by created_at desc, id) as n from jobs) where n = 50")
def prj7(t: Tables) -> DataFrame:
    page = t.jobs.orderBy(F.desc("created_at"), "id").limit(51)
    w = Window.orderBy(F.desc("created_at"), "id")
    return page.select("id", F.row_number().over(w).alias("n")).filter("n = 50").select("id")


@query("prj8_has_pages", "select count(*) > 50 as has_next, false as has_prev from jobs")
def prj8(t: Tables) -> DataFrame:
    return t.jobs.select("id").limit(51).agg((F.count("*") > 50).alias("has_next")).withColumn("has_prev", F.lit(False))


@query("prj9_clipped_text", "select doc_id, case when length(text) > 2000 then substr(text, 1, 2000 - length(s)) || s else text end as text from (select doc_id, text, chr(10) || '... (' || (length(text) - 2000) || ' more characters)' as s from documents)")
def prj9(t: Tables) -> DataFrame:
    return t.base("documents").select("doc_id", C.clipped(F.col("text")).alias("text"))


@query("prj10_normalised", "select cast(id as varchar) as id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') || case when epoch_us(created_at) % 1000000 = 0 then '' else strftime(created_at, '.%f') end as created_at, json_extract_string(metadata, '$.batch_id') as batch from jobs")
def prj10(t: Tables) -> DataFrame:
    return t.jobs.select(F.col("id").cast("string").alias("id"), C.iso(F.col("created_at")).alias("created_at"), F.get_json_object("metadata", "$.batch_id").alias("batch"))


@query("prj11_watchdog", "select id, NOW - interval '30' second <= last_seen_at as healthy from workers")
def prj11(t: Tables) -> DataFrame:
    return t.workers.select("id", C.healthy(F.col("last_seen_at"), NOW, 30).alias("healthy"))


@query("prj12_progress_snapshot", "select job_id, seq, status, length(detail) as detail_length from progress")
def prj12(t: Tables) -> DataFrame:
    return t.progress.select("job_id", "seq", "status", F.length("detail").alias("detail_length"))


@query("prj13_capped_count", "select case when count(*) > 1000 then '1,000+' else format('{:,}', count(*)) end as shown from jobs")
def prj13(t: Tables) -> DataFrame:
    n = t.jobs.select("id").limit(1001).count()
    return t.spark.createDataFrame([(C.capped_count(n),)], "shown string")


# Joins

_CAP = "select a.actor, coalesce(r.n, 0) as in_flight, case when a.max_concurrent is null then 50 else greatest(a.max_concurrent - coalesce(r.n, 0), 0) end as residual from actor_config a left join (select actor, count(*) as n from jobs where status = 'running' group by actor) r on a.actor = r.actor"


@query("joi1_capacity", _CAP)
def joi1(t: Tables) -> DataFrame:
    from jobloom.plans.dispatch import capacity

    return capacity(t.jobs, t.actor_config, 50).select("actor", "in_flight", "residual")


@query("joi2_unnest_queues", "select c.actor, q.queue from actor_config c cross join (values ('q0'), ('q1')) as q(queue)")
def joi2(t: Tables) -> DataFrame:
    return t.actor_config.select("actor", F.explode(F.array_distinct(F.array(F.lit("q0"), F.lit("q1"), F.lit("q0")))).alias("queue"))


_DUE = "status = 'pending' and scheduled_at <= NOW and (schedule_to_close is null or schedule_to_close > NOW)"


@query("joi3_top_n_per_group", f"select id, actor, queue from (select id, actor, queue, row_number() over (partition by actor, queue order by priority desc, scheduled_at, id) as n from jobs where {_DUE}) where n <= 5")
def joi3(t: Tables) -> DataFrame:
    w = Window.partitionBy("actor", "queue").orderBy(F.desc("priority"), "scheduled_at", "id")
    return t.jobs.filter(C.due(NOW)).withColumn("n", F.row_number().over(w)).filter("n <= 5").select("id", "actor", "queue")


@query("joi4_top_n_per_cohort", f"select id, actor, queue, fairness_key from (select *, row_number() over (partition by actor, queue, coalesce(fairness_key, '__null__') order by priority desc, scheduled_at, id) as n from jobs where {_DUE}) where n <= 2")
def joi4(t: Tables) -> DataFrame:
    w = Window.partitionBy("actor", "queue", F.coalesce("fairness_key", F.lit("__null__"))).orderBy(F.desc("priority"), "scheduled_at", "id")
    return t.jobs.filter(C.due(NOW)).withColumn("n", F.row_number().over(w)).filter("n <= 2").select("id", "actor", "queue", "fairness_key")


_BUSY = "select distinct actor, identity_key from jobs where status = 'running' and identity_key is not null"


@query("joi5_not_running_identity", f"select j.id from jobs j left join ({_BUSY}) b on j.actor = b.actor and j.identity_key = b.identity_key where j.status = 'pending' and j.identity_key is not null and b.actor is null")
def joi5(t: Tables) -> DataFrame:
    busy = t.jobs.filter("status = 'running' and identity_key is not null").select("actor", "identity_key").distinct()
    return t.jobs.filter("status = 'pending' and identity_key is not null").join(busy, ["actor", "identity_key"], "left_anti").select("id")


@query("joi6_recheck_pending", "select r.id from (select id from jobs where priority = 3) r join jobs j on r.id = j.id where j.status = 'pending'")
def joi6(t: Tables) -> DataFrame:
    return t.jobs.filter("priority = 3").select("id").join(t.jobs.filter("status = 'pending'").select("id"), "id").select("id")


@query("joi7_eligibility", f"select j.id, c.residual from jobs j join ({_CAP}) c on j.actor = c.actor where j.status = 'pending' and c.residual > 0")
def joi7(t: Tables) -> DataFrame:
    from jobloom.plans.dispatch import capacity

    return t.jobs.filter("status = 'pending'").join(capacity(t.jobs, t.actor_config, 50).filter("residual > 0"), "actor").select("id", "residual")


@query("joi8_apply_delta", "select id, case when status = 'scheduled' and scheduled_at <= NOW then 'pending' else status end as status from jobs")
def joi8(t: Tables) -> DataFrame:
    from jobloom.plans.transitions import promote

    return promote(t.jobs, NOW).apply(t.jobs).select("id", "status")


_LIVE = "select distinct unnest(string_split(queue_list, ',')) as queue from workers where last_seen_at > NOW - interval '30' second"


@query("joi9_orphan_queues", f"select distinct queue from jobs where status = 'pending' and queue not in (select queue from ({_LIVE}) where queue <> 'q2')")
def joi9(t: Tables) -> DataFrame:
    live = t.workers.filter(F.col("last_seen_at") > C.moment(NOW) - C.seconds(30)).select(F.explode(C.tags(F.col("queue_list"))).alias("queue")).filter("queue <> 'q2'").distinct()
    return t.jobs.filter("status = 'pending'").select("queue").distinct().join(live, "queue", "left_anti")


@query("joi10_queue_has_worker", f"select count(*) > 0 as covered from ({_LIVE}) where queue = 'q1'")
def joi10(t: Tables) -> DataFrame:
    live = t.workers.filter((F.col("last_seen_at") > C.moment(NOW) - C.seconds(30)) & F.array_contains(C.tags(F.col("queue_list")), "q1"))
    return live.limit(1).agg((F.count("*") > 0).alias("covered"))


@query("joi11_stranded", "select j.id, j.actor from jobs j where j.status in ('pending', 'scheduled') and not exists (select 1 from actor_config a where a.actor = j.actor)")
def joi11(t: Tables) -> DataFrame:
    return t.jobs.filter(F.col("status").isin("pending", "scheduled")).join(t.actor_config, "actor", "left_anti").select("id", "actor")


@query("joi12_slots_of_running", "select bucket_name, slot_index from reservation_slots s where exists (select 1 from jobs j where j.id = s.job_id and j.status = 'running')")
def joi12(t: Tables) -> DataFrame:
    return t.reservation_slots.join(t.jobs.filter("status = 'running'").select(F.col("id").alias("job_id")), "job_id", "left_semi").select("bucket_name", "slot_index")


@query("joi13_semi_two_keys", "select bucket_name, slot_index, job_id from reservation_slots where (bucket_name, slot_index) in (select bucket_name, min(slot_index) from reservation_slots where job_id is null group by bucket_name)")
def joi13(t: Tables) -> DataFrame:
    low = t.reservation_slots.filter("job_id is null").groupBy("bucket_name").agg(F.min("slot_index").alias("slot_index"))
    return t.reservation_slots.join(low, ["bucket_name", "slot_index"], "left_semi").select("bucket_name", "slot_index", "job_id")


@query("joi14_semi_delete", "select id from jobs where id not in (select id from jobs where finished_at < NOW - interval '10' day)")
def joi14(t: Tables) -> DataFrame:
    return t.jobs.join(t.jobs.filter(C.older_than(F.col("finished_at"), NOW, 10 * 86400)).select("id"), "id", "left_anti").select("id")


@query("joi15_archive_fan_out", "select a.id, count(*) as n from jobs_archive a left join job_attempts_archive t on t.job_id = a.id group by a.id")
def joi15(t: Tables) -> DataFrame:
    return t.jobs_archive.select("id").join(t.job_attempts_archive.select(F.col("job_id").alias("id"), "attempt"), "id", "left").groupBy("id").agg(F.count("*").alias("n"))


@query("joi16_moved_attempts", "select t.job_id, t.attempt from jobs j join job_attempts t on t.job_id = j.id where j.finished_at < NOW - interval '10' day")
def joi16(t: Tables) -> DataFrame:
    old = t.jobs.filter(C.older_than(F.col("finished_at"), NOW, 10 * 86400)).select(F.col("id").alias("job_id"))
    return t.job_attempts.join(old, "job_id").select("job_id", "attempt")


@query("joi17_workers_with_leader", "select w.id, w.hostname, m.elected_at from workers w left join maintenance_leader m on m.worker_id = w.id")
def joi17(t: Tables) -> DataFrame:
    return t.workers.join(F.broadcast(t.maintenance_leader.select("worker_id", "elected_at")), F.col("id") == F.col("worker_id"), "left").select("id", "hostname", "elected_at")


@query("joi18_leader_detail", "select w.id, w.hostname, m.last_seen_at from maintenance_leader m join workers w on m.worker_id = w.id")
def joi18(t: Tables) -> DataFrame:
    return t.workers.select("id", "hostname").join(F.broadcast(t.maintenance_leader), F.col("id") == F.col("worker_id")).select("id", "hostname", "last_seen_at")


@query("joi20_configured_vs_stored", "select coalesce(c.b, s.b) as bucket, c.n as configured, s.n as stored from (values (0, 5), (1, 3), (9, 2)) as c(b, n) full outer join (select bucket_name as b, count(*) as n from reservation_slots group by bucket_name) s on c.b = s.b")
def joi20(t: Tables) -> DataFrame:
    conf = t.spark.createDataFrame([(0, 5), (1, 3), (9, 2)], "bucket int, configured int")
    stored = t.reservation_slots.groupBy(F.col("bucket_name").alias("bucket")).agg(F.count("*").alias("stored"))
    return conf.join(stored, "bucket", "full_outer").select("bucket", "configured", "stored")


# Aggregates


def _count(name: str, sql: str, make) -> None:
    query(name, sql)(make)


_count("agg1_in_flight", "select actor, count(*) as n from jobs where status = 'running' group by actor", lambda t: t.jobs.filter("status = 'running'").groupBy("actor").agg(F.count("*").alias("n")))
_count("agg2_waiting_per_actor", "select actor, count(*) as n from jobs where status in ('pending','scheduled') and actor in ('click','view') group by actor", lambda t: t.jobs.filter(F.col("status").isin("pending", "scheduled") & F.col("actor").isin("click", "view")).groupBy("actor").agg(F.count("*").alias("n")))


@query("agg3_backpressure", "select count(*) as n from jobs where actor = 'click' and status in ('pending','scheduled')")
def agg3(t: Tables) -> DataFrame:
    from jobloom.plans.enqueue import backpressure

    return backpressure(t.jobs, "click")


_count("agg4_batch_status", "select json_extract_string(metadata, '$.batch_id') as batch, status, count(*) as n from jobs group by 1, 2", lambda t: t.jobs.groupBy(F.get_json_object("metadata", "$.batch_id").alias("batch"), "status").agg(F.count("*").alias("n")))
_SEVEN = ("pending", "running", "succeeded", "failed", "cancelled", "crashed")


def _filtered_counts(states=_SEVEN):
    return [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in states]


_count("agg5_batch_completion", f"select count(*) as total, {', '.join(f'''count(*) filter (where status = '{s}') as n_{s}''' for s in _SEVEN)} from jobs where json_extract_string(metadata, '$.batch_id') = 'b7'", lambda t: t.jobs.filter(C.json_equals(F.col("metadata"), "batch_id", "b7")).agg(F.count("*").alias("total"), *_filtered_counts()))
_FOUR = ("pending", "scheduled", "running", "failed")
_count("agg6_queue_overview", f"select queue, {', '.join(f'''count(*) filter (where status = '{s}') as n_{s}''' for s in _FOUR)} from jobs group by queue", lambda t: t.jobs.groupBy("queue").agg(*_filtered_counts(_FOUR)))
_count("agg7_queue_depth", "select queue, count(*) as depth from jobs where status = 'pending' group by queue", lambda t: t.jobs.filter("status = 'pending'").groupBy("queue").agg(F.count("*").alias("depth")))
_count("agg8_slots_used", "select bucket_name, count(*) as used from reservation_slots where job_id is not null group by bucket_name", lambda t: t.reservation_slots.filter("job_id is not null").groupBy("bucket_name").agg(F.count("*").alias("used")))
_count("agg9_reservations", "select bucket_name, count(job_id) as held, count(*) - count(job_id) as free, count(*) as total from reservation_slots group by bucket_name", lambda t: t.reservation_slots.groupBy("bucket_name").agg(F.count("job_id").alias("held"), (F.count("*") - F.count("job_id")).alias("free"), F.count("*").alias("total")))
_count("agg10_reservation_peek", "select count(*) filter (where job_id is null or lease_expires_at < NOW) as free, count(*) filter (where job_id is not null and lease_expires_at >= NOW) as held, count(*) as total from reservation_slots where bucket_name = 2", lambda t: t.reservation_slots.filter("bucket_name = 2").agg(F.count_if(F.col("job_id").isNull() | (F.col("lease_expires_at") < C.moment(NOW))).alias("free"), F.count_if(F.col("job_id").isNotNull() & (F.col("lease_expires_at") >= C.moment(NOW))).alias("held"), F.count("*").alias("total")))
_BOTH = "select id, status, finished_at, created_at from jobs where actor in ('click', '1-URGENT') union all select id, status, finished_at, created_at from jobs_archive where actor in ('click', '1-URGENT')"
_SUM = f"select status, count(*) as n from (select status from ({_BOTH}) order by created_at desc, id, finished_at nulls first, status limit 1001) group by status"


def _summary(t: Tables) -> DataFrame:
    """The cap is the feature: a page counts 1,001 rows at most, here the latest ones."""
    columns = ["id", "status", "finished_at", "created_at"]
    own = F.col("actor").isin("click", "1-URGENT")
    both = t.jobs.filter(own).select(*columns).unionByName(t.jobs_archive.filter(own).select("id", "status", "finished_at", F.col("created_at").cast("timestamp_ntz").alias("created_at")))
    return both.orderBy(F.desc("created_at"), "id", F.asc_nulls_first("finished_at"), "status").limit(1001).groupBy("status").agg(F.count("*").alias("n"))


_count("agg11_history_summary", _SUM, _summary)


def actor_stats(archive: DataFrame, attempts: DataFrame, per_job: bool = False) -> DataFrame:
    """Counts and duration percentiles by actor and queue; a job with k attempts counts k times unless ``per_job``.

    Rows are counted by actor, queue, state and duration once; everything else comes from these counts.
    """
    if per_job:
        attempts = attempts.groupBy("job_id").agg(F.max_by("duration_ms", "attempt").alias("duration_ms"))
    by = ["actor", "queue"]
    rows = archive.select("id", *by, "status").join(attempts.select(F.col("job_id").alias("id"), "duration_ms"), "id", "left")
    counted = written(rows.groupBy(*by, "status", F.col("duration_ms").alias("v")).agg(F.count("*").alias("n")), "actor-stats")
    d = F.when(F.col("v").isNotNull(), F.col("n"))
    counts = [F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0)).alias(f"n_{s}") for s in ("succeeded", "failed", "cancelled", "crashed")]
    stats = counted.groupBy(*by).agg(F.sum("n").alias("total"), *counts, F.round(F.sum(F.col("v") * d) / F.sum(d), 6).alias("avg_ms"))
    top = stats.orderBy(F.desc("total"), *by).limit(200)
    found = percentiles(counted.select(*by, "v", "n"), by, {"p50_ms": 0.5, "p95_ms": 0.95}).select(F.col("actor").alias("_a"), F.col("queue").alias("_q"), F.round("p50_ms", 6).alias("p50_ms"), F.round("p95_ms", 6).alias("p95_ms"))
    return top.join(found, F.col("actor").eqNullSafe(F.col("_a")) & F.col("queue").eqNullSafe(F.col("_q")), "left").drop("_a", "_q").orderBy(F.desc("total"), *by)


_STATS = "select actor, queue, count(*) as total, {c}, round(avg(duration_ms), 6) as avg_ms, round(quantile_cont(duration_ms, 0.5), 6) as p50_ms, round(quantile_cont(duration_ms, 0.95), 6) as p95_ms from jobs_archive a left join {t} t on t.job_id = a.id group by actor, queue"
_C = ", ".join(f"count(*) filter (where status = '{s}') as n_{s}" for s in ("succeeded", "failed", "cancelled", "crashed"))
_count("agg12_actor_stats", _STATS.format(c=_C, t="job_attempts_archive"), lambda t: actor_stats(t.jobs_archive, t.job_attempts_archive))
_count("agg12_actor_stats_per_job", _STATS.format(c=_C, t="(select job_id, arg_max(duration_ms, attempt) as duration_ms from job_attempts_archive group by job_id)"), lambda t: actor_stats(t.jobs_archive, t.job_attempts_archive, True))


@query("agg13_success_rate", "select actor, case when d > 0 then round_even(100.0 * s / d, 1) end as success_rate from (select actor, count(*) filter (where status = 'succeeded') as s, count(*) filter (where status in ('succeeded','failed','crashed','abandoned')) as d from jobs group by actor)")
def agg13(t: Tables) -> DataFrame:
    s = t.jobs.groupBy("actor").agg(F.count_if(F.col("status") == "succeeded").alias("s"), F.count_if(F.col("status").isin("succeeded", "failed", "crashed", "abandoned")).alias("d"))
    return s.select("actor", F.when(F.col("d") > 0, F.bround(F.lit(100.0) * F.col("s") / F.col("d"), 1)).alias("success_rate"))


_count("agg14_total", "select count(*) as n from jobs where actor = 'view' and status = 'failed'", lambda t: t.jobs.filter(C.matches(actor="view", status="failed")).agg(F.count("*").alias("n")))
_count("agg15_archived_counts", "select actor, status, count(*) as n from jobs where finished_at < NOW - interval '10' day group by actor, status", lambda t: t.jobs.filter(C.older_than(F.col("finished_at"), NOW, 10 * 86400)).groupBy("actor", "status").agg(F.count("*").alias("n")))
_count("agg16_stranded_by_actor", "select j.actor, count(*) as n from jobs j where j.status in ('pending', 'scheduled') and not exists (select 1 from actor_config a where a.actor = j.actor) group by j.actor", lambda t: joi11(t).groupBy("actor").agg(F.count("*").alias("n")))
_count("agg17_disabled_schedules", "select count(*) as n from cron_schedules where not enabled", lambda t: t.cron_schedules.filter("not enabled").agg(F.count("*").alias("n")))
_count("agg18_telemetry", f"select actor, status as outcome, count(*) as consumed, least(cast(floor({_US} / 100000.0) as bigint), 20) as bucket from jobs where finished_at is not null group by 1, 2, 4", lambda t: t.jobs.filter("finished_at is not null").groupBy("actor", F.col("status").alias("outcome"), F.least(F.floor((C.micros(F.col("finished_at")) - C.micros(F.col("started_at"))) / 100000.0), F.lit(20)).alias("bucket")).agg(F.count("*").alias("consumed")))
_count("agg19_array_agg", "select queue, list_sort(list(distinct actor)) as actors from jobs group by queue", lambda t: t.jobs.groupBy("queue").agg(F.sort_array(F.collect_set("actor")).alias("actors")))
_count("agg20_window_count", "select bucket, count(*) as n, min(ts) as oldest from requests where ts > NOW - interval '1' day and ts <= NOW group by bucket", lambda t: t.requests.filter((F.col("ts") > C.moment(NOW) - C.seconds(86400)) & (F.col("ts") <= C.moment(NOW))).groupBy("bucket").agg(F.count("*").alias("n"), F.min("ts").alias("oldest")))
_count("agg21_distinct_queues", "select distinct queue from jobs", lambda t: t.jobs.select("queue").distinct())
_count("agg22_latest_duplicate", "select actor, identity_key, arg_max(id, created_at) as id from jobs where identity_key is not null group by actor, identity_key", lambda t: t.jobs.filter("identity_key is not null").groupBy("actor", "identity_key").agg(F.max_by("id", F.struct("created_at", "id")).alias("id")))
_count("ext_rollup", "select queue, status, count(*) as n from jobs group by rollup (queue, status)", lambda t: t.jobs.rollup("queue", "status").agg(F.count("*").alias("n")))

# Windows

_DISPATCH_ORDER = "priority desc, scheduled_at, id"


def _ranked(name: str, keys: str, spark_keys) -> None:
    @query(name, f"select id, row_number() over (partition by {keys} order by {_DISPATCH_ORDER}) as rn from jobs where status = 'pending'")
    def run(t: Tables, spark_keys=spark_keys) -> DataFrame:
        w = Window.partitionBy(*spark_keys()).orderBy(F.desc("priority"), "scheduled_at", "id")
        return t.jobs.filter("status = 'pending'").select("id", F.row_number().over(w).alias("rn"))


_ranked("win1_fairness_rank", "actor, queue, coalesce(fairness_key, '__null__')", lambda: ["actor", "queue", F.coalesce("fairness_key", F.lit("__null__"))])
_ranked("win2_pending_rank", "actor", lambda: ["actor"])


@query("win3_actor_rank", "select id, row_number() over (partition by actor order by fr, priority desc, scheduled_at, id) as rn from (select *, row_number() over (partition by actor, queue, coalesce(fairness_key, '__null__') order by priority desc, scheduled_at, id) as fr from jobs where status = 'pending')")
def win3(t: Tables) -> DataFrame:
    order = [F.desc("priority"), F.asc("scheduled_at"), F.asc("id")]
    rows = t.jobs.filter("status = 'pending'").withColumn("fr", F.row_number().over(Window.partitionBy("actor", "queue", F.coalesce("fairness_key", F.lit("__null__"))).orderBy(*order)))
    return rows.select("id", F.row_number().over(Window.partitionBy("actor").orderBy("fr", *order)).alias("rn"))


@query("win4_distinct_on", f"select id, actor, identity_key from (select *, row_number() over (partition by actor, identity_key order by {_DISPATCH_ORDER}) as n from jobs where status = 'pending' and identity_key is not null) where n = 1")
def win4(t: Tables) -> DataFrame:
    w = Window.partitionBy("actor", "identity_key").orderBy(F.desc("priority"), "scheduled_at", "id")
    return t.jobs.filter("status = 'pending' and identity_key is not null").withColumn("n", F.row_number().over(w)).filter("n = 1").select("id", "actor", "identity_key")


@query("win5_offered_load", "select bucket, request_id, count(*) over w as in_window, epoch_us(min(ts) over w) as oldest_us from requests window w as (partition by bucket order by ts range between interval '3599999999 microseconds' preceding and current row)")
def win5(t: Tables) -> DataFrame:
    from jobloom.operators.ratelimit import offered_load

    return offered_load(t.requests, 3600)


# Sorts


def _page(name: str, sql_order: str, order, limit: int = 50, where: str = "1 = 1") -> None:
    @query(name, f"select id, actor, status from jobs where {where} order by {sql_order} limit {limit}")
    def run(t: Tables, order=order, limit=limit, where=where) -> DataFrame:
        return t.jobs.filter(where).orderBy(*order()).limit(limit).select("id", "actor", "status")


_page("srt1_dispatch_order", "priority desc, scheduled_at asc, id asc", lambda: [F.desc("priority"), "scheduled_at", "id"])
_page("srt2_newest", "created_at desc, id asc", lambda: [F.desc("created_at"), "id"])
_page("srt3_finished", "finished_at desc nulls last, id asc", lambda: [F.desc_nulls_last("finished_at"), "id"])
_page("srt4_history", "case when status in ('pending','scheduled','running') then 0 else 1 end, finished_at desc nulls last, created_at desc, id desc", lambda: [C.status_rank(F.col("status")), F.desc_nulls_last("finished_at"), F.desc("created_at"), F.desc("id")], 51)
_page("srt5_by_column", "queue desc nulls last, id desc", lambda: [F.desc_nulls_last("queue"), F.desc("id")])
_page("srt11_queue_detail", "scheduled_at, id", lambda: ["scheduled_at", "id"], 101, "queue = 'q2'")


@query("srt5_by_state", "select id, status from jobs order by list_position(['pending','scheduled','running','succeeded','failed','cancelled','crashed','abandoned'], status), id limit 100")
def srt5b(t: Tables) -> DataFrame:
    return t.jobs.orderBy(C.state_order(F.col("status")), "id").limit(100).select("id", "status")


@query("srt6_reverse_page", "select id from (select id, created_at from jobs where (created_at, id) > (timestamp '2024-01-12 00:00:00', 5000) order by created_at, id limit 20) order by created_at desc, id desc")
def srt6(t: Tables) -> DataFrame:
    back = C.keyset(["created_at", "id"], ["2024-01-12 00:00:00", 5000], ["timestamp_ntz", "long"])
    return t.jobs.filter(back).orderBy("created_at", "id").limit(20).orderBy(F.desc("created_at"), F.desc("id")).select("id")


@query("srt9_oldest_batch", "select id from jobs where finished_at < NOW order by finished_at, id limit 200")
def srt9(t: Tables) -> DataFrame:
    return t.jobs.filter(F.col("finished_at") < C.moment(NOW)).orderBy("finished_at", "id").limit(200).select("id")


@query("srt10_lowest_free_slot", "select bucket_name, min(slot_index) as slot_index from reservation_slots where job_id is null or lease_expires_at < NOW group by bucket_name")
def srt10(t: Tables) -> DataFrame:
    from jobloom.plans.lifecycle import free_slots

    return free_slots(t.reservation_slots, NOW)


@query("srt12_workers_by_last_seen", "select id, hostname from workers order by last_seen_at desc, id limit 30")
def srt12(t: Tables) -> DataFrame:
    return t.workers.orderBy(F.desc("last_seen_at"), "id").limit(30).select("id", "hostname")


@query("srt13_top_actors", "select actor, queue, count(*) as total from jobs_archive group by actor, queue order by total desc, actor, queue limit 5")
def srt13(t: Tables) -> DataFrame:
    return t.jobs_archive.groupBy("actor", "queue").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "actor", "queue").limit(5)


# Sets

_H = "select id, actor, queue, status, created_at, finished_at, {a} as is_archived, case when status in ('pending','scheduled','running') then 0 else 1 end as status_priority from {t}"
_HIST = f"({_H.format(a='false', t='jobs')} union all {_H.format(a='true', t='jobs_archive')})"


def history(jobs: DataFrame, archive: DataFrame) -> DataFrame:
    side = lambda df, a: df.select("id", "actor", "queue", "status", "created_at", "finished_at", F.lit(a).alias("is_archived"), C.status_rank(F.col("status")).alias("status_priority"))
    return side(jobs, False).unionByName(side(archive, True))


@query("set1_history_first_page", f"select id, status, is_archived from {_HIST} order by status_priority, finished_at desc nulls last, created_at desc, id desc limit 51")
def set1(t: Tables) -> DataFrame:
    return history(t.jobs, t.jobs_archive).orderBy("status_priority", F.desc_nulls_last("finished_at"), F.desc("created_at"), F.desc("id")).limit(51).select("id", "status", "is_archived")


@query("set1_history_next_page", f"select id, status, is_archived from {_HIST} where (-status_priority, coalesce(finished_at, timestamp '0001-01-01 00:00:00'), created_at, id) < (-1, timestamp '2024-01-15 00:00:00', timestamp '2024-01-15 00:00:00', 100) order by status_priority, finished_at desc nulls last, created_at desc, id desc limit 51")
def set1_next(t: Tables) -> DataFrame:
    low = C.moment("0001-01-01 00:00:00")
    key = F.struct((-F.col("status_priority")).alias("a"), F.coalesce("finished_at", low).alias("b"), F.col("created_at").alias("c"), F.col("id").alias("d"))
    at = C.moment("2024-01-15 00:00:00")
    rows = history(t.jobs, t.jobs_archive).filter(key < F.struct(F.lit(-1).alias("a"), at.alias("b"), at.alias("c"), F.lit(100).cast("long").alias("d")))
    return rows.orderBy("status_priority", F.desc_nulls_last("finished_at"), F.desc("created_at"), F.desc("id")).limit(51).select("id", "status", "is_archived")


query("set2_summary_union", "select status, is_archived, count(*) as n from " + _HIST + " group by status, is_archived")(lambda t: history(t.jobs, t.jobs_archive).groupBy("status", "is_archived").agg(F.count("*").alias("n")))


@query("set3_identity_union", f"select id from (select id, row_number() over (partition by actor, identity_key order by {_DISPATCH_ORDER}) as n from jobs where status = 'pending' and identity_key is not null and (actor, identity_key) not in ({_BUSY})) where n = 1 union all select id from jobs where status = 'pending' and identity_key is null")
def set3(t: Tables) -> DataFrame:
    from jobloom.plans.dispatch import without_busy_identities

    return without_busy_identities(t.jobs.filter("status = 'pending'"), t.jobs).select("id")


@query("set5_slot_resize", """with sizes as (select * from (values (0, 3), (1, 7), (2, 5)) as v(b, n)), wanted as (select b, unnest(range(n)) as i from sizes)
  select b as bucket_name, i as slot_index, 'insert' as action from wanted where (b, i) not in (select bucket_name, slot_index from reservation_slots)
  union all select bucket_name, slot_index, case when job_id is null then 'delete' else 'keep_held' end from reservation_slots where bucket_name in (select b from sizes) and (bucket_name, slot_index) not in (select b, i from wanted)""")
def set5(t: Tables) -> DataFrame:
    from jobloom.plans.lifecycle import sync_slots

    return sync_slots(t.reservation_slots, t.spark.createDataFrame([(0, 3), (1, 7), (2, 5)], "bucket_name int, slots int"))


# Scalars


def _scalar(name: str, sql: str, *cols) -> None:
    @query(name, f"select id, {sql} from jobs")
    def run(t: Tables, cols=cols) -> DataFrame:
        return t.jobs.select("id", *[c() for c in cols])


_scalar("sca1_coalesce_greatest", "coalesce(identity_key, fairness_key, 'none') as k, greatest(attempt, priority) as g", lambda: F.coalesce("identity_key", "fairness_key", F.lit("none")).alias("k"), lambda: F.greatest("attempt", "priority").alias("g"))
_scalar("sca2_logical_clock", "epoch_us(NOW) - epoch_us(created_at) as age_us", lambda: (C.micros(C.moment(NOW)) - C.micros(F.col("created_at"))).alias("age_us"))
_scalar("sca3_interval", "created_at + attempt * interval '1' second as at", lambda: (F.col("created_at") + F.make_dt_interval(secs=F.col("attempt"))).alias("at"))
_scalar("sca4_epoch_ms", f"{_US} / 1000.0 as ms", lambda: C.duration_ms(F.col("started_at"), F.col("finished_at")).alias("ms"))
_scalar("sca5_round_cast", "cast(round(id / 8.0 + 0.0001) as bigint) as r", lambda: F.round(F.col("id") / 8.0 + 0.0001).cast("long").alias("r"))
_scalar("sca6_strings", "actor || '/' || queue as path, actor ilike 'V%' as v", lambda: F.concat("actor", F.lit("/"), "queue").alias("path"), lambda: F.col("actor").ilike("V%").alias("v"))
_scalar("sca8_json_access", """json_extract_string(payload, '$.k') as k, json_extract_string(payload, '$.k') is not null as has_k""", lambda: F.get_json_object("payload", "$.k").alias("k"), lambda: F.get_json_object("payload", "$.k").isNotNull().alias("has_k"))
_scalar("sca9_arrays", "list_contains(string_split(tag_list, ','), 'tag3') as has, len(string_split(tag_list, ',')) as n", lambda: F.array_contains(C.tags(F.col("tag_list")), "tag3").alias("has"), lambda: F.size(C.tags(F.col("tag_list"))).alias("n"))
_scalar("sca10_regex", "regexp_full_match(coalesce(identity_key, ''), 'u[0-9]{2}') as two", lambda: F.coalesce("identity_key", F.lit("")).rlike("^u[0-9]{2}$").alias("two"))
_THIRD = "case when id % 9 = 0 then 'a-b' when id % 9 = 1 then 'é_1' when id % 9 = 2 then '-ab' when id % 9 = 3 then 'ab' when id % 9 = 4 then 'a.b' when id % 9 = 5 then 'a--' when id % 9 = 6 then '---' when id % 9 = 7 then 'tag2' else repeat('x', cast(253 + id % 4 as int)) end"
_scalar(
    "sca11_tags_distinct",
    f"case when length({_THIRD}) <= 255 and regexp_full_match({_THIRD}, '[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_-]+[\\p{{L}}\\p{{N}}_]') then array_to_string(list_filter([split_part(tag_list, ',', 1), case when split_part(tag_list, ',', 2) <> split_part(tag_list, ',', 1) then split_part(tag_list, ',', 2) end, case when {_THIRD} not in (split_part(tag_list, ',', 1), split_part(tag_list, ',', 2)) then {_THIRD} end], lambda x: x is not null), ',') end as tags",
    lambda: F.array_join(C.clean_tags(F.concat(C.tags(F.col("tag_list")), F.array(F.expr(_THIRD)))), ",").alias("tags"),
)
_scalar("sca12_key_valid", "idempotency_key is not null and length(trim(idempotency_key)) > 0 and length(idempotency_key) <= 256 as ok", lambda: C.key_valid(F.col("idempotency_key")).alias("ok"))
_FINE = "scheduled_at + (id % 5) * interval '1207' microsecond"
_CURSOR = f"concat_ws('|', cast(priority as varchar), strftime({_FINE}, '%Y-%m-%dT%H:%M:%S') || case when epoch_us({_FINE}) % 1000000 = 0 then '' else strftime({_FINE}, '.%f') end, cast(id as varchar)) as cursor, {_FINE} as at"


def _cursor() -> Column:
    return C.cursor(F.col("priority"), F.expr(_FINE), F.col("id"))


_scalar("sca14_cursor", _CURSOR, lambda: _cursor().alias("cursor"), lambda: C.cursor_parts(_cursor())[1].alias("at"))
_scalar("sca16_result_bytes", "strlen(metadata) as n", lambda: C.result_bytes(F.col("metadata")).alias("n"))
_scalar("sca18_math", "least(cast(pow(2, attempt) as double), 5.0) as p, floor(id / 7) as f", lambda: F.least(F.pow(F.lit(2.0), "attempt"), F.lit(5.0)).alias("p"), lambda: F.floor(F.col("id") / 7).alias("f"))
_scalar("sca19_hex_ids", "lpad(lower(to_hex(id)), 16, '0') as trace", lambda: C.hex_id(F.col("id"), 16).alias("trace"))


#: Metadata with a number, a truth value, a nested object and different counts.
META = """concat('{"batch_id": "b', cast(id % 50 as varchar(9)), '", "n": 1.5, "o": {"a": [1, null, true]}, "on": true', case when id % 4 = 0 then '' when id % 4 = 1 then ', "snooze_count": 3' when id % 4 = 2 then ', "snooze_count": "7"' else ', "snooze_count": [1]' end, '}')"""


@query("sca7_json_merge", f"""select id, case when id % 3 = 0 then {META} when id % 3 = 1 then '{{"batch_id":"new","n":null,"o":{{"a":[1,null,true]}},"on":false' || case when id % 4 = 0 then '' when id % 4 = 1 then ',"snooze_count":3' when id % 4 = 2 then ',"snooze_count":"7"' else ',"snooze_count":[1]' end || '}}'
  else '{{"batch_id":"b' || (id % 50) || '","n":2,"o":7,"on":true' || case when id % 4 = 0 then '' when id % 4 = 1 then ',"snooze_count":3' when id % 4 = 2 then ',"snooze_count":"7"' else ',"snooze_count":[1]' end || ',"x":"1"}}' end as merged from (select id from jobs)""")
def sca7(t: Tables) -> DataFrame:
    right = F.when(F.col("id") % 3 == 1, '{"batch_id":"new","n":null,"on":false}').when(F.col("id") % 3 == 2, '{"x":"1","n":2,"o":7}')
    return t.jobs.select("id", C.merged(F.expr(META.replace("varchar(9)", "string")), right).alias("merged"))


@query("sca15_ordered_ids", """select id, substr(lpad(lower(to_hex(epoch_ms(NOW))), 12, '0'), 1, 8) || '-' || substr(lpad(lower(to_hex(epoch_ms(NOW))), 12, '0'), 9) || '-7000-8' || substr(lpad(lower(to_hex(id)), 16, '0'), 2, 3) || '-' || substr(lpad(lower(to_hex(id)), 16, '0'), 5) as surrogate,
  '00000' || array_to_string(list_transform([5, 4, 3, 2, 1, 0], lambda k: substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', cast((id * 1000 // cast(pow(62, k) as bigint)) % 62 as int) + 1, 1)), '') as short from jobs""")
def sca15(t: Tables) -> DataFrame:
    from jobloom.plans.enqueue import ids_from, short_ids

    return t.jobs.select("id", ids_from(NOW, F.col("id")).alias("surrogate"), short_ids(F.col("id") * 1000).alias("short"))


_CLOCK = "select p_partkey as id, concat(case when p_size % 7 = 0 then '' else '0' end, cast(p_size % 10 as varchar(9)), ':', cast(10 + p_partkey % 55 as varchar(9))) as s from part union all select p_partkey, concat(cast(10 + p_size % 20 as varchar(9)), ':0', cast(p_partkey % 10 as varchar(9))) from part"


@query("sca17_daily_cron", f"select id, s, case when regexp_full_match(s, '([01][0-9]|2[0-3]):[0-5][0-9]') then concat(cast(substr(s, 4, 2) as int), ' ', cast(substr(s, 1, 2) as int), ' * * *') end as cron from ({_CLOCK})")
def sca17(t: Tables) -> DataFrame:
    return t.sql(_CLOCK).select("id", "s", C.hhmm_cron(F.col("s")).alias("cron"))
