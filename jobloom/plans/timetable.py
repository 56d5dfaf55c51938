"""Queries over schedules: next fires, clock changes, ticks and what is done by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.functions import columns as C
from jobloom.operators import cron
from jobloom.plans import lifecycle, schedules
from jobloom.plans.registry import query
from jobloom.sources.fixtures import NOW, Tables

#: Ids that somebody changes.
_PICKED = "select cast(p_partkey as int) as id from part where p_size > 25"
_AFTER = ["id", "cron_expr", "enabled", "consecutive_failures", "next_fire_at", "payload", "payload_factory"]


def _next(source: str, after: str, name: str) -> str:
    """``source`` with the first fire after a moment of each row, worked out from the kinds of expression that the schedules have."""
    at = "f[2]::int * interval 1 hour + f[1]::int * interval 1 minute"
    local = f"""case when cron_expr like '*/%' then date_trunc('hour', loc) + (minute(loc) // substr(f[1], 3)::int + 1) * substr(f[1], 3)::int * interval 1 minute
      when f[3] <> '*' then case when date_trunc('month', loc) + (f[3]::int - 1) * interval 1 day + {at} > loc then date_trunc('month', loc) else date_trunc('month', loc) + interval 1 month end + (f[3]::int - 1) * interval 1 day + {at}
      when f[5] <> '*' then date_trunc('day', loc) + {at} + ((f[5]::int - dayofweek(loc) + 7) % 7 + case when f[5]::int = dayofweek(loc) and date_trunc('day', loc) + {at} <= loc then 7 else 0 end) * interval 1 day
      else date_trunc('day', loc) + {at} + case when date_trunc('day', loc) + {at} <= loc then interval 1 day else interval 0 day end end"""
    return f"select * exclude (loc, f), case when cron_expr <> 'not a cron' then timezone('UTC', timezone(timezone, {local})) end as {name} from (select *, timezone(timezone, timezone('UTC', {after})) as loc, string_split(cron_expr, ' ') as f from {source})"


def _fires(t: Tables, strategy: str | None = None) -> DataFrame:
    at = cron.next_fire(F.col("cron_expr"), F.col("timezone"), C.moment(NOW), F.col("dst_strategy") if strategy is None else F.lit(strategy))
    return t.cron_schedules.select("id", F.transform(at, lambda x: x.cast("timestamp_ntz")).alias("fires"))


query("cr1_next_fire", f"select id, fire_at from ({_next('cron_schedules', 'NOW', 'fire_at')})")(lambda t: _fires(t).select("id", F.get("fires", 0).alias("fire_at")))

_DAYS = "select distinct cast(o_orderdate as date) as d from orders"
_KINDS = "(values ('gap', '30 2 * * *', 'skip', 150), ('overlap', '30 1 * * *', 'firstof', 90), ('allof', '30 1 * * *', 'allof', 90)) as k(k, e, s, m)"
_NY = "'America/New_York'"


@query("cr2_clock_changes", f"""with x as (select k, d, (d + interval 1 day) + m * interval 1 minute as l, m from ({_DAYS}), {_KINDS}),
  y as (select *, case when timezone({_NY}, timezone({_NY}, l)) = l then l else l + interval 1 day end as v from x),
  z as (select *, timezone('UTC', timezone({_NY}, v)) as u from y),
  w as (select *, list_filter([u - interval 1 hour, u, u + interval 1 hour], lambda c: timezone({_NY}, timezone('UTC', c)) = v) as us from z)
  select k, d, case when k = 'allof' then len(us) else 1 end as n, us[1] as fire_at from w""")
def cr2(t: Tables) -> DataFrame:
    """Fires after noon of every day on which something was ordered, in a zone that changes its clocks."""
    kinds = t.spark.createDataFrame([("gap", "30 2 * * *", "skip"), ("overlap", "30 1 * * *", "firstof"), ("allof", "30 1 * * *", "allof")], "k string, e string, s string")
    rows = t.sql(_DAYS).crossJoin(F.broadcast(kinds))  # three rows
    at = cron.next_fire(F.col("e"), F.lit("America/New_York"), F.col("d").cast("timestamp_ntz") + F.expr("interval 18 hours"), F.col("s"))
    return rows.select("k", "d", F.size(at).cast("long").alias("n"), F.get(at, 0).cast("timestamp_ntz").alias("fire_at"))


_MADE = """case when payload_factory is not null then '{"day": 20, "job": ' || id || '}' else coalesce(payload, '{}') end"""
query("cr3_schedule_problems", "select id, case when cron_expr = 'not a cron' then 'invalid expression' end as problem from cron_schedules")(lambda t: t.cron_schedules.select("id", cron.schedule_problem(F.col("cron_expr"), F.col("timezone"), F.col("payload"), F.col("payload_factory")).alias("problem")))
query("cr4_payloads", f"select id, {_MADE} as payload from cron_schedules")(lambda t: cron.payloads(t.cron_schedules, NOW, _FACTORIES).select("id", "payload"))
query("udf6_payload_factory", "select id, case when payload_factory is not null then '{\"day\": 1}' else coalesce(payload, '{}') end as payload from cron_schedules")(lambda t: cron.payloads(t.cron_schedules, NOW, {"tests.payloads:daily": lambda schedule, now: {"day": 1}}).select("id", "payload"))
query("dml29_missed_schedules", "select id, next_fire_at < NOW - interval '3600' second as missed from cron_schedules where enabled and next_fire_at <= NOW")(lambda t: t.cron_schedules.filter(F.col("enabled") & (F.col("next_fire_at") <= C.moment(NOW))).select("id", (F.col("next_fire_at") < C.moment(NOW) - C.seconds(3600)).alias("missed")))

# By hand

_NEW = "select cast(s_suppkey + 10000000 as int) as id, 'view' as actor, concat('n', cast(s_suppkey as varchar(9))) as name, concat(cast(s_suppkey % 60 as varchar(9)), ' ', cast(3 + s_nationkey % 20 as varchar(9)), ' * * ', case when s_suppkey % 2 = 0 then '*' else cast(s_suppkey % 7 as varchar(9)) end) as cron_expr, 'Europe/Berlin' as timezone, 'skip' as dst_strategy, true as enabled, cast(null as varchar(99)) as payload_factory, '{}' as payload from supplier"
_CHANGES = f"select id, case when id % 3 = 0 then '0 6 * * *' end as cron_expr, case when id % 3 = 1 then id % 2 = 0 end as enabled, case when id % 3 = 2 then '{{\"b\": 2}}' end as payload, case when id % 6 = 1 then 'f:g' end as payload_factory from ({_PICKED})"
_UPDATED = f"""select s.id, coalesce(c.cron_expr, s.cron_expr) as cron_expr, s.timezone, coalesce(c.enabled, s.enabled) as enabled, case when c.enabled then 0 else consecutive_failures end as consecutive_failures, s.next_fire_at, c.cron_expr is not null as moved,
  case when c.payload_factory is not null then null else coalesce(c.payload, s.payload) end as payload, case when c.payload is not null then null else coalesce(c.payload_factory, s.payload_factory) end as payload_factory from cron_schedules s join ({_CHANGES}) c on s.id = c.id"""


def _update(t: Tables) -> DataFrame:
    return schedules.update(t.cron_schedules, t.sql(_CHANGES), NOW)


query("dml28_create_schedule", f"select id, name, 0 as consecutive_failures, next_fire_at from ({_next(f'({_NEW})', 'NOW', 'next_fire_at')})")(lambda t: schedules.create(t.cron_schedules, t.sql(_NEW), NOW).select("id", "name", "consecutive_failures", "next_fire_at"))
query("dml28_update_schedule", f"select id, cron_expr, enabled, consecutive_failures, case when moved then nf else next_fire_at end as next_fire_at, payload, payload_factory from ({_next(f'({_UPDATED})', 'NOW', 'nf')})")(lambda t: _update(t).select(*_AFTER))
query("dml28_enable_schedule", f"select s.id, coalesce(u.enabled, s.enabled) as enabled, coalesce(u.consecutive_failures, s.consecutive_failures) as consecutive_failures from cron_schedules s left join ({_UPDATED}) u on s.id = u.id")(lambda t: lifecycle.upsert(t.cron_schedules.select(*_AFTER), _update(t).select(*_AFTER), ["id"]).select("id", "enabled", "consecutive_failures"))
query("dml28_delete_schedule", f"select id from cron_schedules where id not in ({_PICKED})")(lambda t: schedules.delete(t.cron_schedules, t.sql(_PICKED)).select("id"))
query("dml28_skip_schedule", f"select id, skipped as next_fire_at from ({_next('cron_schedules', 'greatest(next_fire_at, NOW)', 'skipped')}) where id in ({_PICKED})")(lambda t: schedules.skip(t.cron_schedules, t.sql(_PICKED), NOW).select("id", "next_fire_at"))
query("dml28_run_schedule", f"select id as schedule_id, s.actor, c.queue, {_MADE} as payload, NOW as scheduled_at, 'pending' as status from cron_schedules s join actor_config c on s.actor = c.actor")(lambda t: schedules.run_now(t.cron_schedules, t.cron_schedules, t.actor_config, NOW, _FACTORIES).select("schedule_id", "actor", "queue", "payload", "scheduled_at", "status"))


def _factory(schedule: int, now) -> dict:
    return {"day": now.day, "job": schedule}


_FACTORIES = {"tests.payloads:daily": _factory}


# The tick


def _tick(t: Tables) -> schedules.Tick:
    return schedules.tick(t.cron_schedules, t.actor_config, NOW, _FACTORIES, most_failures=3)


_FIRED = _next("(select *, case when next_fire_at < NOW - interval 1 hour then soon else next_fire_at end as fire_at from (" + _next("(select * from cron_schedules where enabled and next_fire_at <= NOW)", "NOW", "soon") + "))", "fire_at", "nf")
_GOOD = "cron_expr <> 'not a cron' and actor <> 'nobody'"
query("dml29_cron_tick", f"""select id, case when {_GOOD} then true else consecutive_failures + 1 < 3 end as enabled, case when {_GOOD} then 0 else consecutive_failures + 1 end as consecutive_failures, case when {_GOOD} then nf else next_fire_at end as next_fire_at, case when {_GOOD} then NOW end as last_fired_at,
  case when cron_expr = 'not a cron' then 'invalid expression' when actor = 'nobody' then 'actor nobody has no configuration' end as last_fire_error from ({_FIRED})""")(lambda t: _tick(t).rows.select("id", "enabled", "consecutive_failures", "next_fire_at", "last_fired_at", "last_fire_error"))
query("dml29_cron_jobs", f"select s.id as schedule_id, s.actor, c.queue, {_MADE} as payload, cast(c.max_attempts as int) as max_attempts, NOW as scheduled_at, 'pending' as status from cron_schedules s join actor_config c on s.actor = c.actor where enabled and next_fire_at <= NOW and cron_expr <> 'not a cron'")(lambda t: _tick(t).jobs.drop("job_id"))


@query("dml29_cron_failures", "select id, case when id % 2 = 0 then 0 else consecutive_failures + 1 end as consecutive_failures, case when id % 2 = 0 then true else consecutive_failures + 1 < 3 end as enabled from cron_schedules where enabled and next_fire_at <= NOW")
def dml29(t: Tables) -> DataFrame:
    failures, enabled = lifecycle.fired(F.col("id") % 2 == 0, F.col("consecutive_failures"), 3)
    return t.cron_schedules.filter(F.col("enabled") & (F.col("next_fire_at") <= C.moment(NOW))).select("id", failures.alias("consecutive_failures"), enabled.alias("enabled"))
