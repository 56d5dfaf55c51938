"""Queue tables derived from the benchmark tables.

Each derivation is one SELECT that Spark and DuckDB both run, so that a query and its SQL twin see the same rows.
``NOW`` is the logical clock; no operator reads the wall clock.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NOW = "2024-01-20 00:00:00"
_T = f"timestamp '{NOW}'"

BASE = "region nation customer supplier part orders lineitem events documents conversations".split()

_STATUS = (
    "case when event_id%97=0 then 'abandoned' when (event_id*7+user_id)%20<6 then 'pending' when (event_id*7+user_id)%20<9 then 'scheduled' when (event_id*7+user_id)%20<11 then 'running' "
    "when (event_id*7+user_id)%20<16 then 'succeeded' when (event_id*7+user_id)%20<18 then 'failed' when (event_id*7+user_id)%20<19 then 'cancelled' else 'crashed' end"
)

DERIVED: dict[str, str] = {
    "jobs0": f"select event_id, ts, user_id, event_type, value, props, {_STATUS} as status from events",
    "jobs1": "select *, ts + (event_id%600)*interval '1' second as scheduled_at, case when status not in ('pending','scheduled') then ts + (event_id%600+1)*interval '1' second end as started_at from jobs0",
    "jobs": """select event_id as id, event_type as actor, concat('q', cast(user_id%4 as varchar(9))) as queue, case when event_id%3=0 then concat('u', cast(user_id as varchar(19))) end as identity_key,
      case when event_id%5<>0 then concat('t', cast(user_id%7 as varchar(9))) end as fairness_key, cast(event_id%4 as int) as priority, status,
      case when status in ('pending','scheduled') then 0 else cast(1+event_id%3 as int) end as attempt, 3 as max_attempts,
      case when event_id%10<7 then 'transient' when event_id%10<9 then 'indefinite' else 'non_retryable' end as retry_kind, ts as created_at, scheduled_at, started_at,
      case when status not in ('pending','scheduled','running') then started_at + cast(floor(value*1000) as bigint)*interval '1' millisecond end as finished_at,
      case when event_id%4=0 then ts + (1+event_id%10)*interval '1' day end as schedule_to_close,
      case when status='running' then started_at + interval '60' second end as lock_expires_at, props as payload,
      concat('{"batch_id": "b', cast(user_id%50 as varchar(9)), '"}') as metadata, concat('tag', cast(event_id%5 as varchar(9)), ',', 'tag', cast(event_id%7 as varchar(9))) as tag_list,
      case when status='running' then user_id%100 end as locked_by_worker, case when status='running' then cast(event_id%3 as int) else 0 end as cancel_phase, case when status='succeeded' and event_id%6<>0 then props end as result,
      case when event_id%2=0 then concat('k', cast(event_id as varchar(19))) end as idempotency_key from jobs1""",
    "jobs_archive": """select o_orderkey as id, o_orderpriority as actor, o_orderstatus as queue, o_orderdate as created_at,
      case when o_orderkey%10<7 then 'succeeded' when o_orderkey%10=7 then 'failed' when o_orderkey%10=8 then 'cancelled' else 'crashed' end as status,
      o_orderdate + (o_orderkey%5000)*interval '1' second as finished_at from orders""",
    "job_attempts_archive": """select l_orderkey as job_id, cast(row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice,l_shipdate) as int) as attempt,
      cast(floor(l_quantity*100) as bigint) as duration_ms, l_shipdate as started_at from lineitem""",
    "job_attempts": """select id as job_id, attempt, started_at, finished_at, case when status='running' then null when status in ('abandoned','cancelled') then 'cancelled' else status end as outcome, locked_by_worker as worker_id
      from jobs where status not in ('pending','scheduled')""",
    "job_events": """select id*3 as id, id as job_id, created_at as occurred_at, 'state_change' as kind, cast(null as varchar(19)) as from_state, 'pending' as to_state from jobs
      union all select id*3+1, id, started_at, 'state_change', 'pending', 'running' from jobs where started_at is not null
      union all select id*3+2, id, finished_at, 'state_change', 'running', status from jobs where finished_at is not null""",
    "workers": f"""select s_suppkey as id, s_name as hostname, concat('q', cast(s_suppkey%4 as varchar(9)), ',q', cast((s_suppkey*3)%5 as varchar(9))) as queue_list, {_T} - (s_suppkey%90)*interval '1' second as last_seen_at,
      concat('g', cast(s_nationkey%5 as varchar(9))) as workgroup_instance, concat('w', cast(s_suppkey%3 as varchar(9))) as worker_label, s_nationkey*7 as pid from supplier""",
    "maintenance_leader": f"select min(s_suppkey) + 6 as worker_id, {_T} - interval '60' minute as elected_at, {_T} - interval '3' second as last_seen_at from supplier",
    "actor_config": """select event_type as actor, case event_type when 'click' then 50 when 'purchase' then 10 when 'signup' then 0 end as max_concurrent, case event_type when 'click' then 20000 when 'purchase' then 400 when 'signup' then 10 end as max_pending,
      case event_type when 'click' then 'q0' when 'view' then 'q1' when 'purchase' then 'q2' else 'q3' end as queue, case event_type when 'purchase' then 5 when 'signup' then 1 else 3 end as max_attempts,
      case event_type when 'click' then 3600.0 when 'purchase' then 60.0 end as result_ttl from (select distinct event_type from events where event_type <> 'error')""",
    "queues": "select distinct concat('q', cast(s_suppkey%4 as varchar(9))) as name, case when s_suppkey%4=0 then 'strict_fifo' else 'round_robin' end as mode from supplier where s_suppkey%4<>2",
    "reservation_slots": f"""select n_regionkey as bucket_name, cast(row_number() over (partition by n_regionkey order by n_nationkey)-1 as int) as slot_index, case when n_nationkey%3<>0 then n_nationkey end as job_id,
      case when n_nationkey%3<>0 then cast(n_nationkey%4 as bigint) end as held_by_worker_id, {_T} + (n_nationkey-12)*interval '1' minute as lease_expires_at from nation""",
    "requests": "select event_type as bucket, ts, event_id as request_id from events",
    "progress": """select conv_id as job_id, turn as seq, text as detail, role as status, turn = max(turn) over (partition by conv_id) as terminal from conversations""",
    # A schedule for each part: every few minutes, daily, weekly and monthly ones, some of them broken or of an unknown actor.
    "cron_schedules": f"""select cast(p_partkey as int) as id, case when p_partkey%89=0 then 'nobody' when p_partkey%5=1 then 'view' when p_partkey%5=2 then 'purchase' when p_partkey%5=3 then 'signup' else 'click' end as actor, concat('s', cast(p_partkey as varchar(9))) as name,
      case when p_partkey%97=0 then 'not a cron' when p_size%4=0 then concat('*/', cast(5*(1+p_partkey%4) as varchar(9)), ' * * * *') when p_size%4=1 then concat(cast(p_partkey%60 as varchar(9)), ' ', cast(3+p_size%20 as varchar(9)), ' * * *')
        when p_size%4=2 then concat(cast(p_partkey%60 as varchar(9)), ' ', cast(3+p_size%20 as varchar(9)), ' * * ', cast(p_partkey%7 as varchar(9))) else concat(cast(p_partkey%60 as varchar(9)), ' ', cast(3+p_size%20 as varchar(9)), ' ', cast(1+p_partkey%28 as varchar(9)), ' * *') end as cron_expr,
      case p_partkey%4 when 0 then 'UTC' when 1 then 'America/New_York' when 2 then 'Europe/Berlin' else 'Asia/Kolkata' end as timezone, case p_partkey%3 when 0 then 'skip' when 1 then 'first' else 'allof' end as dst_strategy, p_partkey%11<>0 as enabled,
      cast(p_partkey%3 as int) as consecutive_failures, {_T} + (p_partkey%7-4)*interval '30' minute as next_fire_at, case when p_partkey%13=0 then 'tests.payloads:daily' end as payload_factory,
      case when p_partkey%13<>0 and p_partkey%2=0 then concat('{{"a": ', cast(p_partkey as varchar(9)), '}}') end as payload from part""",
}


def _used(text: str, names) -> set[str]:
    return {n for n in names if re.search(rf"\b{n}\b", text)}


def with_tables(sql: str) -> str:
    """``sql`` after the derivations that it uses, as one statement."""
    wanted, todo = set(), [sql]
    while todo:
        for n in _used(todo.pop(), DERIVED) - wanted:
            wanted.add(n)
            todo.append(DERIVED[n])
    parts = [f"{n} as ({DERIVED[n]})" for n in DERIVED if n in wanted]
    body = sql.strip()
    if body[:5].lower() == "with " and parts:
        rest = body[5:]
        recursive = rest[:10].lower() == "recursive "
        return f"with {'recursive ' if recursive else ''}{', '.join(parts)}, {rest[10:] if recursive else rest}"
    return f"with {', '.join(parts)} {body}" if parts else body


class Tables:
    """The derived tables of one folder as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """A query over base and derived tables; frames are passed in, no view is registered."""
        whole = with_tables(text)
        used = _used(whole, BASE)
        spaced = re.sub(r"[{}]", lambda m: m[0] * 2, whole) if used else whole  # names are filled in only if there are any
        for n in used:
            spaced = re.sub(rf"\b(from|join) {n}\b", rf"\1 {{{n}}}", spaced)
        return self.spark.sql(spaced.replace("varchar(9)", "string").replace("varchar(19)", "string").replace("varchar(99)", "string"), **{n: self.base(n) for n in used})

    def __getattr__(self, name: str) -> DataFrame:
        if name not in DERIVED:
            raise AttributeError(name)
        made = self.__dict__["_made"]
        if name not in made:
            made[name] = self.sql(f"select * from {name}")
        return made[name]
