"""Cron schedules: the tick and what can be done to a schedule by hand.

Schedules (id, actor, name, cron_expr, timezone, dst_strategy, enabled, consecutive_failures, next_fire_at,
payload_factory, payload). Each function reads the table once and gives the rows that it changes, whole, or the jobs
that it enqueues; ``lifecycle.upsert`` by id applies the former.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.columns import initial_status, moment, seconds
from jobloom.operators import cron
from jobloom.plans.enqueue import ids_from

#: Failures in a row that switch a schedule off, and seconds that a due time may lie back.
MOST_FAILURES = 5
CATCH_UP = 3600
STRATEGIES = ("skip", "firstof", "first", "allof")


class Tick(NamedTuple):
    rows: DataFrame
    jobs: DataFrame


def _with_history(schedules: DataFrame) -> DataFrame:
    for name, kind in (("last_fired_at", "timestamp_ntz"), ("last_fire_error", "string")):
        if name not in schedules.columns:
            schedules = schedules.withColumn(name, F.lit(None).cast(kind))
    return schedules


def _jobs(rows: DataFrame, at: Column, ordinal: Column, now) -> DataFrame:
    """Jobs of rows with ``queue`` and ``max_attempts`` of their actor and a ``made`` payload."""
    return rows.select(ids_from(now, ordinal).alias("job_id"), F.col("id").alias("schedule_id"), "actor", "queue", F.col("made").alias("payload"), "max_attempts", at.alias("scheduled_at"), initial_status(at, now).alias("status"))


def _resolved(rows: DataFrame, actor_config: DataFrame, now, factories: dict) -> DataFrame:
    """With the actor's configuration, the payload, and why there is none."""
    config = actor_config.select("actor", "queue", "max_attempts", F.lit(True).alias("known"))
    made = cron.payloads(rows.join(config, "actor", "left"), now, factories, "made", "made_error")
    return made.withColumn("error", F.when(F.col("known").isNull(), F.format_string("actor %s has no configuration", "actor")).otherwise(F.col("made_error")))


def tick(schedules: DataFrame, actor_config: DataFrame, now, factories: dict, catch_up: float = CATCH_UP, most_failures: int = MOST_FAILURES) -> Tick:
    """Fire what is due: rows after the tick, and the jobs enqueued.

    A due time further back than ``catch_up`` is skipped: the fire counts as the next one after now. Success clears
    the failures and moves ``next_fire_at`` to the fire after this one; an hour that a clock change repeats gives an
    ``allof`` schedule a second job at its second time. A failure (bad expression, unknown actor, factory that raises)
    is counted and keeps ``next_fire_at``; the last allowed one switches the schedule off.
    """
    due = _with_history(schedules).filter(F.col("enabled") & (F.col("next_fire_at") <= moment(now)))
    strategy = F.when(F.col("dst_strategy").isin(*STRATEGIES), F.col("dst_strategy")).otherwise("skip")
    after_now = F.get(cron.next_fire(F.col("cron_expr"), F.col("timezone"), moment(now), strategy), 0)
    fire = F.when(F.col("next_fire_at") < moment(now) - seconds(catch_up), after_now).otherwise(F.col("next_fire_at").cast("timestamp"))
    rows = due.withColumn("fire_at", fire).withColumn("nexts", cron.next_fire(F.col("cron_expr"), F.col("timezone"), F.col("fire_at"), strategy))
    rows = _resolved(rows, actor_config, now, factories)
    rows = rows.withColumn("error", F.when(F.col("nexts").isNull(), "invalid expression").otherwise(F.col("error")))
    good = F.col("error").isNull()
    failures = F.when(good, 0).otherwise(F.coalesce("consecutive_failures", F.lit(0)) + 1)
    changed = {
        "last_fired_at": F.when(good, moment(now)).otherwise(F.col("last_fired_at")),
        "last_fire_error": F.col("error"),
        "consecutive_failures": failures,
        "enabled": failures < most_failures,
        "next_fire_at": F.when(good, F.get("nexts", 0).cast("timestamp_ntz")).otherwise(F.col("next_fire_at")),
    }
    fired = rows.filter(good)
    twice = fired.filter((F.col("dst_strategy") == "allof") & (F.size("nexts") > 1))
    jobs = _jobs(fired, moment(now), F.col("id") * 2, now).unionByName(_jobs(twice, F.get("nexts", 1).cast("timestamp_ntz"), F.col("id") * 2 + 1, now))
    return Tick(rows.select(*[changed.get(c, F.col(c)).alias(c) for c in due.columns]), jobs)


def _checked(rows: DataFrame) -> DataFrame:
    problem = cron.schedule_problem(F.col("cron_expr"), F.col("timezone"), F.col("payload"), F.col("payload_factory"))
    found = rows.select(problem.alias("problem")).filter("problem is not null").first()
    if found:
        raise ValueError(found["problem"])
    return rows


def _after(rows: DataFrame, now) -> Column:
    return F.get(cron.next_fire(F.col("cron_expr"), F.col("timezone"), moment(now), F.coalesce("dst_strategy", F.lit("skip"))), 0).cast("timestamp_ntz")


def create(schedules: DataFrame, new: DataFrame, now) -> DataFrame:
    """The new rows (without ``next_fire_at`` and failures); an actor's name that is taken fails the whole call."""
    names = new.select("actor", "name")
    if not names.groupBy("actor", "name").count().filter("count > 1").select("actor", "name").unionByName(names.join(schedules, ["actor", "name"], "left_semi")).isEmpty():
        raise ValueError("a schedule of that name is there already")
    rows = _checked(new)
    return rows.withColumn("consecutive_failures", F.lit(0)).withColumn("next_fire_at", _after(rows, now)).select(*schedules.columns)


def update(schedules: DataFrame, changes: DataFrame, now) -> DataFrame:
    """Rows after partial changes (id and any of cron_expr, timezone, enabled, payload, payload_factory,
    clear_payload_factory): null leaves a field as it is. A new expression or zone gives a new ``next_fire_at``;
    enabling clears failures and the last error; a payload drops the factory and the other way round."""
    given = [c for c in changes.columns if c != "id"]
    met = _with_history(schedules).join(changes.select("id", *[F.col(c).alias(f"new_{c}") for c in given]), "id")
    new = lambda c: F.col(f"new_{c}") if c in given else F.lit(None)
    pick = lambda c, kind: F.coalesce(new(c).cast(kind), F.col(c))
    factory = F.when(F.coalesce(new("clear_payload_factory").cast("boolean"), F.lit(False)) | new("payload").isNotNull(), new("payload_factory").cast("string")).otherwise(pick("payload_factory", "string"))
    payload = F.when(new("payload_factory").isNotNull(), new("payload").cast("string")).otherwise(pick("payload", "string"))
    on = F.coalesce(new("enabled").cast("boolean"), F.lit(False))
    moved = new("cron_expr").isNotNull() | new("timezone").isNotNull()
    rows = met.withColumns({"payload_factory": factory, "payload": payload, "enabled": pick("enabled", "boolean"), "consecutive_failures": F.when(on, 0).otherwise(F.col("consecutive_failures")), "last_fire_error": F.when(~on, F.col("last_fire_error")), "cron_expr": pick("cron_expr", "string"), "timezone": pick("timezone", "string"), "_moved": moved})
    changed = _checked(rows.filter("_moved")).withColumn("next_fire_at", _after(rows, now))
    return changed.unionByName(rows.filter("not _moved")).select(*_with_history(schedules).columns)


def delete(schedules: DataFrame, ids: DataFrame) -> DataFrame:
    """What is left."""
    return schedules.join(ids.select("id"), "id", "left_anti")


def skip(schedules: DataFrame, ids: DataFrame, now) -> DataFrame:
    """Rows whose ``next_fire_at`` steps on, once at least, until it lies after now; null if it never does."""
    rows = schedules.join(ids.select("id"), "id", "left_semi")
    return rows.withColumn("next_fire_at", cron.skipped(F.col("cron_expr"), F.col("timezone"), F.col("next_fire_at"), moment(now)).cast("timestamp_ntz"))


def run_now(schedules: DataFrame, ids: DataFrame, actor_config: DataFrame, now, factories: dict) -> DataFrame:
    """Jobs of the schedules at once, enabled or not; the schedules stay as they are."""
    rows = _resolved(schedules.join(ids.select("id"), "id", "left_semi"), actor_config, now, factories)
    return _jobs(rows.filter("error is null"), moment(now), F.col("id") * 2, now)
