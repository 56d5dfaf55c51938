"""Fair, capped dispatch selection as one plan of windows over candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.functions.columns import due, moment, seconds

NO_FAIRNESS = "__null__"
#: Configured actors up to which their capacities are broadcast; beyond it Spark chooses the join.
MOST_BROADCAST = 100_000


def resolved_modes(queues: DataFrame, names: list[str]) -> DataFrame:
    """(name, mode) of the asked-for queues, duplicates once; queues without a row are strict FIFO."""
    asked = queues.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(names)], "name string")
    return asked.join(queues.select("name", "mode"), "name", "left").withColumn("mode", F.coalesce("mode", F.lit("strict_fifo")))


def capacity(jobs: DataFrame, actor_config: DataFrame, limit: int) -> DataFrame:
    """(actor, max_concurrent, in_flight, residual): free places per configured actor."""
    running = jobs.filter("status = 'running'").groupBy("actor").agg(F.count("*").alias("in_flight"))
    cap = actor_config.select("actor", "max_concurrent").join(running, "actor", "left").withColumn("in_flight", F.coalesce("in_flight", F.lit(0)))
    free = F.when(F.col("max_concurrent").isNull(), F.lit(limit)).otherwise(F.greatest(F.col("max_concurrent") - F.col("in_flight"), F.lit(0)))
    return cap.withColumn("residual", free.cast("long"))


def _order() -> list[Column]:
    return [F.desc("priority"), F.asc("scheduled_at"), F.asc("id")]


def candidates(jobs: DataFrame, cap: DataFrame, queues: list[str], limit: int, now, oversample: int, fair: bool, most_residual: int, few_actors: bool) -> DataFrame:
    """Due rows within ``residual * oversample`` of each (actor, queue), or of each fairness cohort in it.

    ``most_residual`` bounds every residual. The bound as a literal lets Spark cut each group before the shuffle, so
    that a hot actor sends no more rows than it can use.
    """
    open_caps = cap.filter("residual > 0").select("actor", "max_concurrent", "in_flight", "residual")
    if few_actors:
        open_caps = F.broadcast(open_caps)
    rows = jobs.filter(due(now) & F.col("queue").isin(*dict.fromkeys(queues))).join(open_caps, "actor")
    keys = ["actor", "queue"]
    if fair:
        rows = rows.withColumn("cohort", F.coalesce("fairness_key", F.lit(NO_FAIRNESS)))
        keys.append("cohort")
    rows = rows.withColumn("fairness_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*_order())))
    rows = rows.filter(F.col("fairness_rank") <= most_residual * oversample).filter(F.col("fairness_rank") <= F.col("residual") * oversample)
    return rows if fair else rows.withColumn("fairness_rank", F.lit(0))


def without_busy_identities(rows: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row for each (actor, identity) that isn't running already; rows without identity stay.

    Rows without identity never match the anti join, and each is a group of its own in the window, so that one pass
    does for both kinds.
    """
    busy = jobs.filter("status = 'running' and identity_key is not null").select("actor", "identity_key").distinct()
    own = F.when(F.col("identity_key").isNull(), F.col("id"))
    ranked = rows.join(busy, ["actor", "identity_key"], "left_anti").withColumn("nth", F.row_number().over(Window.partitionBy("actor", "identity_key", own).orderBy(*_order())))
    return ranked.filter("nth = 1").drop("nth")


def dispatch(jobs: DataFrame, actor_config: DataFrame, queues: list[str], limit: int, now, oversample: int = 2, round_robin: bool = False) -> DataFrame:
    """The rows that a worker may claim, with ``pending_rank`` and ``fairness_rank``.

    No queues, no rows; actors without configuration are never dispatched. The limit holds before the actors' caps
    as well, so with low caps fewer rows than the limit may come back although others would do.
    """
    if not queues:
        return jobs.limit(0).select("id", "actor", "queue", "priority", "scheduled_at", "attempt", F.lit(0).alias("pending_rank"), F.lit(0).alias("fairness_rank"))
    cap = capacity(jobs, actor_config, limit)
    top, actors = actor_config.agg(F.max("max_concurrent"), F.count("*")).first()
    rows = candidates(jobs, cap, queues, limit, now, oversample, round_robin, max(limit, top or 0), actors <= MOST_BROADCAST)
    rows = without_busy_identities(rows, jobs)
    fair = [F.asc("fairness_rank")] if round_robin else []
    rows = rows.withColumn("pending_rank", F.row_number().over(Window.partitionBy("actor").orderBy(*fair, *_order())))
    locked = rows.orderBy("pending_rank", *_order()).limit(limit)
    locked = locked.withColumn("actor_rank", F.row_number().over(Window.partitionBy("actor").orderBy(*fair, *_order())))
    fits = F.col("max_concurrent").isNull() | (F.col("actor_rank") <= F.col("max_concurrent") - F.col("in_flight"))
    return locked.filter(fits).orderBy("pending_rank", F.asc_nulls_last("fairness_rank"), *_order()).limit(limit).select("id", "actor", "queue", "priority", "scheduled_at", "attempt", "pending_rank", "fairness_rank")


def claimed(selected: DataFrame, worker: int, now, lease: float) -> DataFrame:
    """The selected rows as running: one more attempt, a lease, and the owner."""
    return selected.select("id", "actor", "queue", F.lit("running").alias("status"), (F.col("attempt") + 1).alias("attempt"), F.lit(worker).cast("long").alias("locked_by_worker"), moment(now).alias("started_at"), (moment(now) + seconds(lease)).alias("lock_expires_at"))
