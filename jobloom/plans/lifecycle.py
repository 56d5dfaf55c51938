"""Prune, archive and expiry; slots; configuration and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.functions.columns import TERMINAL, moment, seconds, whole_number

#: Days that terminal rows stay, by state; crashed rows have the setting of abandoned ones.
RETENTION = {"succeeded": 30, "failed": 90, "cancelled": 30, "abandoned": 90, "crashed": 90}
ARCHIVE_DAYS = 365
DAY = 86_400


def retention_days(retention: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for state, days in retention.items():
        out = F.when(F.col("status") == state, days).otherwise(out)
    return out


def prunable(jobs: DataFrame, now, retention: dict[str, int] = RETENTION, overrides: DataFrame | None = None) -> DataFrame:
    """Terminal rows past their retention. An actor's override (actor, metadata.retention_days) holds if shorter."""
    rows = jobs.filter(F.col("status").isin(*TERMINAL)).withColumn("days", retention_days(retention))
    if overrides is not None:
        own = overrides.select("actor", whole_number(F.col("metadata"), "retention_days").alias("own_days")).filter("own_days is not null")
        rows = rows.join(own, "actor", "left").withColumn("days", F.least("days", "own_days"))
    return rows.filter(F.col("finished_at") < moment(now) - F.make_dt_interval(days=F.col("days")))


def archive(jobs: DataFrame, attempts: DataFrame, now, retention: dict[str, int] = RETENTION, overrides: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows that stay, rows that move with their times, attempts that move)."""
    gone = prunable(jobs, now, retention, overrides)
    moved = gone.select(*jobs.columns, moment(now).alias("archived_at"), (moment(now) + seconds(ARCHIVE_DAYS * DAY)).alias("expire_at"))
    ids = gone.select("id")
    return jobs.join(ids, "id", "left_anti"), moved, attempts.join(ids.withColumnRenamed("id", "job_id"), "job_id", "left_semi")


def expire(archived: DataFrame, attempts: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """What the archive keeps of rows and of their attempts."""
    kept = archived.filter(F.col("expire_at") >= moment(now))
    return kept, attempts.join(kept.select(F.col("id").alias("job_id")), "job_id", "left_semi")


def stale_workers(workers: DataFrame, now, beat: float = 10, failures: int = 3) -> DataFrame:
    return workers.filter(F.col("last_seen_at") < moment(now) - seconds(beat * (failures + 3)))


def ensure_slots(slots: DataFrame, bucket, n: int) -> DataFrame:
    """Slots 0 to n-1 of a bucket that aren't there."""
    made = slots.sparkSession.range(n).select(F.lit(bucket).alias("bucket_name"), F.col("id").cast("int").alias("slot_index"))
    return made.join(slots, ["bucket_name", "slot_index"], "left_anti")


def free_slots(slots: DataFrame, now) -> DataFrame:
    """The lowest slot of each bucket that is free or whose lease is over."""
    return slots.filter(F.col("job_id").isNull() | (F.col("lease_expires_at") < moment(now))).groupBy("bucket_name").agg(F.min("slot_index").alias("slot_index"))


def acquire_slots(slots: DataFrame, requests: DataFrame, now, lease: float) -> tuple[DataFrame, DataFrame]:
    """(slots that are taken, after it; outcome of each request (bucket_name, ordinal, slot_index or null)).

    Requests (bucket_name, ordinal, job_id, worker_id): in their order, each takes the lowest slot of its bucket that is
    free or whose lease is over. Requests beyond the largest number of free slots are left out before they are ranked.
    """
    free = slots.filter(F.col("job_id").isNull() | (F.col("lease_expires_at") < moment(now))).select("bucket_name", "slot_index")
    rank = lambda order: F.row_number().over(Window.partitionBy("bucket_name").orderBy(order))
    most = free.groupBy("bucket_name").count().agg(F.max("count")).first()[0] or 0
    first = requests.withColumn("turn", rank("ordinal")).filter(F.col("turn") <= F.lit(int(most)))
    met = first.join(free.withColumn("turn", rank("slot_index")), ["bucket_name", "turn"])
    taken = met.select("bucket_name", "slot_index", "job_id", F.col("worker_id").alias("held_by_worker_id"), (moment(now) + seconds(lease)).alias("lease_expires_at"), moment(now).alias("acquired_at"))
    return taken, requests.select("bucket_name", "ordinal").join(met.select("bucket_name", "ordinal", "slot_index"), ["bucket_name", "ordinal"], "left")


def release_held(slots: DataFrame, released: DataFrame) -> DataFrame:
    """Slots that are free after it: of (bucket_name, slot_index, worker_id) those that this worker holds."""
    own = released.select("bucket_name", "slot_index", F.col("worker_id").alias("held_by_worker_id"))
    met = slots.join(own, ["bucket_name", "slot_index", "held_by_worker_id"], "left_semi")
    gone = {"job_id", "held_by_worker_id", "lease_expires_at", "acquired_at"}
    return met.select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name in gone else F.col(f.name) for f in slots.schema])


def renew_slots(slots: DataFrame, jobs: DataFrame, worker, now, lease: float) -> DataFrame:
    """Slots of a worker whose jobs still run, with a new lease."""
    running = jobs.filter("status = 'running'").select(F.col("id").alias("job_id"))
    held = slots.filter(F.col("held_by_worker_id") == worker).join(running, "job_id", "left_semi").select(*slots.columns)
    return held.withColumn("lease_expires_at", moment(now) + seconds(lease))


def sync_slots(slots: DataFrame, sizes: DataFrame) -> DataFrame:
    """(bucket_name, slot_index, action): ``insert`` missing slots, ``delete`` free surplus, ``keep_held`` the rest."""
    wanted = sizes.filter("slots > 0").select("bucket_name", F.explode(F.sequence(F.lit(0), (F.col("slots") - 1).cast("int"))).alias("slot_index"))
    missing = wanted.join(slots, ["bucket_name", "slot_index"], "left_anti").withColumn("action", F.lit("insert"))
    extra = slots.join(sizes.select("bucket_name"), "bucket_name", "left_semi").join(wanted, ["bucket_name", "slot_index"], "left_anti")
    return missing.unionByName(extra.select("bucket_name", "slot_index", F.when(F.col("job_id").isNull(), "delete").otherwise("keep_held").alias("action")))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows in place of old ones with the same keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*old.columns))


def upsert_if_same(old: DataFrame, new: DataFrame, key: str, guard: str) -> DataFrame:
    """Like ``upsert``, but a row whose ``guard`` differs from the new one's stays as it is."""
    other = old.join(new.select(key, F.col(guard).alias("_guard")), key).filter(~F.col(guard).eqNullSafe(F.col("_guard"))).select(key)
    return upsert(old, new.join(other, key, "left_anti"), [key])


def register_workers(workers: DataFrame, new: DataFrame, now) -> DataFrame:
    """All workers after ``new`` (every column but ``last_seen_at``) have come or come again."""
    return upsert(workers, new.withColumn("last_seen_at", moment(now)), ["id"])


def deregister_workers(workers: DataFrame, ids: DataFrame) -> DataFrame:
    return workers.join(ids.select("id"), "id", "left_anti")


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    first = new.dropDuplicates(keys)
    return old.unionByName(first.select(*old.columns).join(old.select(*keys), keys, "left_anti"))


def drift(stored: DataFrame, registered: DataFrame, fields: list[str], key: str = "actor") -> DataFrame:
    """(key, field, stored, registered) of the fields that differ; nulls are equal to each other."""
    sides = [df.select(F.col(key), *[F.col(f).cast("string").alias(f"{name}_{f}") for f in fields]) for name, df in (("s", stored), ("r", registered))]
    both = sides[0].join(sides[1], key)
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"s_{f}").alias("stored"), F.col(f"r_{f}").alias("registered")) for f in fields]))
    return both.select(key, pairs.alias("x")).select(key, "x.*").filter("not (stored <=> registered)")


def fired(schedule_ok: Column, failures: Column, most: int = 5) -> tuple[Column, Column]:
    """(consecutive_failures, enabled) after a tick: success resets, the last failure allowed disables."""
    now = F.when(schedule_ok, 0).otherwise(failures + 1)
    return now, now < most
