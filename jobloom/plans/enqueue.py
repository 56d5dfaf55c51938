"""Enqueueing as set operations. Requests carry an ordinal; earlier requests of a set come before later ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.functions.columns import initial_status, json_true, micros, moment, recent, seconds


#: Ordinals that one task counts through.
BLOCK = 1 << 15


def _keyed(rows: DataFrame, jobs: DataFrame) -> DataFrame:
    """With the job that has a request's key and the first ordinal that asks for it. Requests without a key are spread
    over all tasks; a key that very many ask for is one row on the other side."""
    slot = F.coalesce("idempotency_key", F.concat(F.lit("\0"), F.col("ordinal").cast("string")))
    known = jobs.filter("idempotency_key is not null").select(F.col("idempotency_key").alias("_slot"), F.col("id").alias("existing_id"))
    firsts = rows.filter("idempotency_key is not null").groupBy(F.col("idempotency_key").alias("_slot")).agg(F.min("ordinal").alias("first_ordinal"))
    return rows.withColumn("_slot", slot).join(firsts.join(known, "_slot", "left"), "_slot", "left").drop("_slot")


def _before(rows: DataFrame, flag: Column, name: str) -> DataFrame:
    """How many earlier requests of the actor have the flag: counts of blocks of ordinals, then within the block, so
    that an actor with most of the requests is shared out."""
    rows = rows.withColumn("_flag", F.coalesce(flag, F.lit(False)).cast("long")).withColumn("_block", F.floor(F.col("ordinal") / BLOCK))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("actor", "_block").agg(F.sum("_flag").alias("_n"))
    sums = sums.select("actor", "_block", F.coalesce(F.sum("_n").over(earlier(Window.partitionBy("actor").orderBy("_block"))), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum("_flag").over(earlier(Window.partitionBy("actor", "_block").orderBy("ordinal"))), F.lit(0))
    met = rows.withColumn("_inside", inside).join(sums, ["actor", "_block"])
    return met.withColumn(name, F.col("_inside") + F.col("_base")).drop("_flag", "_block", "_inside", "_base")


def enqueue(jobs: DataFrame, requests: DataFrame, actor_config: DataFrame, now, unique_for: float | None = None, unique_states: tuple = ("pending", "scheduled", "running")) -> DataFrame:
    """An outcome for each request: ``unique``, ``singleton``, ``max_pending``, ``existing`` or ``inserted``.

    Requests (ordinal, actor, identity_key, idempotency_key, scheduled_at, metadata). Checks in this order, the first
    that applies decides. A known idempotency key doesn't bypass the cap. Requests count against the cap and against
    keys of later ones in the set.
    """
    rows = requests
    if unique_for is not None:
        same = jobs.filter(recent(now, unique_for, list(unique_states)) & F.col("identity_key").isNotNull()).groupBy("actor", "identity_key").agg(F.max_by("id", F.struct("created_at", "id")).alias("unique_id"))
        # Requests without identity are spread over all tasks, under slots that no job has.
        slot = lambda key: F.struct(F.coalesce(key, F.lit("")).alias("key"), F.when(key.isNull(), F.col("ordinal")).otherwise(-1).alias("n"))
        known = same.select("actor", F.struct(F.col("identity_key").alias("key"), F.lit(-1).cast(dict(rows.dtypes)["ordinal"]).alias("n")).alias("_slot"), "unique_id")
        rows = rows.withColumn("_slot", slot(F.col("identity_key"))).join(known, ["actor", "_slot"], "left").drop("_slot")
    else:
        rows = rows.withColumn("unique_id", F.lit(None).cast("long"))
    single = jobs.filter(F.col("status").isin("pending", "scheduled", "running") & json_true(F.col("metadata"), "singleton")).select("actor").distinct().withColumn("taken", F.lit(True))
    rows = rows.join(single, "actor", "left").withColumn("wants_single", json_true(F.col("metadata"), "singleton"))
    waiting = jobs.filter(F.col("status").isin("pending", "scheduled")).groupBy("actor").agg(F.count("*").alias("waiting"))
    limits = actor_config.select("actor", "max_pending").join(waiting, "actor", "left")
    rows = rows.join(limits, "actor", "left").withColumn("waiting", F.coalesce("waiting", F.lit(0)))
    rows = _keyed(rows, jobs).withColumn("first_key", F.col("idempotency_key").isNull() | (F.col("first_ordinal") == F.col("ordinal")))
    rows = _before(rows, F.col("wants_single"), "singles_before")
    rows = rows.withColumn("single_hit", F.col("wants_single") & (F.coalesce("taken", F.lit(False)) | (F.col("singles_before") > 0)))
    fresh = F.col("unique_id").isNull() & ~F.col("single_hit") & F.col("existing_id").isNull() & F.col("first_key")
    rows = _before(rows, fresh, "before")
    full = F.col("max_pending").isNotNull() & (F.col("waiting") + F.col("before") >= F.col("max_pending"))
    outcome = F.when(F.col("unique_id").isNotNull(), "unique").when(F.col("single_hit"), "singleton").when(full, "max_pending").when(F.col("existing_id").isNotNull() | ~F.col("first_key"), "existing").otherwise("inserted")
    return rows.select("ordinal", "actor", outcome.alias("outcome"), F.coalesce("unique_id", "existing_id").alias("existing_id"), initial_status(F.col("scheduled_at"), now).alias("status"))


def enqueue_batch(jobs: DataFrame, requests: DataFrame, actor_config: DataFrame, now) -> DataFrame:
    """All requests of an actor are refused if they would reach its cap; known keys return the row that has them."""
    waiting = jobs.filter(F.col("status").isin("pending", "scheduled")).groupBy("actor").agg(F.count("*").alias("waiting"))
    wanted = requests.groupBy("actor").agg(F.count("*").alias("wanted"))
    caps = wanted.join(actor_config.select("actor", "max_pending"), "actor", "left").join(waiting, "actor", "left")
    refused = caps.select("actor", F.coalesce(F.coalesce("waiting", F.lit(0)) + F.col("wanted") >= F.col("max_pending"), F.lit(False)).alias("refused"))
    first = F.col("first_ordinal")
    rows = _keyed(requests.join(refused, "actor"), jobs).withColumn("same_as", F.when(F.col("idempotency_key").isNotNull() & (first < F.col("ordinal")), first))
    outcome = F.when(F.col("refused"), "max_pending").when(F.col("existing_id").isNotNull() | F.col("same_as").isNotNull(), "existing").otherwise("inserted")
    return rows.select("ordinal", "actor", outcome.alias("outcome"), "existing_id", "same_as", initial_status(F.col("scheduled_at"), now).alias("status"))


def bulk_load(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """All or nothing, without caps; a duplicate key anywhere fails the whole load."""
    keys = requests.filter("idempotency_key is not null").select("idempotency_key")
    twice = keys.groupBy("idempotency_key").count().filter("count > 1").select("idempotency_key")
    held = keys.join(jobs.select("idempotency_key"), "idempotency_key", "left_semi")
    if not twice.unionByName(held).isEmpty():
        raise ValueError("a key is there already")
    return requests


def job_rows(requests: DataFrame, actor_config: DataFrame, now) -> DataFrame:
    """Whole rows of new jobs from requests (ordinal, actor, identity_key, idempotency_key, scheduled_at, metadata): queue and
    attempts come from the actor's configuration, or are ``default`` and three."""
    rows = requests.join(actor_config.select("actor", "queue", "max_attempts"), "actor", "left")
    at, none = moment(now), lambda t: F.lit(None).cast(t)
    return rows.select(
        *[ids_from(now, F.col("ordinal")).alias("id"), "ordinal", "actor", F.coalesce("queue", F.lit("default")).alias("queue"), "identity_key", "idempotency_key", none("string").alias("fairness_key"), F.lit(0).alias("priority")],
        *[initial_status(F.col("scheduled_at"), now).alias("status"), F.lit(0).alias("attempt"), F.coalesce("max_attempts", F.lit(3)).alias("max_attempts"), F.lit("transient").alias("retry_kind"), at.alias("created_at"), F.coalesce(F.col("scheduled_at").cast("timestamp_ntz"), at).alias("scheduled_at")],
        *[none("timestamp_ntz").alias(c) for c in ("started_at", "finished_at", "schedule_to_close", "lock_expires_at")],
        *[F.lit("{}").alias("payload"), F.coalesce("metadata", F.lit("{}")).alias("metadata"), none("long").alias("locked_by_worker"), F.lit(0).alias("cancel_phase"), none("string").alias("result")],
    )


def deadline(base: Column, relative: float | None, scheduled_at: Column | None = None) -> Column:
    """Relative deadlines count from now for a single request, from the scheduled time for a batch."""
    return (base if scheduled_at is None else scheduled_at) + seconds(relative) if relative is not None else F.lit(None).cast("timestamp_ntz")


def backpressure(jobs: DataFrame, actor: str) -> DataFrame:
    return jobs.filter((F.col("actor") == actor) & F.col("status").isin("pending", "scheduled")).agg(F.count("*").alias("n"))


def children(parents: DataFrame, plan: DataFrame) -> DataFrame:
    """Requests that a job made while it ran; they count only if it succeeded. ``plan`` is (parent_id, payloads)."""
    good = parents.filter("status = 'succeeded'").select(F.col("id").alias("parent_id"))
    return plan.join(good, "parent_id", "left_semi").select("parent_id", F.posexplode("payloads").alias("child", "payload"))


def ids_from(now, ordinal: Column) -> Column:
    """Version 7 UUIDs of a moment: milliseconds, then the ordinal in place of the 62 random bits, so that ids are
    ordered, differ for different ordinals, and are the same if a task runs again."""
    head = F.lpad(F.lower(F.hex(F.floor(micros(moment(now)) / 1000))), 12, "0")
    tail = F.lower(F.hex(F.lit(-(1 << 63)).bitwiseOR(ordinal.cast("long"))))
    return F.concat_ws("-", F.substring(head, 1, 8), F.substring(head, 9, 4), F.lit("7000"), F.substring(tail, 1, 4), F.substring(tail, 5, 12))


#: A fixed value.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def short_ids(number: Column, digits: int = 11) -> Column:
    """Base-62 spelling of a number that is not negative, 0 in front; eleven digits hold any."""
    spelled = [F.substring(F.lit(BASE62), (F.call_function("div", number, F.lit(62**k)) % 62 + 1).cast("int"), F.lit(1)) for k in range(digits - 1, -1, -1)]
    return F.concat(*spelled)
