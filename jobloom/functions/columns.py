"""Column expressions: predicates, projections and scalar helpers. Time is always an argument."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

ACTIVE = ("pending", "scheduled", "running")
TERMINAL = ("succeeded", "failed", "cancelled", "crashed", "abandoned")
#: Declaration order of states, for sorting by state.
STATES = ("pending", "scheduled", "running", "succeeded", "failed", "cancelled", "crashed", "abandoned")
#: Changes of state that occur, (from, to).
TRANSITIONS = (
    [(None, "pending"), (None, "scheduled"), ("pending", "running"), ("pending", "cancelled"), ("pending", "failed"), ("scheduled", "pending"), ("scheduled", "cancelled"), ("scheduled", "failed")]
    + [("running", s) for s in ("pending", "scheduled", "succeeded", "failed", "cancelled", "crashed", "abandoned")]
    + [(s, "pending") for s in ("failed", "crashed", "cancelled")]
)
FAR = "9999-12-31 23:59:59"


def moment(value: str | datetime | Column) -> Column:
    """A timestamp without zone, as the tables hold."""
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp_ntz")


def seconds(n) -> Column:
    return F.make_dt_interval(secs=F.lit(n) if not isinstance(n, Column) else n)


def micros(col: Column) -> Column:
    return F.unix_micros(col.cast("timestamp"))


def tags(col: Column) -> Column:
    return F.split(col, ",")


# Predicates


def matches(**wanted) -> Column:
    """All of the given equalities; None stands for no condition."""
    out = F.lit(True)
    for name, value in wanted.items():
        if value is not None:
            out = out & (F.col(name) == F.lit(value))
    return out


def json_equals(col: Column, key: str, value: str) -> Column:
    return F.coalesce(F.get_json_object(col, f"$.{key}") == F.lit(value), F.lit(False))


def json_true(col: Column, key: str) -> Column:
    """Whether a key holds the boolean true; the string "true" doesn't count."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json(col), f"$.{key}", "variant")) == "BOOLEAN", F.lit(False)) & (F.get_json_object(col, f"$.{key}") == "true")


def overlaps(left: Column, values: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(left, F.array(*map(F.lit, values))), F.lit(False)) if values else F.lit(False)


def contains_text(col: Column, text: str) -> Column:
    """Case-insensitive; ``%`` and ``_`` of the user's text are wildcards."""
    return col.ilike(f"%{text}%")


def free_text(text: str) -> Column:
    return F.col("id").cast("string").ilike(f"%{text}%") | F.col("actor").ilike(f"%{text}%")


def between(col: Column, start=None, end=None) -> Column:
    out = F.lit(True)
    if start is not None:
        out = out & (col >= moment(start))
    if end is not None:
        out = out & (col <= moment(end))
    return out


def within_last(col: Column, preset: str, now) -> Column:
    amount = {"5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "6h": 21600, "24h": 86400, "7d": 604800, "30d": 2592000}[preset]
    return col >= moment(now) - seconds(amount)


def after_dispatch_key(priority: int, scheduled_at, row_id) -> Column:
    """Rows after a key in the order priority descending, scheduled_at and id ascending."""
    p, s, i = F.col("priority"), F.col("scheduled_at"), F.col("id")
    at = moment(scheduled_at)
    return (p < priority) | ((p == priority) & (s > at)) | ((p == priority) & (s == at) & (i > row_id))


def keyset(columns: list[str], values: list, types: list[str], forward: bool = True, ascending: bool = True) -> Column:
    """Row-value comparison; which side follows depends on the order's direction."""
    left = F.struct(*[F.col(c).cast(t).alias(f"k{i}") for i, (c, t) in enumerate(zip(columns, types, strict=True))])
    right = F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(values, types, strict=True))])
    return left > right if forward == ascending else left < right


def or_far(col: Column) -> Column:
    return F.coalesce(col, moment(FAR))


def due(now) -> Column:
    return (F.col("status") == "pending") & (F.col("scheduled_at") <= moment(now)) & (F.col("schedule_to_close").isNull() | (F.col("schedule_to_close") > moment(now)))


def lease_expired(now, grace: float = 30, cleanup: float = 10) -> Column:
    lock = F.col("lock_expires_at")
    return (F.col("status") == "running") & (lock < moment(now)) & ((F.col("cancel_phase") == 0) | (lock < moment(now) - seconds(grace + cleanup + 60)))


def past_deadline(now) -> Column:
    return F.col("status").isin("pending", "scheduled") & (F.col("schedule_to_close") < moment(now))


def promotable(now) -> Column:
    return (F.col("status") == "scheduled") & (F.col("scheduled_at") <= moment(now))


def older_than(col: Column, now, age: float = 0) -> Column:
    return col < moment(now) - seconds(age)


def recent(now, age: float, statuses: list[str]) -> Column:
    return (F.col("created_at") > moment(now) - seconds(age)) & F.col("status").isin(*statuses)


def whole_number(col: Column, key: str) -> Column:
    """The value of a JSON key that is all digits, else null."""
    value = F.get_json_object(col, f"$.{key}")
    return F.when(value.rlike("^[0-9]+$"), value.try_cast("int"))


def checked_states(values: list[str]) -> list[str]:
    if unknown := [v for v in values if v not in STATES]:
        raise ValueError(f"unknown states: {unknown}")
    return values


# Projections


def duration_ms(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(1000.0)


def whole_ms(start: Column, end: Column) -> Column:
    """Truncated toward zero, for durations of any length."""
    us = micros(end) - micros(start)
    return ((us - us % 1000) / 1000).cast("long")


def status_rank(status: Column) -> Column:
    return F.when(status.isin(*ACTIVE), 0).otherwise(1)


def state_order(status: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STATES)), status)


def initial_status(scheduled_at: Column, now) -> Column:
    return F.when(F.coalesce(scheduled_at, moment(now)) > moment(now), "scheduled").otherwise("pending")


def clipped(col: Column, most: int = 2000) -> Column:
    """At most ``most`` characters, of which the last say how many were over."""
    suffix = F.format_string("\n... (%d more characters)", F.length(col) - most)  # a fixed value
    return F.when(F.length(col) > most, F.concat(F.substring(col, F.lit(1), most - F.length(suffix)), suffix)).otherwise(col)


def iso(col: Column) -> Column:
    """To the second, and to the microsecond if there are any."""
    rest = micros(col) % 1_000_000
    return F.concat(F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss"), F.when(rest == 0, "").otherwise(F.concat(F.lit("."), F.lpad(rest.cast("string"), 6, "0"))))


def healthy(last_seen: Column, now, threshold: float) -> Column:
    return F.when(last_seen.isNull(), F.lit(None).cast("boolean")).otherwise(moment(now) - seconds(threshold) <= last_seen)


def capped_count(n: int, cap: int = 1000) -> str:
    return f"{cap:,}+" if n > cap else f"{n:,}"


# Scalars


def merged(left: Column, right: Column) -> Column:
    """Shallow merge of JSON objects; the right side wins, a null right side changes nothing. Values of any type stay
    what they are, a JSON null too; keys come out in order."""
    kind = "map<string,variant>"
    a, b = F.coalesce(F.from_json(left, kind), F.from_json(F.lit("{}"), kind)), F.coalesce(F.from_json(right, kind), F.from_json(F.lit("{}"), kind))
    kept = F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k))
    entries = F.array_sort(F.concat(F.map_entries(kept), F.map_entries(b)), lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0))
    return F.when(right.isNull(), left).otherwise(F.to_json(F.map_from_entries(entries)))


def counted_up(metadata: Column, key: str) -> Column:
    """The object with one more under ``key``: an integer or the digits of one counts on, anything else counts from 0."""
    value = F.get_json_object(metadata, f"$.{key}")
    now = F.when(value.rlike("^-?[0-9]{1,18}$"), value.try_cast("long"))
    return merged(metadata, F.to_json(F.create_map(F.lit(key), F.coalesce(now, F.lit(0)) + 1)))


# What a tag is.
TAG = r"^[\p{L}\p{N}_][\p{L}\p{N}_-]+[\p{L}\p{N}_]\z"
TAG_CHARS = 255


def tag_problem(col: Column) -> Column:
    """The first malformed tag as a message, null if there is none."""
    bad = F.filter(col, lambda t: t.isNull() | (F.length(t) > TAG_CHARS) | ~t.rlike(TAG))
    return F.when(F.size(bad) > 0, F.concat(F.lit("invalid tag: "), F.coalesce(F.get(bad, 0), F.lit("null"))))


def clean_tags(col: Column) -> Column:
    """Distinct tags in first-seen order, none for a null list; null if any is malformed, see ``tag_problem``."""
    return F.when(tag_problem(col).isNull(), F.coalesce(F.array_distinct(col), F.array().cast("array<string>")))


def key_valid(col: Column, most: int = 256) -> Column:
    return col.isNotNull() & (F.length(F.trim(col)) > 0) & (F.length(col) <= most)


def cursor(priority: Column, at: Column, row_id: Column) -> Column:
    return F.concat_ws("|", priority.cast("string"), iso(at), row_id.cast("string"))


def cursor_parts(col: Column) -> list[Column]:
    parts = F.split(col, r"\|", 3)
    return [F.get(parts, 0).cast("int"), F.get(parts, 1).cast("timestamp_ntz"), F.get(parts, 2).cast("long")]


def result_bytes(col: Column) -> Column:
    return F.octet_length(col)


def hhmm_cron(col: Column) -> Column:
    """Daily schedule of a time of day."""
    return F.when(col.rlike("^([01][0-9]|2[0-3]):[0-5][0-9]$"), F.concat_ws(" ", F.substring(col, 4, 2).cast("int").cast("string"), F.substring(col, 1, 2).cast("int").cast("string"), F.lit("* * *")))


def hex_id(col: Column, digits: int) -> Column:
    return F.lower(F.lpad(F.hex(col), digits, "0"))


def backoff(attempt: Column, kind: str, base: float, cap: float, overall: float) -> Column:
    """Seconds before the next attempt without jitter."""
    a = attempt.cast("double")
    raw = {"exponential": base * F.pow(F.lit(2.0), a - 1), "linear": base * a, "fixed": F.lit(float(base))}[kind]
    return F.least(raw if kind == "fixed" else F.least(raw, F.lit(float(cap))), F.lit(float(overall)))


def jittered(delay: Column, share: float, seed: int, cap: float, overall: float) -> Column:
    """Symmetric jitter from a seeded uniform, clamped again."""
    return F.greatest(F.lit(0.0), F.least(delay * (1 + share * (2 * F.rand(seed) - 1)), F.lit(float(cap)), F.lit(float(overall))))
