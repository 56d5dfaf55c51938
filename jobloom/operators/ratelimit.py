"""Rate limits: one step function per algorithm, run over sorted groups or as streaming state."""

from __future__ import annotations

import math
import pickle
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.operators.sequences import trailing, with_pieces

DECISIONS = "bucket string, request_id long, allowed boolean, level double, retry_after double"


def token_bucket(state: tuple | None, now: float, capacity: float, refill: float, cost: float = 1.0) -> tuple[tuple, bool, float, float | None]:
    """(state, allowed, tokens left, seconds to wait). A denial moves the clock too; without refill the wait is unknown."""
    tokens, at = state if state is not None else (capacity, now)
    tokens = min(capacity, tokens + max(0.0, now - at) * refill)
    if tokens >= cost:
        return (tokens - cost, now), True, tokens - cost, 0.0
    return (tokens, now), False, tokens, (cost - tokens) / refill if refill > 0 else None


def token_refund(state: tuple, now: float, capacity: float, refill: float, cost: float = 1.0) -> tuple:
    tokens, at = state
    return min(capacity, min(capacity, tokens + max(0.0, now - at) * refill) + cost), now


def token_peek(state: tuple | None, now: float, capacity: float, refill: float) -> tuple[float, bool]:
    """(tokens, exhausted) without a change."""
    tokens, at = state if state is not None else (capacity, now)
    tokens = min(capacity, tokens + max(0.0, now - at) * refill)
    return tokens, tokens <= 0


def window_log(state: deque | None, now: float, limit: int, window: float, inclusive: bool = False) -> tuple[deque, bool, float, float | None]:
    """Exact log; entries at ``now - window`` have left unless ``inclusive``."""
    log = state if state is not None else deque()
    while log and (log[0] < now - window if inclusive else log[0] <= now - window):
        log.popleft()
    if len(log) < limit:
        log.append(now)
        return log, True, float(limit - len(log)), 0.0
    return log, False, 0.0, log[0] + window - now if log else window


def window_refund(state: deque, then: float) -> deque:
    """Take back the request that was let through at ``then``. Requests of one moment are alike; one that has left the
    log, or was taken back before, changes nothing."""
    if then in state:
        state.remove(then)
    return state


def window_peek(state: deque | None, now: float, limit: int, window: float) -> tuple[float, float | None]:
    """What is left at ``now`` and how long to wait for it; the log stays as it is."""
    here = [t for t in state or () if t > now - window]
    if len(here) < limit:
        return float(limit - len(here)), 0.0
    return 0.0, here[0] + window - now if here else window


def gcra(state: float | None, now: float, limit: int, window: float) -> tuple[float | None, bool, float, float | None]:
    """Theoretical arrival time; a denial leaves it as it was."""
    step = window / limit
    tat = max(now, state if state is not None else now)
    opens = tat + (step - window)  # in this order a window of one step is exact
    if now < opens:
        return state, False, 0.0, opens - now
    return tat + step, True, float(max(0, int((now - opens) // step))), 0.0


def gcra_refund(state: float | None, before: float, after: float) -> float | None:
    """Back to the time before, if nobody moved it meanwhile."""
    return before if state == after else state


def arrivals_refunded(states: DataFrame, refunds: DataFrame) -> DataFrame:
    """States (bucket, tat) after refunds (bucket, before, after): back to the time before, where nobody moved it meanwhile.
    Of several refunds for a bucket one that fits is enough."""
    fits = states.join(refunds, "bucket").filter(F.col("tat") == F.col("after")).groupBy("bucket").agg(F.min("before").alias("back"))
    return states.join(fits, "bucket", "left").select("bucket", F.coalesce("back", "tat").alias("tat"))


Step = Callable[[object, float], tuple]


def replayed(requests: DataFrame, step: Step, fresh_after: float | None = None) -> DataFrame:
    """Decisions over (bucket, ts, request_id) in time order; ties by request id.

    The order matters, so requests are sorted by Spark and streamed through Python in batches, with only the state of the
    current bucket held. After ``fresh_after`` seconds without a request any state decides like none at all; there a
    bucket's sequence is cut, and the pieces are replayed by different tasks. A bucket that never rests that long is one
    sequence.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, state = None, None
        for rows in batches:
            out = []
            for b, piece, us, r in zip(rows["bucket"], rows["piece"], rows["us"], rows["request_id"], strict=True):
                if (b, piece) != here:
                    here, state = (b, piece), None
                state, ok, level, wait = step(state, us / 1e6)
                out.append((b, r, ok, level, wait))
            yield pd.DataFrame(out, columns=["bucket", "request_id", "allowed", "level", "retry_after"]).astype({"level": float, "retry_after": float})

    rows = requests.select("bucket", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "request_id")
    rows = rows.withColumn("piece", F.lit(0).cast("long")) if fresh_after is None else with_pieces(rows, ["bucket"], max(1, math.ceil(fresh_after * 1e6)))
    return rows.repartition("bucket", "piece").sortWithinPartitions("bucket", "piece", "us", "request_id").mapInPandas(run, DECISIONS)


def fixed_tokens(requests: DataFrame, capacity: float, refill: float) -> DataFrame:
    """A bucket that has been left alone for the time of a whole refill is full, whatever it held."""
    return replayed(requests, lambda s, t: token_bucket(s, t, capacity, refill), (capacity + 1) / refill if refill > 0 else None)


def sliding_log(requests: DataFrame, limit: int, window: float) -> DataFrame:
    """A log without entries for a whole window is empty."""
    return replayed(requests, lambda s, t: window_log(s, t, limit, window), window + 1)


def gcra_limit(requests: DataFrame, limit: int, window: float) -> DataFrame:
    """The arrival time lies a window ahead at most."""
    return replayed(requests, lambda s, t: gcra(s, t, limit, window), window + 1)


def last_states(requests: DataFrame, step: Step) -> DataFrame:
    """(bucket, at, state): the state after each bucket's last request, pickled, for refunds, peeks and resets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, state, at = None, None, None
        for rows in batches:
            out = []
            for b, us in zip(rows["bucket"], rows["us"], strict=True):
                if b != here:
                    if here is not None:
                        out.append((here, at, pickle.dumps(state)))
                    here, state = b, None
                at = us
                state = step(state, us / 1e6)[0]
            yield pd.DataFrame(out, columns=["bucket", "at", "state"])
        if here is not None:
            yield pd.DataFrame([(here, at, pickle.dumps(state))], columns=["bucket", "at", "state"])

    dealt = requests.select("bucket", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "request_id").repartition("bucket").sortWithinPartitions("bucket", "us", "request_id")
    return dealt.mapInPandas(run, "bucket string, at long, state binary")


def token_states(requests: DataFrame, capacity: float, refill: float) -> DataFrame:
    """(bucket, at_us, tokens) after each bucket's last request."""

    @F.pandas_udf("double")
    def tokens(state: pd.Series) -> pd.Series:
        return state.map(lambda s: float(pickle.loads(s)[0]))

    return last_states(requests, lambda s, t: token_bucket(s, t, capacity, refill)).select("bucket", F.col("at").alias("at_us"), tokens("state").alias("tokens"))


def _refilled(capacity: float, refill: float, at_us) -> Column:
    return F.least(F.lit(float(capacity)), F.col("tokens") + F.greatest(F.lit(0.0), (at_us - F.col("at_us")) / 1e6) * refill)


def refunded(states: DataFrame, refunds: DataFrame, capacity: float, refill: float) -> DataFrame:
    """States (bucket, at_us, tokens) after refunds (bucket, at_us, tokens); several for one bucket add up, at the time of
    the last. A bucket without refund, or one that nobody has used, stays as it is."""
    back = refunds.groupBy("bucket").agg(F.max("at_us").alias("then"), F.sum("tokens").alias("given"))
    full = F.least(F.lit(float(capacity)), _refilled(capacity, refill, F.col("then")) + F.col("given"))
    given = F.col("given").isNotNull()
    return states.join(back, "bucket", "left").select("bucket", F.when(given, F.greatest("at_us", "then")).otherwise(F.col("at_us")).alias("at_us"), F.when(given, full).otherwise(F.col("tokens")).alias("tokens"))


def peeked(states: DataFrame, at_us, capacity: float, refill: float) -> DataFrame:
    """(bucket, tokens, exhausted) at a moment, without a change."""
    tokens = _refilled(capacity, refill, at_us)
    return states.select("bucket", tokens.alias("tokens"), (tokens <= 0).alias("exhausted"))


def reset(states: DataFrame, buckets: DataFrame) -> DataFrame:
    """States without those of ``buckets`` (bucket): their next request finds them fresh."""
    return states.join(buckets.select("bucket").distinct(), "bucket", "left_anti")


def offered_load(requests: DataFrame, window: float, parts: int = 8) -> DataFrame:
    """Requests in the window up to each one, whatever was decided, and the oldest of them."""
    rows = requests.select("bucket", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "request_id")
    return trailing(rows, "bucket", int(window * 1e6), "request_id", parts)


KEY = "^[A-Za-z0-9_.-]{1,64}$"


def keyed_reservations(requests: DataFrame, base: str, most: int, idle: float) -> DataFrame:
    """(key, name, ok, evicted): keyed bucket names with validation, idle eviction, and a cap on live keys.

    Requests (key, ts). Keys beyond the cap, by last use, are refused.
    """
    from pyspark.sql import Window

    last = requests.groupBy("key").agg(F.max("ts").alias("last_used"))
    newest = last.agg(F.max("last_used").alias("newest"))
    rows = last.crossJoin(F.broadcast(newest))  # one row
    rows = rows.withColumn("valid", F.coalesce(F.col("key").rlike(KEY), F.lit(False))).withColumn("evicted", F.col("last_used") < F.col("newest") - F.make_dt_interval(secs=F.lit(idle)))
    live = rows.filter("valid and not evicted").orderBy(F.desc("last_used"), "key").limit(most).select(F.col("key").alias("live_key"))
    joined = rows.join(live, F.col("key") == F.col("live_key"), "left")
    return joined.select("key", F.when(F.col("valid"), F.concat(F.lit(f"{base}:"), F.col("key"))).alias("name"), F.col("live_key").isNotNull().alias("ok"), "evicted")
