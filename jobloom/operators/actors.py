"""User code on the executors: actors, classifiers, key functions and outcome hooks."""

from __future__ import annotations

import heapq
import json
import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Snooze(Exception):
    """Run again later without using an attempt."""

    def __init__(self, delay: float) -> None:
        super().__init__(delay)
        self.delay = delay


class RetryAfter(Snooze):
    """Run again later; uses an attempt unless ``consume`` is false."""

    def __init__(self, delay: float, consume: bool = True) -> None:
        super().__init__(delay)
        self.consume = consume


class SlotsBusy(Snooze):
    """A reservation had no slot, or a limit no permit."""

    def __init__(self, delay: float, bucket: str = "") -> None:
        super().__init__(delay)
        self.bucket = bucket


class Rejected(Exception):
    """Not worth another attempt."""


@dataclass(frozen=True)
class Actor:
    """Options of an actor; ``run`` takes a payload and returns something JSON can hold."""

    name: str
    run: Callable[[dict], Any]
    queue: str = "default"
    max_attempts: int = 3
    retry_kind: str = "transient"
    priority: int = 0
    singleton: bool = False
    max_concurrent: int | None = None
    max_pending: int | None = None
    unique_for: float | None = None
    result_ttl: float | None = None
    metadata: dict = field(default_factory=dict)


REGISTRY: dict[str, Actor] = {}


def actor(name: str, **options: Any) -> Callable:
    """Register a function as an actor."""

    def wrap(run: Callable[[dict], Any]) -> Actor:
        REGISTRY[name] = Actor(name, run, **options)
        return REGISTRY[name]

    return wrap


def config_rows(actors: dict[str, Actor]) -> list[tuple]:
    return [(a.name, a.max_concurrent, a.max_pending, a.queue, a.max_attempts, a.retry_kind, a.result_ttl, json.dumps(a.metadata | ({"singleton": True} if a.singleton else {}), sort_keys=True)) for _, a in sorted(actors.items())]


OUTCOMES = "id long, actor string, outcome string, result string, error_class string, delay double, bucket string, children array<struct<actor:string,payload:string>>"


class Children(dict):
    """A result that asks for jobs besides: (actor, payload) each, enqueued only if the attempt succeeds."""

    def __init__(self, result: dict, jobs: list[tuple[str, dict]]) -> None:
        super().__init__(result)
        self.jobs = jobs


def outcome(run: Callable[[dict], Any], payload: str | None) -> tuple[str, str | None, str | None, float | None]:
    """(outcome, result, error class, delay) of one call; every exception has its route."""
    return _called_with(run, payload)[:4]


def _called_with(run: Callable[[dict], Any], payload: str | None) -> tuple:
    """The same with the bucket that denied and the jobs that were asked for."""
    try:
        try:
            value = json.loads(payload or "{}")
        except ValueError:
            return "failed", None, "PayloadError", None, None, None
        result = run(value)
        children = [(a, json.dumps(p, sort_keys=True)) for a, p in result.jobs] if isinstance(result, Children) else None
        return "succeeded", json.dumps(result, sort_keys=True), None, None, None, children
    except RetryAfter as e:
        return "retry_after" if e.consume else "retry_after_free", None, None, float(e.delay), None, None
    except SlotsBusy as e:
        return "reservation_denied", None, None, float(e.delay), e.bucket, None
    except Snooze as e:
        return "snoozed", None, None, float(e.delay), None, None
    except Rejected:
        return "failed", None, "Rejected", None, None, None
    except Exception as e:  # noqa: BLE001  user code
        return "retry", None, type(e).__name__, None, None, None


def performed(jobs: DataFrame, actors: dict[str, Actor]) -> DataFrame:
    """Run each job's actor; jobs of unknown actors wait 10 seconds."""
    runs = {n: a.run for n, a in actors.items()}

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(i, a, *(_called_with(runs[a], p) if a in runs else ("actor_not_found", None, None, 10.0, None, None))) for i, a, p in zip(rows["id"], rows["actor"], rows["payload"], strict=True)]
            yield pd.DataFrame(out, columns=["id", "actor", "outcome", "result", "error_class", "delay", "bucket", "children"]).astype({"delay": float})

    return jobs.select("id", "actor", "payload").mapInPandas(go, OUTCOMES)


def overridden(failures: DataFrame, classify: Callable[[str, int], tuple[str, float] | None], most: float) -> DataFrame:
    """(kind, delay) of a user's classifier; failures of the classifier and wrong answers fall back to the row's kind."""

    @F.pandas_udf("struct<kind:string,delay:double>")
    def ask(error: pd.Series, attempt: pd.Series, kind: pd.Series) -> pd.DataFrame:
        out = []
        for e, a, k in zip(error, attempt, kind, strict=True):
            try:
                new, delay = classify(e, int(a))
                if new not in ("transient", "indefinite", "non_retryable"):
                    raise ValueError(new)
                out.append((new, min(max(0.0, float(delay)), most)))
            except Exception:  # noqa: BLE001  user code
                out.append((k, None))
        return pd.DataFrame(out, columns=["kind", "delay"]).astype({"delay": float})

    return failures.withColumn("_o", ask("error_class", "attempt", "retry_kind")).select("*", F.col("_o.kind").alias("kind"), F.col("_o.delay").alias("override_delay")).drop("_o")


def keyed(jobs: DataFrame, key_fn: Callable[[dict], str]) -> DataFrame:
    """The payload's key; payloads that the function refuses have none."""

    @F.pandas_udf("string")
    def key(payload: pd.Series) -> pd.Series:
        out = []
        for p in payload:
            try:
                out.append(key_fn(json.loads(p)))
            except Exception:  # noqa: BLE001  user code
                out.append(None)
        return pd.Series(out, dtype=object)

    return jobs.withColumn("key", key("payload"))


def _called(hook: Callable[[int, str], None], i: int, outcome: str, seconds: float) -> str:
    """``called``, or the name of what the hook raised; one that takes longer is left behind."""
    found = []

    def run() -> None:
        try:
            hook(i, outcome)
            found.append("called")
        except Exception as e:  # noqa: BLE001  user code
            found.append(type(e).__name__)

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    return found[0] if found else "TimeoutError"


def hooked(outcomes: DataFrame, hooks: dict[str, Callable[[int, str], None]], seconds: float = 5.0) -> DataFrame:
    """Call the hook of each outcome for at most ``seconds``; what it raises is noted and goes no further."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(hook=[_called(hooks[o], int(i), o, seconds) if o in hooks else None for i, o in zip(rows["id"], rows["outcome"], strict=True)])

    return outcomes.mapInPandas(go, "id long, outcome string, hook string")


def told(dead: DataFrame, hooks: dict[str, Callable[[int, str], None]], reporter: Callable[[int, str], None] | None = None, seconds: float = 5.0) -> DataFrame:
    """(job_id, hook, report) of jobs that won't run again (job_id, actor, cause, ...): the actor's hook is called with the
    cause, then the reporter, each for at most ``seconds``. What they raise is noted, and neither keeps the other from
    being called; null where there is none."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(j, _called(hooks[a], int(j), c, seconds) if a in hooks else None, _called(reporter, int(j), c, seconds) if reporter else None) for j, a, c in zip(rows["job_id"], rows["actor"], rows["cause"], strict=True)]
            yield pd.DataFrame(out, columns=["job_id", "hook", "report"])

    return dead.select("job_id", "actor", "cause").mapInPandas(go, "job_id long, hook string, report string")


class _Clock:
    """Waiting jobs of one queue, and when each place is free."""

    def __init__(self, workers: int) -> None:
        self.free, self.waiting = [0] * workers, []

    def add(self, i: int, queue: str, priority: int, scheduled: int, run: int) -> None:
        heapq.heappush(self.waiting, (-priority, scheduled, i, queue, run))

    def until(self, at: int | None) -> list[tuple]:
        """Starts before ``at``, or all that are left."""
        out = []
        while self.waiting and (at is None or max(self.free[0], self.waiting[0][1]) < at):
            _, scheduled, i, queue, run = heapq.heappop(self.waiting)
            start = max(heapq.heappop(self.free), scheduled)
            heapq.heappush(self.free, start + run)
            out.append((i, queue, start, start + run))
        return out


def simulated(jobs: DataFrame, workers: int = 1) -> DataFrame:
    """Discrete-event run until drained: per queue, jobs (id, queue, priority, scheduled_us, run_us) start in dispatch
    order on ``workers`` places; the clock jumps to the next due job when nothing can run."""
    columns = ["id", "queue", "start_us", "end_us"]

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queue, clock = None, _Clock(workers)
        for batch in batches:
            out = []
            for i, q, prio, sched, run in zip(batch["id"], batch["queue"], batch["priority"], batch["scheduled_us"], batch["run_us"], strict=True):
                if q != queue:
                    out += clock.until(None)
                    queue, clock = q, _Clock(workers)
                out += clock.until(int(sched))
                clock.add(int(i), q, int(prio), int(sched), int(run))
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame(clock.until(None), columns=columns)

    dealt = jobs.select("id", "queue", "priority", "scheduled_us", "run_us").repartition("queue").sortWithinPartitions("queue", "scheduled_us", "id")
    return dealt.mapInPandas(go, "id long, queue string, start_us long, end_us long")
