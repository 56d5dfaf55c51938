"""Jobs that need several things at once: a slot of each reservation, then a permit of each rate limit, or nothing.

Jobs that name a common reservation or limit decide about one another, and so do those linked through others. Such a
group of names is one ordered sequence: its jobs are sorted by Spark and streamed through Python with the group's
states only. A group that rests until every limit is fresh and every slot free is cut there, and its pieces are
replayed by different tasks. A sequence that never rests is replayed in turns of bounded size, one after another.
"""

from __future__ import annotations

import functools
import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.operators import graph, ratelimit
from jobloom.operators.sequences import with_pieces
from jobloom.sources.shared import written

#: Seconds to wait for a slot whose holder may take any time.
SLOT_WAIT = 5.0
DECIDED = "job_id long, allowed boolean, denied_by string, source string, retry_after double"
_DECIDED = ["job_id", "allowed", "denied_by", "source", "retry_after"]
_COLUMNS = [*_DECIDED, "group", "piece", "state"]
#: Rows of a sequence that one task sorts and replays.
MOST_ROWS = 1 << 20


@dataclass(frozen=True)
class Limit:
    """``tokens``: ``size`` and refill a second ``rate``; ``window`` and ``gcra``: ``size`` requests in ``rate`` seconds."""

    kind: str
    size: float
    rate: float

    def take(self, state, now: float) -> tuple:
        """(state, allowed, seconds to wait)."""
        if self.kind == "tokens":
            state, ok, _, wait = ratelimit.token_bucket(state, now, self.size, self.rate)
        elif self.kind == "window":
            state, ok, _, wait = ratelimit.window_log(state, now, int(self.size), self.rate)
        elif self.kind == "gcra":
            state, ok, _, wait = ratelimit.gcra(state, now, int(self.size), self.rate)
        else:
            raise ValueError(f"unknown kind of limit: {self.kind}")
        return state, ok, wait

    def give_back(self, before, state, now: float):
        """The state without what was taken at ``now``, from ``before``."""
        if self.kind == "tokens":
            return ratelimit.token_refund(state, now, self.size, self.rate)
        if self.kind == "window":
            return ratelimit.window_refund(state, now)
        return ratelimit.gcra_refund(state, before, state)

    def fresh_after(self) -> float | None:
        """Seconds of rest after which any state decides like none; None if there is no such time."""
        if self.kind == "tokens":
            return (self.size + 1) / self.rate if self.rate > 0 else None
        return self.rate + 1


class Book:
    """States of one group of names."""

    def __init__(self, reservations: dict[str, int], limits: dict[str, Limit]) -> None:
        self.places, self.limits = reservations, limits
        self.held: dict[str, list[tuple[int, int]]] = {}
        self.states: dict[str, object] = {}

    def decide(self, job: int, us: int, reservations: list[str], limits: list[str], hold_us: int) -> tuple:
        """(allowed, denied by, source, seconds to wait); what was taken before a denial is given back in reverse."""
        taken: list[tuple] = []

        def denied(name: str, source: str, wait: float | None) -> tuple:
            for kind, what, before in reversed(taken):
                if kind == "slot":
                    self.held[what].remove((us + hold_us, job))
                    heapq.heapify(self.held[what])
                else:
                    self.states[what] = self.limits[what].give_back(before, self.states[what], us / 1e6)
            return False, name, source, SLOT_WAIT if wait is None else wait

        for name in reservations:
            if (places := self.places.get(name, self.places.get(name.split(":", 1)[0]))) is None:
                return denied(name, "unknown", None)
            held = self.held.setdefault(name, [])
            while held and held[0][0] <= us:
                heapq.heappop(held)
            if len(held) >= places:
                return denied(name, "reservation", None)
            heapq.heappush(held, (us + hold_us, job))
            taken.append(("slot", name, None))
        for name in limits:
            if (limit := self.limits.get(name)) is None:
                return denied(name, "unknown", None)
            before = self.states.get(name)
            self.states[name], ok, wait = limit.take(before, us / 1e6)
            if not ok:
                return denied(name, "rate_limit", wait)
            taken.append(("limit", name, before))
        return True, None, None, None

    def at_rest(self, us: int | None) -> tuple[dict, dict]:
        """(slots that are held after ``us``, states): all that later jobs depend on."""
        return {name: left for name, held in self.held.items() if (left := [h for h in held if us is None or h[0] > us])}, self.states


def _listed(names) -> list[str]:
    return [x for x in names if x is not None] if names is not None else []


def _names(jobs: DataFrame) -> DataFrame:
    """All names that a job asks for, reservations and limits apart."""
    tagged = lambda c, tag: F.transform(F.coalesce(F.filter(c, lambda x: x.isNotNull()), F.array().cast("array<string>")), lambda x: F.concat(F.lit(tag), x))
    return jobs.withColumn("_names", F.concat(tagged("reservations", "r:"), tagged("limits", "l:")))


def all_or_nothing(jobs: DataFrame, reservations: dict[str, int], limits: dict[str, Limit], most_hold_us: int | None = None, most_rows: int = MOST_ROWS) -> DataFrame:
    """(job_id, allowed, denied_by, source, retry_after) of jobs (job_id, us, reservations, limits, hold_us).

    Jobs are taken by ``us``, then id. Reservations come first, in the job's order, then limits in theirs. A slot is
    free ``hold_us`` after it was taken. ``name:key`` is a reservation of its own with the places of ``name``. A name
    that nobody has set up denies, with source ``unknown``; a job that asks for nothing is let through. Null lists are empty ones.
    ``most_hold_us`` is a bound on ``hold_us``; with it, and if all limits get fresh again, groups are cut at rests.
    A sequence of more than ``most_rows`` rows is replayed in turns, which pass its state on.
    """
    named = _names(jobs)
    first = F.get("_names", 0)
    links = named.filter(F.size("_names") > 0).select(first.alias("a"), F.explode("_names").alias("b")).distinct()
    roots = graph.groups(links).select(F.col("name").alias("_first"), F.col("root").alias("group"))
    # A job without names has no group: it goes by its id, so that such jobs don't meet in one task.
    met = named.withColumn("_first", first).join(roots, "_first", "left").withColumn("group", F.coalesce("group", F.concat(F.lit("-"), F.col("job_id").cast("string"))))
    rests = [limit.fresh_after() for limit in limits.values()]
    if most_hold_us is None or None in rests:
        met = met.withColumn("piece", F.lit(0).cast("long"))
    else:
        met = with_pieces(met, ["group"], max(1, most_hold_us + 1, *(int(r * 1e6) + 1 for r in rests)))

    met = written(met.select("group", "piece", "job_id", "us", "reservations", "limits", "hold_us"), "composed")
    long = met.groupBy("group", "piece").agg(F.count("*").alias("n")).filter(F.col("n") > most_rows).select("group", "piece", "n").persist()
    try:
        rows = long.agg(F.sum("n")).first()[0] or 0
        if not rows:
            return _decided(met, reservations, limits).select(*_DECIDED)
        names = written(long.select("group", "piece"), "composed-long")
    finally:
        long.unpersist()
    # There are no more than rows / most_rows of the long ones.
    short = _decided(met.join(F.broadcast(names), ["group", "piece"], "left_anti"), reservations, limits).select(*_DECIDED)
    return short.unionByName(_in_turns(met.join(F.broadcast(names), ["group", "piece"], "left_semi"), rows, reservations, limits, most_rows))


def _decided(rows: DataFrame, reservations: dict[str, int], limits: dict[str, Limit], states: DataFrame | None = None, last: bool = True) -> DataFrame:
    """Decisions on the rows of each sequence, from its state if there is one; unless it is the ``last`` turn, also a row with each
    sequence's state after them."""

    # No nulls among whole numbers, in either direction: pandas would make them floats.
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, book, now = None, None, None

        def ended() -> list[tuple]:
            return [] if last or here is None else [(0, *[None] * 4, *here, pickle.dumps((book.at_rest(now), now)))]

        for rows in batches:
            out = []
            for group, piece, job, us, res, lim, hold, state in zip(*(rows[c] for c in ("group", "piece", "job_id", "us", "reservations", "limits", "hold_us", "state")), strict=True):
                if (group, piece) != here:
                    out += ended()
                    here, book, now = (group, piece), Book(reservations, limits), None
                if state is not None:  # comes before the sequence's rows
                    (book.held, book.states), now = pickle.loads(state)
                    continue
                now = int(us)
                out.append((int(job), *book.decide(int(job), now, _listed(res), _listed(lim), int(hold)), None, 0, None))
            yield pd.DataFrame(out, columns=_COLUMNS).astype({"retry_after": float})
        if here is not None and not last:
            yield pd.DataFrame(ended(), columns=_COLUMNS).astype({"retry_after": float})

    given = rows.withColumn("state", F.lit(None).cast("binary"))
    if states is not None:
        given = given.unionByName(states, allowMissingColumns=True)
    return given.repartition("group", "piece").sortWithinPartitions("group", "piece", F.col("state").isNull(), "us", "job_id").mapInPandas(run, f"{DECIDED}, group string, piece long, state binary")


def _in_turns(met: DataFrame, rows: int, reservations: dict[str, int], limits: dict[str, Limit], most_rows: int) -> DataFrame:
    """Decisions on sequences that are too long for one task: time is cut into turns of some ``most_rows`` rows, which are taken one
    after another, each from the states that the one before left. So no task sorts or holds more than a turn's rows,
    and those of a single moment."""
    turns = -(-rows // most_rows)
    cuts = sorted(set(met.agg(F.percentile_approx("us", [k / turns for k in range(1, turns)], 100 * turns)).first()[0]))
    ordered = written(met.repartitionByRange(4 * turns, "us"), "composed-turns")
    found, states = [], None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        here = ordered if low is None else ordered.filter(F.col("us") > low)
        here = here if high is None else here.filter(F.col("us") <= high)
        out = written(_decided(here, reservations, limits, states, high is None), "composed-turn")
        states = out.filter("state is not null").select("group", "piece", "state", *[F.lit(0).cast("long").alias(c) for c in ("job_id", "us", "hold_us")])
        found.append(out.filter("state is null").select(*_DECIDED))
    return functools.reduce(DataFrame.unionByName, found)
