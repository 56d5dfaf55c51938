"""Sequences cut at rests, trailing counts, percentiles, groups of names and jobs that need several limits, each against a
plain model."""

import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobloom.operators import composition, graph, ratelimit, selection, sequences
from jobloom.operators.composition import Limit

START = datetime(2024, 1, 1)


def requests(spark, rows):
    return spark.createDataFrame([(b, START + timedelta(seconds=s), i) for i, (b, s) in enumerate(rows)], "bucket string, ts timestamp_ntz, request_id long").repartition(3)


def bursts(seed, n=300, buckets=("a", "b", None)):
    rng, out = random.Random(seed), []
    for b in buckets:
        at = 0.0
        for _ in range(n if b == "a" else n // 10):
            at += rng.choice([0, 0.25, 1, 3, 10, 31, 60, 200])
            out.append((b, at))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_pieces_decide_like_the_whole(spark, seed):
    df = requests(spark, bursts(seed))
    steps = {
        "tokens": (lambda s, t: ratelimit.token_bucket(s, t, 3.0, 0.1), 40.0),
        "window": (lambda s, t: ratelimit.window_log(s, t, 2, 30.0), 31.0),
        "gcra": (lambda s, t: ratelimit.gcra(s, t, 3, 30.0), 31.0),
    }
    for step, fresh in steps.values():
        whole = sorted(map(tuple, ratelimit.replayed(df, step).collect()), key=repr)
        assert sorted(map(tuple, ratelimit.replayed(df, step, fresh).collect()), key=repr) == whole and {w[2] for w in whole} == {True, False}
    public = [(ratelimit.fixed_tokens(df, 3.0, 0.1), "tokens"), (ratelimit.sliding_log(df, 2, 30.0), "window"), (ratelimit.gcra_limit(df, 3, 30.0), "gcra")]
    for found, name in public:
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, ratelimit.replayed(df, steps[name][0]).collect()), key=repr)
    assert ratelimit.fixed_tokens(df, 3.0, 0.0).count() == df.count()


def test_one_bucket_is_many_tasks(spark):
    df = requests(spark, [("hot", 100.0 * (i // 20) + i % 20) for i in range(2000)])
    rows = df.select("bucket", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    pieces = sequences.with_pieces(rows, ["bucket"], 40_000_000)
    assert pieces.select("piece").distinct().count() == 100
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spread = pieces.repartition("bucket", "piece").groupBy(F.spark_partition_id()).count().collect()
        plan = ratelimit.sliding_log(df, 2, 30.0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(spread) == 4 and max(r["count"] for r in spread) < 1000
    assert "hashpartitioning(bucket" in plan and "piece" in plan


def test_sessions_and_cells_against_spark(spark):
    df = requests(spark, bursts(4)).filter("bucket is not null")
    want = {(r.bucket, r.w.start, r.w.end, r.n) for r in df.groupBy("bucket", F.session_window("ts", "30 seconds").alias("w")).agg(F.count("*").alias("n")).collect()}
    rows = df.select("bucket", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    got = {(r.bucket, START + timedelta(microseconds=r.first_us - 1704067200000000), START + timedelta(microseconds=r.last_us + 30_000_000 - 1704067200000000), r.n) for r in sequences.sessions(rows, ["bucket"], 30_000_000).collect()}
    assert got == want and len(want) > 20
    assert sequences.sessions(rows.limit(0), ["bucket"], 5).count() == 0


@pytest.mark.parametrize("back,parts", [(30.0, 8), (7.0, 3), (0.000007, 4), (1000.0, 1)])
def test_trailing_counts(spark, back, parts):
    data = bursts(6)
    got = {r.request_id: (r.in_window, r.oldest_us) for r in ratelimit.offered_load(requests(spark, data), back, parts).collect()}
    at = {i: (b, round((START - datetime(1970, 1, 1)).total_seconds() * 1_000_000 + s * 1e6)) for i, (b, s) in enumerate(data)}
    for i, (b, t) in at.items():
        inside = [u for c, u in at.values() if c == b and t - int(back * 1e6) < u <= t]
        assert got[i] == (len(inside), min(inside)), (i, b, t)


@pytest.mark.parametrize("bins,small", [(1024, 4096), (4, 3), (2, 1)])
def test_percentiles_are_exact(spark, bins, small):
    rng = random.Random(9)
    groups = {"even": [rng.randrange(1000) for _ in range(300)], "skew": [rng.choice([1, 1, 1, 2, 10**15]) for _ in range(200)] + [-(10**12)], "one": [7], "same": [3] * 50, None: [rng.gauss(0, 1e-6) for _ in range(99)]}
    rows = [(k, None if k == "one" and v is None else float(v)) for k, vs in groups.items() for v in vs] + [("even", None), ("none", None)]
    counted = spark.createDataFrame(rows, "k string, v double").groupBy("k", "v").agg(F.count("*").alias("n"))
    got = {r.k: (r.p0, r.p50, r.p95, r.p100) for r in selection.percentiles(counted, ["k"], {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}, bins, small).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert got[k] == pytest.approx(tuple(np.percentile(np.array(vs, dtype=float), [0, 50, 95, 100])), rel=1e-12, abs=1e-18)


def test_groups_of_names(spark):
    rng = random.Random(2)
    links = [(f"n{rng.randrange(200):03d}", f"n{rng.randrange(200):03d}") for _ in range(120)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(90)] + [("hub", f"s{i}") for i in range(50)] + [("x", "x"), (None, "y")]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    got = {r.name: r.root for r in graph.groups(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {x: root(x) for x in parent}


class Rules:
    """Taken from the rules, with one book for everything: reservations in order, then limits; a denial undoes all."""

    def __init__(self, places, limits):
        self.places, self.limits = places, limits
        self.slots, self.log, self.tokens, self.tat = {}, {}, {}, {}

    def ask(self, now, reservations, limits, hold):
        undo = []
        for r in reservations:
            cap = self.places.get(r, self.places.get(r.partition(":")[0]))
            if cap is None:
                break
            busy = self.slots.setdefault(r, [])
            busy[:] = [u for u in busy if u > now]
            if len(busy) == cap:
                break
            busy.append(now + hold)
            undo.append(lambda busy=busy, u=now + hold: busy.remove(u))
        else:
            for name in limits:
                kind, size, rate = self.limits[name]
                if kind == "tokens":
                    have, last = self.tokens.get(name, (size, now))
                    have = min(size, have + (now - last) / 1e6 * rate)
                    self.tokens[name] = (have, now)
                    if have < 1:
                        break
                    self.tokens[name] = (have - 1, now)
                    undo.append(lambda n=name, s=size: self.tokens.__setitem__(n, (min(s, self.tokens[n][0] + 1), now)))
                elif kind == "window":
                    log = self.log.setdefault(name, [])
                    log[:] = [u for u in log if u > now - rate * 1e6]
                    if len(log) >= size:
                        break
                    log.append(now)
                    undo.append(lambda log=log: log.remove(now))
                else:
                    gap = rate * 1e6 / size
                    before = self.tat.get(name)
                    tat = max(now, before if before is not None else now)
                    if now < tat + gap - rate * 1e6:
                        break
                    self.tat[name] = tat + gap
                    undo.append(lambda n=name, b=before: self.tat.__setitem__(n, b) if b is not None else self.tat.pop(n))
            else:
                return None
            for back in reversed(undo):
                back()
            return name
        for back in reversed(undo):
            back()
        return r


@pytest.mark.parametrize("seed,holds", [(1, None), (2, 60_000_000), (3, 60_000_000)])
def test_composition_follows_the_rules(spark, seed, holds):
    rng = random.Random(seed)
    places = {"r1": 2, "r2": 1, "seat": 1}
    limits = {"api": ("tokens", 2.0, 0.25), "log": ("window", 3, 16.0), "pace": ("gcra", 2, 8.0), "own": ("tokens", 1.0, 0.5)}
    rows, at = [], 0
    for i in range(400):
        at += rng.choice([0, 1, 1, 2, 5, 20, 400 if rng.random() < 0.1 else 1]) * 1_000_000
        res = rng.sample(["r1", "r2", f"seat:{rng.randrange(3)}"], rng.randrange(3))
        rows.append((i, at, rng.choice([res, res, None]), rng.sample(list(limits), rng.randrange(4)), rng.choice([4, 60]) * 1_000_000))
    book, want = Rules(places, limits), {}
    for i, us, res, lim, hold in sorted(rows, key=lambda r: (r[1], r[0])):
        want[i] = book.ask(us, res or [], lim, hold)
    df = spark.createDataFrame(rows, "job_id long, us long, reservations array<string>, limits array<string>, hold_us long").repartition(4)
    got = {r.job_id: r for r in composition.all_or_nothing(df, places, {k: Limit(*v) for k, v in limits.items()}, holds).collect()}
    assert {i: r.denied_by for i, r in got.items()} == want and len(Counter(want.values())) > 5
    assert all(r.allowed == (r.denied_by is None) and (r.retry_after is None) == r.allowed for r in got.values())


def test_long_sequences_are_replayed_in_turns(spark, monkeypatch):
    rng = random.Random(4)
    limits = {"api": ("tokens", 3.0, 0.25), "log": ("window", 5, 16.0), "pace": ("gcra", 4, 8.0)}
    # Two long groups and forty short ones; ids beyond the whole numbers that a float holds.
    rows = [(2**60 + i, rng.randrange(900) * 1_000_000, [rng.choice(["r1", f"seat:{i % 3}"])] if i % 3 else [f"own:{i}"] if i % 5 else ["r2"], ["api", "log"] if i % 3 else ["pace"] if i % 5 == 0 else [], rng.choice([4, 60]) * 1_000_000) for i in range(600)]
    places = {"r1": 2, "r2": 1, "seat": 1, "own": 1}
    book, want = Rules(places, limits), {}
    for i, us, res, lim, hold in sorted(rows, key=lambda r: (r[1], r[0])):
        want[i] = book.ask(us, res, lim, hold)
    sizes, real = [], composition._decided

    def counted(given, *rest):
        sizes.append(given.groupBy("group").count().agg(F.max("count")).first()[0])
        return real(given, *rest)

    monkeypatch.setattr(composition, "_decided", counted)
    df = spark.createDataFrame(rows, "job_id long, us long, reservations array<string>, limits array<string>, hold_us long").repartition(4)
    got = composition.all_or_nothing(df, places, {k: Limit(*v) for k, v in limits.items()}, most_rows=35).collect()
    assert len(got) == 600 and {r.job_id: r.denied_by for r in got} == want and len(set(want.values())) > 4
    assert len(sizes) > 10 and max(sizes) <= 80


def test_a_shared_limit_counts_once(spark):
    rows = [(i, i, [f"r{i}"], ["api"], 10) for i in range(3)] + [(9, 5, None, None, 1), (10, 6, [None], [], 1), (11, 7, ["nobody"], [], 1), (12, 8, [], ["nothing"], 1)]
    df = spark.createDataFrame(rows, "job_id long, us long, reservations array<string>, limits array<string>, hold_us long")
    got = {r.job_id: (r.allowed, r.denied_by, r.source) for r in composition.all_or_nothing(df, {"r0": 1, "r1": 1, "r2": 1}, {"api": Limit("tokens", 1.0, 0.0)}).collect()}
    assert got == {0: (True, None, None), 1: (False, "api", "rate_limit"), 2: (False, "api", "rate_limit"), 9: (True, None, None), 10: (True, None, None), 11: (False, "nobody", "unknown"), 12: (False, "nothing", "unknown")}
    empty = composition.all_or_nothing(df.limit(0), {}, {}, 5)
    assert empty.count() == 0


def test_states_after_the_last_request(spark):
    df = requests(spark, [("a", 0), ("a", 1), ("b", 2)])
    states = ratelimit.token_states(df, 2.0, 0.5)
    got = {r.bucket: r.tokens for r in states.collect()}
    assert got == {"a": 0.5, "b": 1.0}
    at = lambda s: 1704067200000000 + int(s * 1e6)
    back = ratelimit.refunded(states, spark.createDataFrame([("a", at(2), 1.0), ("a", at(1), 5.0), ("z", at(1), 1.0)], "bucket string, at_us long, tokens double"), 2.0, 0.5)
    assert {r.bucket: (r.at_us, r.tokens) for r in back.collect()} == {"a": (at(2), 2.0), "b": (at(2), 1.0)}
    assert {r.bucket: (r.tokens, r.exhausted) for r in ratelimit.peeked(ratelimit.reset(states, df.filter("bucket = 'b'")), F.lit(at(1.5)), 2.0, 0.5).collect()} == {"a": (0.75, False)}
