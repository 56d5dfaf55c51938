"""Helpers, slots, schedules and enqueueing against small models in plain Python."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from jobloom.functions import columns as C
from jobloom.plans import enqueue, lifecycle, schedules

NOW = "2024-01-20 00:00:00"


def json_text(rng, depth=0):
    value = lambda: rng.choice([None, True, False, 0, -3, 2.5, "x", "é\"", [1, [None]], {}, {"k": rng.randrange(9)}])
    return json.dumps({k: value() for k in rng.sample("abcdef", rng.randrange(0, 5))})


def test_merge_keeps_types(spark):
    rng = random.Random(2)
    pairs = [(json_text(rng), json_text(rng)) for _ in range(200)] + [("{}", None), (None, '{"a":1}'), ('{"singleton": true}', '{"n": 1}')]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", C.merged(F.col("a"), F.col("b")).alias("m"), C.json_true(C.merged(F.col("a"), F.col("b")), "singleton").alias("s")).collect():
        if r.b is None:
            assert r.m == r.a
            continue
        want = json.loads(r.a or "{}") | json.loads(r.b)
        assert json.loads(r.m) == want and list(json.loads(r.m)) == sorted(want)
        assert r.s == (want.get("singleton") is True)


@pytest.mark.parametrize("before, after", [("{}", 1), ('{"n": 4}', 5), ('{"n": "4"}', 5), ('{"n": [4]}', 1), ('{"n": "x"}', 1), ('{"n": null}', 1)])
def test_counts_go_up_as_integers(spark, before, after):
    got = spark.createDataFrame([(before,)], "m string").select(C.counted_up(F.col("m"), "n")).first()[0]
    assert json.loads(got) == {"n": after}


@pytest.mark.parametrize("n", [0, 1999, 2000, 2001, 2500, 123_456])
def test_clipped_text_stays_within_its_limit(spark, n):
    got = spark.createDataFrame([("x" * n,)], "t string").select(C.clipped(F.col("t"))).first()[0]
    if n <= 2000:
        assert got == "x" * n
    else:
        assert len(got) == 2000 and got.endswith(f"\n... ({n - 2000} more characters)")


def test_tags(spark):
    tags = ["abc", "a-b", "é_1", "---", "-ab", "ab-", "a.b", "ab", "", "x" * 255, "x" * 256, "日本語", "a b c", "abc\n", None]
    good = [t is not None and len(t) <= 255 and re.fullmatch(r"\w[\w\-]+\w", t) is not None for t in tags]
    df = spark.createDataFrame([(i, [t]) for i, t in enumerate(tags)] + [(99, None), (100, ["abc", "abd", "abc"])], "i int, t array<string>")
    got = {r.i: r for r in df.select("i", C.tag_problem(F.col("t")).alias("p"), C.clean_tags(F.col("t")).alias("c")).collect()}
    assert [got[i].p is None and got[i].c == [t] for i, t in enumerate(tags)] == good
    assert got[99].c == [] and got[100].c == ["abc", "abd"]


def test_whole_ms_and_cursor(spark):
    df = spark.sql("select timestamp_ntz '2024-01-01 00:00:00.000001' a, timestamp_ntz '2024-03-01 00:00:00.0015' b")
    got = df.select(C.whole_ms(F.col("a"), F.col("b")), C.whole_ms(F.col("b"), F.col("a")), C.cursor(F.lit(2), F.col("a"), F.lit(5)), C.cursor_parts(C.cursor(F.lit(2), F.col("a"), F.lit(5)))[1] == F.col("a")).first()
    assert tuple(got) == (5_184_000_001, -5_184_000_001, "2|2024-01-01T00:00:00.000001|5", True)


def test_ids_differ_and_are_ordered(spark):
    rows = spark.range(0, 3_000_000, 999_999).select(enqueue.ids_from(NOW, F.col("id")).alias("u"), enqueue.short_ids(F.col("id")).alias("s"), "id").orderBy("id").collect()
    assert len({r.u for r in rows}) == len(rows) and [r.u for r in rows] == sorted(r.u for r in rows)
    assert all(re.fullmatch(r"[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-8[0-9a-f]{3}-[0-9a-f]{12}", r.u) for r in rows)
    assert [sum(enqueue.BASE62.index(c) * 62**k for k, c in enumerate(reversed(r.s))) for r in rows] == [r.id for r in rows]


@pytest.mark.parametrize("block", [1 << 15, 4])
def test_enqueue_against_a_loop(spark, monkeypatch, block):
    """Most requests without a key, one actor with nearly all; also when ordinals are counted in small blocks."""
    monkeypatch.setattr(enqueue, "BLOCK", block)
    rng = random.Random(5)
    jobs = [(i, rng.choice(["a", "b"]), "pending", f"i{i}" if i % 3 else None, f"k{i}" if i % 2 else None, "{}") for i in range(10)]
    wants = [(n * 3, "a" if rng.random() < 0.9 else rng.choice(["b", "c"]), None, f"k{rng.randrange(20)}" if rng.random() < 0.3 else None, '{"singleton": true}' if rng.random() < 0.05 else "{}") for n in range(120)]
    caps = {"a": 60, "b": None}
    jdf = spark.createDataFrame(jobs, "id long, actor string, status string, identity_key string, idempotency_key string, metadata string").withColumn("created_at", C.moment(NOW))
    rdf = spark.createDataFrame(wants, "ordinal long, actor string, identity_key string, idempotency_key string, metadata string").withColumn("scheduled_at", F.lit(None).cast("timestamp_ntz"))
    got = {r.ordinal: (r.outcome, r.existing_id) for r in enqueue.enqueue(jdf, rdf, spark.createDataFrame(list(caps.items()), "actor string, max_pending int"), NOW).collect()}
    held, seen, single, before = {j[4]: j[0] for j in jobs if j[4]}, set(), set(), dict.fromkeys("abc", 0)
    for ordinal, actor, _, key, metadata in wants:
        waiting = sum(j[1] == actor for j in jobs) + before[actor]
        one = "true" in metadata
        first = key is None or key not in seen
        seen.add(key)
        if one and actor in single:
            want = "singleton"
        elif caps.get(actor) is not None and waiting >= caps[actor]:
            want = "max_pending"
        else:
            want = "existing" if key in held or not first else "inserted"
        if not (one and actor in single) and key not in held and first:
            before[actor] += 1
        if one:
            single.add(actor)
        assert got[ordinal] == (want, held.get(key)), ordinal


def slot_rows(spark):
    past, later = "2024-01-19 23:00:00", "2024-01-20 01:00:00"
    rows = [("a", 0, 1, 5, later), ("a", 1, 2, 6, past), ("a", 2, None, None, None), ("a", 3, 3, 6, later), ("b", 0, 4, 7, later)]
    return spark.createDataFrame(rows, "bucket_name string, slot_index int, job_id long, held_by_worker_id long, lease_expires_at string").withColumn("lease_expires_at", F.col("lease_expires_at").cast("timestamp_ntz"))


def test_slots_are_taken_in_order_and_released_by_their_holder(spark):
    slots = slot_rows(spark)
    asks = spark.createDataFrame([("a", 30, 103, 9), ("a", 10, 101, 9), ("a", 20, 102, 8), ("b", 1, 104, 9), ("c", 1, 105, 9)], "bucket_name string, ordinal long, job_id long, worker_id long")
    taken, outcomes = lifecycle.acquire_slots(slots, asks, NOW, 60)
    assert sorted((r.bucket_name, r.slot_index, r.job_id, r.held_by_worker_id) for r in taken.collect()) == [("a", 1, 101, 9), ("a", 2, 102, 8)]
    assert {(r.bucket_name, r.ordinal): r.slot_index for r in outcomes.collect()} == {("a", 10): 1, ("a", 20): 2, ("a", 30): None, ("b", 1): None, ("c", 1): None}
    assert lifecycle.acquire_slots(slots.limit(0), asks, NOW, 60)[0].count() == 0
    asked = spark.createDataFrame([("a", 0, 5), ("a", 3, 5), ("b", 0, 7), ("b", 9, 7)], "bucket_name string, slot_index int, worker_id long")
    gone = lifecycle.release_held(slots, asked).collect()
    assert sorted((r.bucket_name, r.slot_index) for r in gone) == [("a", 0), ("b", 0)] and all(r.job_id is None and r.lease_expires_at is None for r in gone)
    jobs = spark.createDataFrame([(2, "running"), (3, "succeeded")], "id long, status string")
    assert [(r.slot_index, str(r.lease_expires_at)) for r in lifecycle.renew_slots(slots, jobs, 6, NOW, 30).collect()] == [(1, "2024-01-20 00:00:30")]


_COLUMNS = "id int, actor string, name string, cron_expr string, timezone string, dst_strategy string, enabled boolean, consecutive_failures int, next_fire_at string, payload_factory string, payload string"


def schedule_rows(spark, *rows):
    return spark.createDataFrame(list(rows), _COLUMNS).withColumn("next_fire_at", F.col("next_fire_at").cast("timestamp_ntz"))


def test_tick_counts_failures_and_switches_off(spark):
    def broken(schedule, now):
        raise RuntimeError("no payload")

    config = spark.createDataFrame([("a", "q", 3)], "actor string, queue string, max_attempts int")
    rows = schedule_rows(
        spark,
        (1, "a", "raises", "* * * * *", "UTC", "skip", True, 0, NOW, "m:f", None),
        (2, "a", "last", "* * * * *", "UTC", None, True, 4, NOW, "m:f", None),
        (3, "z", "actor", "* * * * *", "UTC", "skip", True, 1, NOW, None, "{}"),
        (4, "a", "well", "* * * * *", "UTC", "skip", True, 3, NOW, None, None),
        (5, "a", "off", "* * * * *", "UTC", "skip", False, 0, NOW, None, None),
        (6, "a", "later", "* * * * *", "UTC", "skip", True, 0, "2024-01-20 00:00:01", None, None),
    )
    found = schedules.tick(rows, config, NOW, {"m:f": broken})
    got = {r.id: (r.enabled, r.consecutive_failures, r.last_fire_error, str(r.next_fire_at)) for r in found.rows.collect()}
    assert got == {
        1: (True, 1, "RuntimeError: no payload", NOW),
        2: (False, 5, "RuntimeError: no payload", NOW),
        3: (True, 2, "actor z has no configuration", NOW),
        4: (True, 0, None, "2024-01-20 00:01:00"),
    }
    assert [(j.schedule_id, j.queue, j.payload, j.max_attempts) for j in found.jobs.collect()] == [(4, "q", "{}", 3)]


def test_tick_fires_twice_in_a_repeated_hour(spark):
    """01:30 in New York comes at 05:30 and 06:30 UTC on 2024-11-03; ``allof`` enqueues both."""
    now = "2024-11-02 05:30:00"
    config = spark.createDataFrame([("a", "q", 3)], "actor string, queue string, max_attempts int")
    rows = schedule_rows(spark, *[(i, "a", s, "30 1 * * *", "America/New_York", s, True, 0, now, None, "{}") for i, s in enumerate(["allof", "skip", "firstof", "nonsense"])])
    found = schedules.tick(rows, config, now, {})
    assert {r.id: str(r.next_fire_at) for r in found.rows.collect()} == dict.fromkeys(range(4), "2024-11-03 05:30:00")
    jobs = sorted((j.schedule_id, str(j.scheduled_at), j.status) for j in found.jobs.collect())
    assert jobs == sorted([(i, now, "pending") for i in range(4)] + [(0, "2024-11-03 06:30:00", "scheduled")])


def test_schedules_that_may_not_be(spark):
    rows = schedule_rows(spark, (1, "a", "x", "0 0 * * *", "UTC", "skip", True, 0, NOW, None, None))
    new = lambda *r: spark.createDataFrame([r], "id int, actor string, name string, cron_expr string, timezone string, dst_strategy string, enabled boolean, payload_factory string, payload string")
    with pytest.raises(ValueError, match="that name"):
        schedules.create(rows, new(2, "a", "x", "0 0 * * *", "UTC", "skip", True, None, None), NOW)
    with pytest.raises(ValueError, match="expression"):
        schedules.create(rows, new(2, "a", "y", "nope", "UTC", "skip", True, None, None), NOW)
    with pytest.raises(ValueError, match="expression"):
        schedules.update(rows, spark.createDataFrame([(1, "nope")], "id int, cron_expr string"), NOW)
    assert schedules.delete(rows, rows).count() == 0
    same = schedules.update(rows, spark.createDataFrame([(1, None)], "id int, cron_expr string"), NOW).first()
    assert str(same.next_fire_at) == NOW and same.cron_expr == "0 0 * * *"


def test_guarded_upsert_and_workers(spark):
    old = spark.createDataFrame([("x", "token", 1), ("y", "log", 2)], "b string, kind string, v int")
    new = spark.createDataFrame([("x", "token", 7), ("y", "token", 8), ("z", "token", 9)], "b string, kind string, v int")
    assert sorted(tuple(r) for r in lifecycle.upsert_if_same(old, new, "b", "kind").collect()) == [("x", "token", 7), ("y", "log", 2), ("z", "token", 9)]
