import datetime as d
import time

import pytest
from pyspark.sql import functions as F

from jobloom.functions import columns as C
from jobloom.operators import actors
from jobloom.plans import enqueue, lifecycle, transitions
from jobloom.sources.state import StateTable

NOW = "2024-01-20 00:00:00"
JOB = "id long, actor string, queue string, status string, attempt int, max_attempts int, retry_kind string, identity_key string, idempotency_key string, scheduled_at timestamp_ntz, started_at timestamp_ntz, finished_at timestamp_ntz, created_at timestamp_ntz, schedule_to_close timestamp_ntz, lock_expires_at timestamp_ntz, locked_by_worker long, cancel_phase int, metadata string"
T = d.datetime.fromisoformat


@pytest.fixture(scope="module")
def make(spark):
    base = dict.fromkeys([c.split()[0] for c in JOB.split(", ")]) | {"actor": "a", "queue": "q", "status": "running", "attempt": 1, "max_attempts": 3, "retry_kind": "transient", "locked_by_worker": 1, "cancel_phase": 0, "metadata": "{}", "created_at": T("2024-01-19 23:00:00"), "scheduled_at": T("2024-01-19 23:00:00"), "started_at": T("2024-01-19 23:00:00"), "lock_expires_at": T("2024-01-19 23:59:00")}

    def go(*rows):
        return spark.createDataFrame([tuple((base | {"id": i + 1} | r).values()) for i, r in enumerate(rows)], JOB)

    return go


def by_id(df, *cols):
    return {r.id: tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


def test_reclaim_and_isolate_agree_on_who_runs_again(make):
    rows = [{"attempt": a, "retry_kind": k} for a in (1, 3) for k in ("transient", "indefinite", "non_retryable")]
    jobs = make(*rows)
    want = by_id(transitions.reclaim(jobs, NOW).rows, "status", "scheduled_at")
    assert want == by_id(transitions.isolate(jobs, NOW, 1).rows, "status", "scheduled_at")
    assert {i: s for i, (s, _) in want.items()} == {1: "pending", 2: "pending", 3: "crashed", 4: "crashed", 5: "crashed", 6: "crashed"}
    assert want[1][1] == T("2024-01-20 00:00:05")
    assert transitions.isolate(jobs, NOW, 1).events.count() == 0 and transitions.reclaim(jobs, NOW).events.count() == 6


def test_cancelling_jobs_have_a_longer_lease(make):
    jobs = make({"cancel_phase": 1, "lock_expires_at": T("2024-01-19 23:58:21")}, {"cancel_phase": 1, "lock_expires_at": T("2024-01-19 23:58:19")}, {"lock_expires_at": T("2024-01-19 23:59:59")}, {"lock_expires_at": T(NOW)})
    assert set(by_id(transitions.reclaim(jobs, NOW).rows, "status")) == {2, 3}


def test_retry_after_has_a_case_that_does_nothing(make):
    late = {"schedule_to_close": T("2024-01-20 00:00:30")}
    jobs = make({}, {"attempt": 3}, {"attempt": 3, "retry_kind": "indefinite"}, {"attempt": 3, "retry_kind": "non_retryable"}, late, {"attempt": 3} | late)
    t = transitions.retry_after(jobs, NOW, 60)
    assert by_id(t.rows, "branch") == {1: "snoozed", 2: "max_attempts_failed", 3: "snoozed", 4: "noop", 5: "deadline_failed", 6: "deadline_failed"}
    assert by_id(t.rows, "status")[4] == "running" and t.attempts.count() == 5
    assert by_id(transitions.retry_after(jobs, NOW, 0, consume=False).rows, "status")[4] == "pending"


def test_retry_event_says_scheduled_either_way(make):
    t = transitions.retry(make({}), NOW, 0)
    assert by_id(t.rows, "status") == {1: "pending"} and '"to":"scheduled"' in t.events.first().detail


def test_snooze_adds_an_attempt_and_merges(make):
    t = transitions.snooze(make({"metadata": '{"a":"1"}'}), NOW, 60, metadata='{"b":"2"}')
    assert by_id(t.rows, "max_attempts", "attempt", "metadata") == {1: (4, 1, '{"a":"1","b":"2"}')}


def test_abandoned_counts_as_cancelled_and_needs_phase_two(make):
    t = transitions.abandon(make({"cancel_phase": 2}, {"cancel_phase": 1}), NOW)
    assert by_id(t.rows, "status") == {1: "abandoned"} and t.attempts.first().outcome == "cancelled"


def test_manual_retry_leaves_abandoned(make, spark):
    jobs = make({"status": "abandoned"}, {"status": "crashed"}, {"status": "succeeded"})
    assert by_id(transitions.retry_by_hand(jobs, jobs.select("id"), NOW).rows, "status") == {2: "pending"}


def test_cancel_request(make):
    jobs = make({"status": "pending"}, {}, {"cancel_phase": 1}, {"status": "failed"})
    t = transitions.request_cancel(jobs, jobs.select("id"), NOW)
    assert by_id(t.rows, "status", "cancel_phase", "initiated") == {1: ("cancelled", 0, True), 2: ("running", 1, True), 3: ("running", 1, False), 4: ("failed", 0, False)}
    assert t.events.count() == 2


def test_apply_keeps_the_rest(make):
    jobs = make({"status": "scheduled"}, {"status": "scheduled", "scheduled_at": T("2024-02-01 00:00:00")})
    after = transitions.promote(jobs, NOW).apply(jobs)
    assert after.columns == jobs.columns and by_id(after, "status") == {1: "pending", 2: "scheduled"}


def test_results_have_a_size_limit(make, spark):
    conf = spark.createDataFrame([("a", 60.0)], "actor string, result_ttl double")
    with pytest.raises(ValueError):
        transitions.succeed(make({}), conf, NOW, result="é" * 32_769)
    assert by_id(transitions.succeed(make({}), conf, NOW).rows, "result_expires_at") == {1: T("2024-01-20 00:01:00")}


def test_illegal_transitions(spark):
    events = spark.createDataFrame([("running", "failed"), ("succeeded", "running"), (None, "pending"), ("abandoned", "pending")], "from_state string, to_state string")
    assert {tuple(r) for r in transitions.illegal(events).collect()} == {("succeeded", "running"), ("abandoned", "pending")}


@pytest.fixture(scope="module")
def ask(spark):
    def go(jobs, rows, cap, **options):
        requests = spark.createDataFrame([(i + 1, "a", r.get("identity"), r.get("key"), r.get("at"), r.get("metadata", "{}")) for i, r in enumerate(rows)], "ordinal int, actor string, identity_key string, idempotency_key string, scheduled_at timestamp_ntz, metadata string")
        conf = spark.createDataFrame([("a", cap)], "actor string, max_pending int")
        return [r.outcome for r in enqueue.enqueue(jobs, requests, conf, NOW, **options).orderBy("ordinal").collect()]

    return go


def test_single_cap_and_batch_cap_differ(make, ask, spark):
    jobs = make({"status": "pending"})
    assert ask(jobs, [{}, {}, {}], 3) == ["inserted", "inserted", "max_pending"]
    requests = spark.createDataFrame([(i, "a", None, None) for i in (1, 2)], "ordinal int, actor string, idempotency_key string, scheduled_at timestamp_ntz")
    conf = spark.createDataFrame([("a", 3)], "actor string, max_pending int")
    assert {r.outcome for r in enqueue.enqueue_batch(jobs, requests, conf, NOW).collect()} == {"max_pending"}


def test_known_key_does_not_bypass_the_cap(make, ask):
    assert ask(make({"status": "pending", "idempotency_key": "k"}), [{"key": "k"}], 1) == ["max_pending"]
    assert ask(make({"status": "pending", "idempotency_key": "k"}), [{"key": "k"}, {"key": "n"}, {"key": "n"}], None) == ["existing", "inserted", "existing"]


def test_unique_comes_before_all_else(make, ask):
    jobs = make({"status": "pending", "identity_key": "u", "created_at": T("2024-01-19 23:59:30")})
    assert ask(jobs, [{"identity": "u"}], 1, unique_for=60) == ["unique"] and ask(jobs, [{"identity": "u"}], 1, unique_for=20) == ["max_pending"]


def test_singleton(make, ask):
    flag = '{"singleton": true}'
    assert ask(make({"metadata": flag}), [{"metadata": flag}, {}], None) == ["singleton", "inserted"]
    assert ask(make({"status": "failed", "metadata": flag}), [{"metadata": flag}, {"metadata": flag}, {"metadata": '{"singleton": "true"}'}], None) == ["inserted", "singleton", "inserted"]


def test_bulk_load_is_all_or_nothing(make, spark):
    rows = lambda *keys: spark.createDataFrame([(k,) for k in keys], "idempotency_key string")
    jobs = make({"idempotency_key": "k"})
    assert enqueue.bulk_load(jobs, rows("a", None, None)).count() == 3
    for bad in (rows("a", "a"), rows("k")):
        with pytest.raises(ValueError):
            enqueue.bulk_load(jobs, bad)


def test_retention_overrides_only_shorten(make, spark):
    old = {"status": "succeeded", "finished_at": T("2024-01-05 00:00:00")}
    jobs = make(old, old | {"actor": "b"}, old | {"actor": "c"}, old | {"finished_at": T("2023-12-21 00:00:00")}, old | {"finished_at": T("2023-12-20 23:59:59")})
    over = spark.createDataFrame([("b", '{"retention_days": "3"}'), ("c", '{"retention_days": "300"}'), ("a", '{"retention_days": "x"}')], "actor string, metadata string")
    assert set(by_id(lifecycle.prunable(jobs, NOW, overrides=over), "actor")) == {2, 5}
    attempts = spark.createDataFrame([(2, 1), (3, 1)], "job_id long, attempt int")
    kept, moved, gone = lifecycle.archive(jobs, attempts, NOW, overrides=over)
    assert kept.count() == 3 and moved.count() == 2 and [r.job_id for r in gone.collect()] == [2]


def test_slots(spark):
    slots = spark.createDataFrame([(1, 0, 5), (1, 1, None), (1, 2, 7), (2, 0, None)], "bucket_name int, slot_index int, job_id long")
    got = {tuple(r) for r in lifecycle.sync_slots(slots, spark.createDataFrame([(1, 1), (3, 2), (2, 0)], "bucket_name int, slots int")).collect()}
    assert got == {(1, 1, "delete"), (1, 2, "keep_held"), (3, 0, "insert"), (3, 1, "insert"), (2, 0, "delete")}
    assert lifecycle.ensure_slots(slots, 9, 0).count() == 0


def test_drift_treats_nulls_as_equal(spark):
    a = spark.createDataFrame([("x", 1, None), ("y", 2, 2)], "actor string, m int, n int")
    b = spark.createDataFrame([("x", 1, None), ("y", None, 2)], "actor string, m int, n int")
    assert [tuple(r) for r in lifecycle.drift(a, b, ["m", "n"]).collect()] == [("y", "m", "2", None)]


def test_columns(spark):
    df = spark.createDataFrame([("a,b,a", "ab"), ("abc,a b c", None)], "tags string, x string")
    assert [r[0] for r in df.select(C.clean_tags(F.split("tags", ","))).collect()] == [None, None]
    ok = spark.createDataFrame([("abc,abd,abc",)], "tags string").select(C.clean_tags(F.split("tags", ","))).first()[0]
    assert ok == ["abc", "abd"]
    assert C.capped_count(1000) == "1,000" and C.capped_count(1001) == "1,000+"
    with pytest.raises(ValueError):
        C.checked_states(["pending", "odd"])
    parts = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(C.cursor_parts(C.cursor(F.lit(3), C.moment(NOW), F.lit(9))))]).first()
    assert tuple(parts) == (3, T(NOW), 9)
    jitter = spark.range(200).select(C.jittered(F.lit(10.0), 0.5, 3, 12.0, 12.0).alias("j")).agg(F.min("j"), F.max("j")).first()
    assert 5 <= jitter[0] < jitter[1] <= 12


def test_overlap_with_null_tags_is_false(spark):
    df = spark.createDataFrame([(["a", None],), (None,), (["b"],)], "t array<string>")
    assert [r[0] for r in df.select(C.overlaps(F.col("t"), ["b"])).collect()] == [False, False, True]


def test_children_of_failed_parents_are_dropped(make, spark):
    jobs = make({"status": "succeeded"}, {"status": "failed"})
    plan = spark.createDataFrame([(1, ["x", "y"]), (2, ["z"])], "parent_id long, payloads array<string>")
    assert {(r.parent_id, r.child, r.payload) for r in enqueue.children(jobs, plan).collect()} == {(1, 0, "x"), (1, 1, "y")}


def test_hooks_never_raise(spark):
    df = spark.createDataFrame([(1, "succeeded"), (2, "failed"), (3, "other")], "id long, outcome string")

    def bad(i, o):
        raise RuntimeError

    assert by_id(actors.hooked(df, {"succeeded": lambda i, o: None, "failed": bad}), "hook") == {1: "called", 2: "RuntimeError", 3: None}


def test_slow_hooks_are_left_behind(spark):
    df = spark.createDataFrame([(1, "succeeded"), (2, "failed")], "id long, outcome string")

    def slow(i, o):
        time.sleep(30)

    assert by_id(actors.hooked(df, {"succeeded": slow, "failed": lambda i, o: None}, seconds=0.5), "hook") == {1: "TimeoutError", 2: "called"}


def test_state_versions(spark, tmp_path):
    table = StateTable(spark, f"file://{tmp_path}/t")
    with pytest.raises(FileNotFoundError):
        table.read()
    table.replace(spark.range(3))
    table.replace(lifecycle.upsert(table.read(), spark.range(2, 5), ["id"]))
    assert sorted(r.id for r in table.read().collect()) == [0, 1, 2, 3, 4] and table.read(1).count() == 3
    table.append(spark.range(9, 10))
    assert table.prune(1) == [1, 2] and table.read().count() == 6
