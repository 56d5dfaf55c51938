"""Outcomes in one pass against the single transitions; progress in any order and grouping against a plain model."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from jobloom.operators import actors
from jobloom.plans import outcomes, transitions
from jobloom.streaming.progress import REPORTS, Ledger

NOW = "2024-01-20 00:00:00"
T = datetime(2024, 1, 20)
JOBS = """id long, actor string, queue string, status string, attempt int, max_attempts int, retry_kind string, scheduled_at timestamp_ntz, started_at timestamp_ntz, finished_at timestamp_ntz,
  schedule_to_close timestamp_ntz, locked_by_worker long, lock_expires_at timestamp_ntz, cancel_phase int, metadata string"""
DELAYS = {"succeeded": None, "cancelled": None, "failed": None, "retry": 60.0, "snoozed": 30.0, "retry_after": 20.0, "retry_after_free": 0.0, "actor_not_found": 10.0, "reservation_denied": 5.0, None: None, "odd": None}


def jobs(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        close = rng.choice([None, T, T + timedelta(seconds=rng.choice([5, 10, 20, 30, 60])), T - timedelta(hours=1), T + timedelta(days=1)])
        meta = rng.choice(["{}", '{"snooze_count": 2}', '{"snooze_count": "3", "x": null}', '{"awaiting": "slot"}'])
        status = rng.choice(["running"] * 8 + ["pending", "failed"])
        rows.append((i, rng.choice("ab"), "q", status, rng.choice([1, 2, 3]), 3, rng.choice(["transient", "indefinite", "non_retryable"]), T, T, None, close, rng.choice([1, 2]), T, 0, meta))
    return spark.createDataFrame(rows, JOBS)


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(5)
    df = jobs(spark)
    kinds = {i: rng.choice([*DELAYS, *["retry"] * 8]) for i in range(400)}
    rows = [(i, k, '{"r": 1}' if k == "succeeded" else None, "Boom" if k in ("retry", "failed") else None, DELAYS[k], "api" if k == "reservation_denied" else None) for i, k in kinds.items()]
    told = spark.createDataFrame(rows + [(999, "failed", None, "Gone", None, None), (None, "failed", None, None, None, None)], "id long, outcome string, result string, error_class string, delay double, bucket string")
    return df, kinds, told


def shown(found, kind):
    rows = {r.id: (r.status, str(r.scheduled_at), str(r.finished_at), r.max_attempts, r.error_class if "error_class" in found.rows.columns else None, json.loads(r.metadata)) for r in found.rows.collect()}
    attempts = sorted((r.job_id, r.attempt, r.outcome, r.error_class) for r in found.attempts.collect())
    events = sorted((r.job_id, r.detail) for r in found.events.collect())
    return rows, attempts, events


def test_mixed_batch_equals_single_transitions(case):
    df, kinds, told = case
    config = df.sparkSession.createDataFrame([("a", 60.0)], "actor string, result_ttl double")
    mixed = shown(outcomes.apply_outcomes(df, told, NOW, 1, config), None)
    single = {
        "succeeded": lambda d: transitions.succeed(d, config, NOW, 1),
        "cancelled": lambda d: transitions.cancel(d, NOW, 1),
        "failed": lambda d: transitions.fail(d, NOW, 1, "Boom"),
        "snoozed": lambda d: transitions.snooze(d, NOW, 30.0, 1),
        "retry_after": lambda d: transitions.retry_after(d, NOW, 20.0, True, 1),
        "retry_after_free": lambda d: transitions.retry_after(d, NOW, 0.0, False, 1),
        "actor_not_found": lambda d: transitions.snooze(d, NOW, 10.0, 1, count=False),
        "reservation_denied": lambda d: transitions.deny(d, NOW, 5.0, "api", 1),
    }
    for kind, make in single.items():
        ids = [i for i, k in kinds.items() if k == kind]
        want = shown(make(df.filter(F.col("id").isin(ids))), kind)
        assert {i: v for i, v in mixed[0].items() if i in ids} == want[0], kind
        assert [a for a in mixed[1] if a[0] in ids] == want[1], kind
        assert [e for e in mixed[2] if e[0] in ids] == want[2], kind
    retried = [i for i, k in kinds.items() if k == "retry"]
    some = df.filter(F.col("id").isin(retried))
    decided = transitions.classified(some.withColumn("non_retryable_type", F.lit(False)).withColumn("payload_error", F.lit(False)), NOW, F.lit(60.0)).filter("status = 'running' and locked_by_worker = 1")
    again = [r.id for r in decided.filter("decision = 'retry'").collect()]
    dead = [r.id for r in decided.filter("decision <> 'retry'").collect()]
    assert again and dead
    want = shown(transitions.retry(some.filter(F.col("id").isin(again)), NOW, 60.0, 1, "Boom"), "retry"), shown(transitions.fail(some.filter(F.col("id").isin(dead)), NOW, 1, "Boom"), "fail")
    for part in range(3):
        got = {i: v for i, v in mixed[0].items() if i in retried} if part == 0 else [x for x in mixed[part] if x[0] in retried]
        assert got == ({**want[0][0], **want[1][0]} if part == 0 else sorted(want[0][part] + want[1][part]))
    nothing = [i for i, k in kinds.items() if k in (None, "odd")]
    assert nothing and all(mixed[0][i][0] == "running" for i in nothing if i in mixed[0]) and not [a for a in mixed[1] if a[0] in nothing]


def test_outcomes_once_for_each_job_with_progress_and_children(spark):
    df = jobs(spark, 6, 1).withColumn("status", F.lit("running")).withColumn("locked_by_worker", F.lit(1).cast("long")).withColumn("schedule_to_close", F.lit(None).cast("timestamp_ntz"))
    df = df.withColumn("progress_seq", F.lit(4)).withColumn("progress_state", F.when(F.col("id") % 2 == 0, '{"a":1}'))
    rows = [(0, "succeeded", "x" * 65_537, None, 9, '{"b":2}', None), (1, "succeeded", "{}", None, None, None, [("a", "{}"), ("b", None)]), (2, "failed", None, "E", 7, "nonsense", [("a", "{}")]), (3, "cancelled", None, None, None, None, None), (3, "failed", None, "E", None, None, None)]
    told = spark.createDataFrame(rows, "id long, outcome string, result string, error_class string, progress_seq int, progress_state string, children array<struct<actor:string,payload:string>>")
    found = outcomes.apply_outcomes(df, told, NOW)
    got = {r.id: (r.branch, r.error_class, r.progress_seq, r.progress_state) for r in found.rows.collect()}
    large = "retries_failed" if df.first().retry_kind == "non_retryable" or (df.first().retry_kind == "transient" and df.first().attempt == 3) else "retried"
    assert got == {0: (large, "ResultTooLarge", 9, '{"a":1,"b":2}'), 1: ("succeeded", None, 4, None), 2: ("failed", "E", 7, '{"a":1}'), 3: ("cancelled", None, 4, None)}
    assert [tuple(r) for r in found.children.orderBy("ordinal").collect()] == [(1, 0, "a", "{}"), (1, 1, "b", None)]
    assert found.apply(df).count() == 6 and {r.job_id for r in found.exhausted.collect()} >= {2}
    assert found.apply(df).filter("id > 3 and status <> 'running'").count() == 0


def test_handlers_say_how_they_end(spark):
    def ends(payload):
        if payload["k"] == 0:
            raise actors.SlotsBusy(2, "mail")
        if payload["k"] == 1:
            raise actors.RetryAfter(1, consume=False)
        return actors.Children({"k": 2}, [("b", {"z": 1})])

    df = spark.createDataFrame([(k, "a", json.dumps({"k": k})) for k in range(3)] + [(3, "nobody", None)], "id long, actor string, payload string")
    got = {r.id: (r.outcome, r.delay, r.bucket, r.children) for r in actors.performed(df, {"a": actors.Actor("a", ends)}).collect()}
    assert got[0][:3] == ("reservation_denied", 2.0, "mail") and got[1][:2] == ("retry_after_free", 1.0) and got[3][:2] == ("actor_not_found", 10.0)
    assert [tuple(c) for c in got[2][3]] == [("b", '{"z": 1}')]


def reports(rng, n, batch=0):
    states = [None, "{}", "no", '{"a": %d}' % batch, '{"a": null, "b c": "\\"q\\""}', '{"b c": [1, {"x": true}]}']
    return [(rng.randrange(4), rng.choice([1, 1, 1, 2]), 100 * batch + k, rng.choice([0, 1, 5, None]), rng.choice(states)) for k in range(n)]


def model(rows, seqs, states):
    """One report after another, by turn."""
    for job, worker, _, delta, state in sorted(rows, key=lambda r: r[2]):
        if worker != 1:
            continue
        seqs[job] = seqs.get(job, 0) + (delta or 0)
        try:
            states.setdefault(job, {}).update(json.loads(state or "{}"))
        except ValueError:
            pass
    return seqs, states


def test_progress_adds_up_in_any_order_and_grouping(spark, tmp_path):
    rng = random.Random(8)
    base = jobs(spark, 4).withColumn("status", F.when(F.col("id") == 3, "failed").otherwise("running")).withColumn("locked_by_worker", F.lit(1).cast("long"))
    base = base.withColumn("progress_seq", F.lit(5)).withColumn("progress_state", F.lit('{"a": 0, "old": [1]}'))
    rows = reports(rng, 60)
    seqs, states = model(rows, dict.fromkeys(range(4), 5), {i: {"a": 0, "old": [1]} for i in range(4)})
    df = spark.createDataFrame(rows, REPORTS).repartition(3)
    got = {r.id: (r.progress_seq, json.loads(r.progress_state)) for r in transitions.flush_progress(base, df).collect()}
    assert got == {i: (seqs[i], states[i]) for i in range(3)}

    ledger, chunks = Ledger(spark, str(tmp_path / "l")), [rows[k::5] for k in range(5)]
    for n in (3, 0, 1):
        ledger.add(spark.createDataFrame(chunks[n], REPORTS), n)
    ledger.add(spark.createDataFrame(chunks[1], REPORTS), 1)  # a repeated batch
    assert ledger.batches() == [0, 1, 3]
    ledger.add(spark.createDataFrame(chunks[2], REPORTS), 2)
    ledger.compact()
    assert ledger.batches() == [] and ledger.covered() == 3
    ledger.add(spark.createDataFrame(chunks[3], REPORTS), 3)  # folded before
    ledger.add(spark.createDataFrame(chunks[4], REPORTS), 4)
    assert ledger.batches() == [4]
    got = {r.id: (r.progress_seq, json.loads(r.progress_state)) for r in transitions.flush_parts(base, ledger.parts()).collect()}
    assert got == {i: (seqs[i], states[i]) for i in range(3)}
    assert Ledger(spark, str(tmp_path / "none")).parts().count() == 0


def test_snoozes_count(spark):
    df = jobs(spark, 40).withColumn("status", F.lit("running")).withColumn("schedule_to_close", F.lit(None).cast("timestamp_ntz"))
    one = transitions.snooze(df, NOW, 0.0).apply(df).withColumn("status", F.lit("running"))
    two = {r.id: json.loads(r.metadata) for r in transitions.snooze(one, NOW, 0.0).rows.collect()}
    for r in df.collect():
        old = json.loads(r.metadata)
        assert two[r.id] == old | {"snooze_count": int(old.get("snooze_count", 0)) + 2}
    kept = transitions.retry_after(df, NOW, 1.0, consume=False).rows
    assert {r.id: json.loads(r.metadata) for r in kept.collect()} == {r.id: json.loads(r.metadata) for r in df.collect()}
    noted = transitions.snooze(df, NOW, 1.0, metadata='{"why": 1}', count=True).rows.filter("id = 0").first()
    assert json.loads(noted.metadata)["why"] == 1 and "snooze_count" in json.loads(noted.metadata)


def test_reports_are_dealt_before_they_are_sorted(spark, tmp_path, monkeypatch):
    from jobloom.streaming import progress

    spread = []
    monkeypatch.setattr(progress, "progress_parts", lambda df, real=progress.progress_parts: spread.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    Ledger(spark, str(tmp_path / "l")).add(spark.createDataFrame([(1, 1, 1, 1, "{}")], REPORTS), 0)
    assert "RepartitionByExpression [job_id" in spread[0]
