import pytest

from jobloom.plans import dispatch

NOW = "2024-01-20 00:00:00"
JOB = "id long, actor string, queue string, identity_key string, fairness_key string, priority int, status string, attempt int, scheduled_at timestamp_ntz, schedule_to_close timestamp_ntz"


def job(i, actor="a", queue="q", identity=None, fairness=None, priority=0, status="pending", at="2024-01-19 00:00:00", close=None):
    import datetime as d

    read = lambda x: d.datetime.fromisoformat(x) if x else None
    return i, actor, queue, identity, fairness, priority, status, 0, read(at), read(close)


@pytest.fixture(scope="module")
def run(spark):
    def go(jobs, caps, queues=("q",), limit=10, **options):
        df = spark.createDataFrame(jobs, JOB)
        conf = spark.createDataFrame([(a, m) for a, m in caps.items()], "actor string, max_concurrent int")
        return [r.id for r in dispatch.dispatch(df, conf, list(queues), limit, NOW, **options).collect()]

    return go


def test_cap_counts_running(run):
    assert run([job(1, status="running"), job(2), job(3), job(4)], {"a": 2}) == [2]


def test_identity_runs_once(run):
    jobs = [job(1, identity="x"), job(2, identity="x", priority=5), job(3, identity="y"), job(4, identity="z", status="running"), job(5, identity="z")]
    assert sorted(run(jobs, {"a": None})) == [2, 3]


def test_same_identity_of_two_actors(run):
    assert sorted(run([job(1, identity="x"), job(2, actor="b", identity="x")], {"a": None, "b": None})) == [1, 2]


def test_no_queue_no_actor_row(run):
    assert run([job(1)], {"a": None}, queues=()) == []
    assert run([job(1), job(2, actor="b")], {"b": None}) == [2]


def test_deadline_and_schedule(run):
    jobs = [job(1, close="2024-01-19 23:59:59"), job(2, close="2024-01-20 00:00:01"), job(3, at="2024-01-20 00:00:01"), job(4, at=NOW)]
    assert sorted(run(jobs, {"a": None})) == [2, 4]


def test_priority_then_time_then_id(run):
    jobs = [job(3), job(2), job(5, at="2024-01-18 00:00:00"), job(9, priority=1)]
    assert run(jobs, {"a": None}) == [9, 5, 2, 3]


def test_deep_cohort_does_not_starve_another(run):
    jobs = [job(i, fairness="A") for i in range(1, 501)] + [job(1000, fairness="B")]
    assert 1000 in run(jobs, {"a": None}, limit=4, round_robin=True)
    assert 1000 not in run(jobs, {"a": None}, limit=4, round_robin=False)


def test_no_fairness_key_is_one_cohort(run):
    jobs = [job(i) for i in range(1, 11)] + [job(100, fairness="B")]
    assert run(jobs, {"a": None}, limit=2, round_robin=True) == [1, 100]


def test_limit_before_caps_may_give_less(run):
    jobs = [job(i) for i in range(1, 5)] + [job(10 + i, actor="b") for i in range(4)]
    assert len(run(jobs, {"a": 1, "b": None}, limit=4)) < 4


def test_duplicate_queue_names(run):
    assert run([job(1), job(2)], {"a": None}, queues=("q", "q")) == [1, 2]


def test_groups_are_cut_before_the_shuffle(spark):
    df = spark.createDataFrame([job(1)], JOB)
    conf = spark.createDataFrame([("a", 3)], "actor string, max_concurrent int")
    plan = dispatch.dispatch(df, conf, ["q"], 5, NOW)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_claimed_rows(spark):
    df = spark.createDataFrame([job(1)], JOB)
    conf = spark.createDataFrame([("a", None)], "actor string, max_concurrent int")
    row = dispatch.claimed(dispatch.dispatch(df, conf, ["q"], 5, NOW), 3, NOW, 60).first()
    assert (row.status, row.attempt, row.locked_by_worker, str(row.lock_expires_at)) == ("running", 1, 3, "2024-01-20 00:01:00")
