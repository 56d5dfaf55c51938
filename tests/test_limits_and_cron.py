from collections import deque
from datetime import UTC, datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from jobloom.operators import actors, cron, ratelimit

times = st.lists(st.floats(0, 1000), min_size=1, max_size=60).map(sorted)


@given(times, st.integers(1, 20), st.sampled_from([0.0, 0.1, 2.0]))
@settings(max_examples=60, deadline=None)
def test_tokens_stay_within_bounds(at, capacity, refill):
    state, granted = None, 0
    for t in at:
        state, ok, left, wait = ratelimit.token_bucket(state, t, capacity, refill)
        granted += ok
        assert -1e-9 <= left <= capacity and (wait == 0.0 if ok else wait is None or wait > 0)
    assert granted <= capacity + refill * (at[-1] - at[0]) + 1e-6


@given(times, st.integers(1, 5), st.floats(0.5, 50))
@settings(max_examples=60, deadline=None)
def test_log_never_exceeds_its_limit(at, limit, window):
    state, granted = None, []
    for t in at:
        state, ok, _, _ = ratelimit.window_log(state, t, limit, window)
        if ok:
            granted.append(t)
    assert all(sum(t - window < g <= t for g in granted) <= limit for t in at)


@given(times, st.integers(1, 5), st.floats(0.5, 50))
@settings(max_examples=60, deadline=None)
def test_gcra_denials_tell_when_to_come_back(at, limit, window):
    state = None
    for t in at:
        before = state
        state, ok, _, wait = ratelimit.gcra(state, t, limit, window)
        if not ok:
            assert state == before and ratelimit.gcra(state, t + wait + 1e-6, limit, window)[1]


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=60).map(sorted), st.integers(1, 6), st.integers(1, 300), st.data())
@settings(max_examples=60, deadline=None)
def test_log_without_a_refunded_request_is_as_if_it_never_was(at, limit, window, data):
    gone = data.draw(st.integers(0, len(at) - 1))
    with_it, without = deque(), deque()
    for k, t in enumerate(at):
        left, wait = ratelimit.window_peek(with_it, t, limit, window)
        with_it, ok, _, _ = ratelimit.window_log(with_it, t, limit, window)
        assert ok == (left > 0) == (wait == 0)
        if k == gone and ok:
            with_it = ratelimit.window_refund(with_it, t)
        elif k != gone:
            without, other, _, _ = ratelimit.window_log(without, t, limit, window)
            assert ok == other
    assert [t for t in with_it if t > at[-1] - window] == [t for t in without if t > at[-1] - window]
    assert ratelimit.window_refund(deque([1.0]), 2.0) == deque([1.0])


def test_edges_and_refunds():
    assert ratelimit.window_log(deque([0.0]), 10.0, 1, 10.0)[1] and not ratelimit.window_log(deque([0.0]), 10.0, 1, 10.0, inclusive=True)[1]
    assert ratelimit.token_refund((0.5, 0.0), 1.0, 2.0, 0.25) == (1.75, 1.0)
    assert ratelimit.token_peek((0.0, 0.0), 1.0, 2.0, 0.0) == (0.0, True)
    assert ratelimit.gcra_refund(5.0, 4.0, 5.0) == 4.0 and ratelimit.gcra_refund(6.0, 4.0, 5.0) == 6.0


def fires(expr, zone, after, strategy="skip", n=1):
    at, out = datetime.fromisoformat(after).replace(tzinfo=UTC), []
    for _ in range(n):
        found = cron.next_fires(expr, zone, at, strategy)
        out.append([f.strftime("%m-%d %H:%M") for f in found])
        at = found[-1]
    return out


def test_fields():
    assert fires("*/15 9-17 * * mon-fri", "UTC", "2024-01-19T17:50:00") == [["01-22 09:00"]]
    assert fires("0 0 13 * 5", "UTC", "2024-01-01T00:00:00", n=3) == [["01-05 00:00"], ["01-12 00:00"], ["01-13 00:00"]]
    assert fires("0 0 29 2 *", "UTC", "2024-03-01T00:00:00") == [["02-29 00:00"]]
    assert cron.next_fires("0 0 29 2 *", "UTC", datetime(2024, 3, 1, tzinfo=UTC))[0].year == 2028
    assert cron.next_fires("* * * * * 30", "UTC", datetime(2024, 3, 1, tzinfo=UTC))[0].second == 30
    for bad in ("x", "* * * *", "60 * * * *", "* 24 * * *", "*/0 * * * *", "5-1 * * * *", "* * 0 * *"):
        with pytest.raises(ValueError):
            cron.parsed(bad)
    with pytest.raises(ValueError):
        cron.next_local("0 0 31 2 *", datetime(2024, 1, 1))


def test_clock_changes():
    assert fires("30 2 * * *", "America/New_York", "2024-03-09T12:00:00", n=2) == [["03-11 06:30"], ["03-12 06:30"]]
    assert fires("30 1 * * *", "America/New_York", "2024-11-02T12:00:00", n=2) == [["11-03 05:30"], ["11-04 06:30"]]
    assert fires("30 1 * * *", "America/New_York", "2024-11-02T12:00:00", "allof", n=2) == [["11-03 05:30", "11-03 06:30"], ["11-04 06:30"]]


def test_missed_and_skipped():
    due, now = datetime(2024, 1, 1, tzinfo=UTC), datetime(2024, 1, 3, 12, 30, tzinfo=UTC)
    assert cron.missed("0 * * * *", "UTC", due, now, timedelta(hours=1)) == datetime(2024, 1, 3, 13, tzinfo=UTC)
    assert cron.missed("0 * * * *", "UTC", due, now, timedelta(days=9)) == due
    assert cron.skipped_to("0 * * * *", "UTC", due, now) == datetime(2024, 1, 3, 13, tzinfo=UTC)
    assert cron.problem("* * * * *", "UTC", "{}", "x:y") and cron.problem("* * * * *", "Mars/Base") == "unknown time zone" and cron.problem("* * * * *", "UTC", "{") == "payload is not JSON"
    assert cron.once_a_day(None, now) and not cron.once_a_day(now, now)


def test_outcomes():
    def raises(e):
        def run(p):
            raise e

        return run

    assert actors.outcome(lambda p: p, '{"a": 1}') == ("succeeded", '{"a": 1}', None, None)
    assert actors.outcome(lambda p: p, "{")[2] == "PayloadError"
    assert [actors.outcome(raises(e), None)[0] for e in (actors.Snooze(1), actors.RetryAfter(1), actors.SlotsBusy(1), actors.Rejected(), KeyError())] == ["snoozed", "retry_after", "reservation_denied", "failed", "retry"]


def test_actor_registration():
    @actors.actor("mail", queue="q1", singleton=True)
    def mail(payload):
        return payload

    assert actors.REGISTRY["mail"].queue == "q1" and mail.run({"x": 1}) == {"x": 1}
    assert '"singleton": true' in actors.config_rows({"mail": mail})[0][-1]


def test_simulated_clock(spark):
    jobs = [(1, "q", 0, 0, 10), (2, "q", 5, 1, 10), (3, "q", 0, 1, 10), (4, "q", 9, 100, 1), (5, "r", 0, 7, 1)]
    df = spark.createDataFrame(jobs, "id long, queue string, priority int, scheduled_us long, run_us long")
    got = {r.id: (r.start_us, r.end_us) for r in actors.simulated(df).collect()}
    assert got == {1: (0, 10), 2: (10, 20), 3: (20, 30), 4: (100, 101), 5: (7, 8)}


def test_keyed_reservations(spark):
    at = lambda m: datetime(2024, 1, 1, 0, m)
    df = spark.createDataFrame([("a", at(0)), ("a", at(50)), ("b", at(40)), ("c", at(55)), ("bad key", at(59)), ("old", at(1)), (None, at(3))], "key string, ts timestamp_ntz")
    got = {r.key: (r.name, r.ok, r.evicted) for r in ratelimit.keyed_reservations(df, "u", 2, 30 * 60).collect()}
    assert got == {"a": ("u:a", True, False), "b": ("u:b", False, False), "c": ("u:c", True, False), "bad key": (None, False, False), "old": ("u:old", False, True), None: (None, False, True)}


def test_schedules_of_one_kind_are_worked_out_once(monkeypatch):
    import pandas as pd

    calls = []
    monkeypatch.setattr(cron, "next_fires", lambda *a, real=cron.next_fires: calls.append(a) or real(*a))
    cron._fires_of.cache_clear()
    cron._skipped_of.cache_clear()
    n, at = 300, pd.Timestamp("2024-01-20", tz="UTC")
    exprs = pd.Series(["0 6 * * *", "not a cron", "*/15 * * * *"] * n)
    column = lambda x: pd.Series([x] * 3 * n)
    got = cron._next_udf.func(exprs, column("Europe/Berlin"), column(at), column("skip"))
    assert [x and [t.isoformat() for t in x] for x in got[:3]] == [["2024-01-20T05:00:00+00:00"], None, ["2024-01-20T00:15:00+00:00"]]
    assert got[3:6].tolist() == got[:3].tolist() and len(got) == 3 * n and len(calls) == 3
    calls.clear()
    skips = cron._skipped_udf.func(exprs, column("Europe/Berlin"), column(at - pd.Timedelta("1h")), column(at))
    assert [None if x is pd.NaT else x.isoformat() for x in skips[:3]] == ["2024-01-20T05:00:00+00:00", None, "2024-01-20T00:15:00+00:00"] and len(calls) <= 8
