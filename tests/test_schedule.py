"""Schedules against a walk over all minutes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from siltstone.operators.schedule import Schedule, bits, due_runs

UTC = dt.UTC
TEXTS = ["0 3 * * *", "*/15 8-10 * * mon-fri", "30 4 1,15 * 5", "0 0 29 2 *", "5-7/2 */6 * jan,mar 0", "0 12 * * 7", "59 23 31 12 *"]


def by_hand(text, at):
    """The rules of the five fields, without bit sets."""
    m, h, d, mo, w = text.split()

    def ok(field, value, names=()):
        for part in field.split(","):
            span, _, step = part.partition("/")
            num = lambda t: names.index(t) + (1 if len(names) == 12 else 0) if t in names else int(t)
            if span == "*":
                lo, hi = (0 if value >= 0 else 0), 99
                lo = 1 if field in (d, mo) and field != "*" and not names else 0
                if (value - lo) % int(step or 1) == 0:
                    return True
                continue
            a, _, b = span.partition("-")
            lo, hi = num(a), num(b) if b else 99 if step else num(a)
            if lo <= value <= hi and (value - lo) % int(step or 1) == 0:
                return True
        return False

    months, days = "jan feb mar apr may jun jul aug sep oct nov dec".split(), "sun mon tue wed thu fri sat".split()
    weekday = ok(w, at.isoweekday() % 7, days) or (at.isoweekday() == 7 and ok(w, 7, days))
    monthday = ok(d, at.day)
    day = (monthday or weekday) if d[0] != "*" and w[0] != "*" else (monthday and weekday)
    return ok(m, at.minute) and ok(h, at.hour) and ok(mo, at.month, months) and day


@pytest.mark.parametrize("text", TEXTS)
def test_fires_next_and_previous(text):
    s, start = Schedule.parse(text), dt.datetime(2024, 2, 20, tzinfo=UTC)
    minutes = [start + dt.timedelta(minutes=k) for k in range(60 * 24 * 15)]
    fires = [t for t in minutes if by_hand(text, t)]
    assert [t for t in minutes if s.fires(t)] == fires
    for t in minutes[::997]:
        later, earlier = [f for f in fires if f > t], [f for f in fires if f <= t]
        assert not later or s.after(t) == later[0]
        assert not earlier or s.before(t + dt.timedelta(seconds=30)) == earlier[-1]
    if fires:
        assert s.after(fires[0]) != fires[0] and s.before(fires[0]) == fires[0]


def test_rare_and_wrong_schedules():
    assert Schedule.parse("0 0 29 2 *").after(dt.datetime(2097, 1, 1, tzinfo=UTC)) == dt.datetime(2104, 2, 29, tzinfo=UTC)
    assert Schedule.parse("0 0 30 2 *").after(dt.datetime(2026, 1, 1, tzinfo=UTC)) is None
    assert bits("1-5/2,4", "hour") == 0b111010 and bits("7", "weekday") == 1
    for bad in ("60 * * * *", "* * * *", "*/0 * * * *", "5-3 * * * *", "x * * * *", "* * 0 * *"):
        with pytest.raises(ValueError):
            Schedule.parse(bad)


def test_missed_fires_are_one_and_late_ones_wait():
    s, at = Schedule.parse("0 * * * *"), lambda h, m=0: dt.datetime(2026, 1, 5, h, m, tzinfo=UTC)
    assert s.due(at(3), at(9, 20)) == at(9) and s.due(at(9), at(9, 20)) is None and s.due(None, at(9, 59)) == at(9)
    daily = Schedule.parse("0 3 * * *")
    assert daily.due(None, at(4)) == at(3) and daily.due(None, at(4, 1)) is None and daily.due(at(3), at(3, 30)) is None


def test_due_runs_of_a_log(spark):
    log = spark.createDataFrame([("a", dt.datetime(2026, 1, 5, 2, 0, tzinfo=UTC)), ("a", dt.datetime(2026, 1, 5, 3, 0, tzinfo=UTC)), ("b", dt.datetime(2026, 1, 4, 3, 0, tzinfo=UTC))], "connector string, started_at timestamp")
    now = dt.datetime(2026, 1, 5, 3, 10, tzinfo=UTC)
    got = {r.connector: (r.fire, r.next) for r in due_runs({"a": "0 3 * * *", "b": "0 3 * * *", "c": "5 */2 * * *", "d": None}, log, now).collect()}
    day = lambda d, h, m=0: dt.datetime(2026, 1, d, h, m)
    assert got == {"a": (None, day(6, 3)), "b": (day(5, 3), day(6, 3)), "c": (None, day(5, 4, 5))}
    assert due_runs({}, log, now).count() == 0


def test_expression_is_the_same_as_the_walk(spark):
    start = dt.datetime(2024, 2, 27, tzinfo=UTC)
    minutes = spark.range(60 * 24 * 4).select(F.timestamp_seconds(F.col("id") * 60 + int(start.timestamp())).alias("t"))
    for text in TEXTS:
        s = Schedule.parse(text)
        want = [start + dt.timedelta(minutes=k) for k in range(60 * 24 * 4) if s.fires(start + dt.timedelta(minutes=k))]
        assert [r.t.replace(tzinfo=UTC) for r in minutes.where(s.matches(F.col("t"))).orderBy("t").collect()] == want
