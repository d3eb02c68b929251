"""Five-field schedules as bit sets: when they fire, what is due after a pause, and how late a run may start.

A schedule is minutes, hours, days, months and weekdays (0 or 7 is Sunday) in
UTC.  Each field is a number whose bits are its values, so that a minute is
tested by five shifts, in Python and as column expressions alike.  If both days
and weekdays are restricted, either will do.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds that a run may start late; one missed by more waits for the next fire.
GRACE = 3600
#: Years within which every schedule that fires at all fires: February 29 can be eight years away.
HORIZON = 9
RANGES = {"minute": (0, 59), "hour": (0, 23), "day": (1, 31), "month": (1, 12), "weekday": (0, 7)}
NAMES = {"month": dict(zip("jan feb mar apr may jun jul aug sep oct nov dec".split(), range(1, 13))), "weekday": dict(zip("sun mon tue wed thu fri sat".split(), range(7)))}


def bits(field: str, kind: str) -> int:
    """The values of a field: ``*``, numbers or names, ranges, steps, and lists of these."""
    low, high = RANGES[kind]
    names, out = NAMES.get(kind, {}), 0
    for part in field.lower().split(","):
        span, slash, step = part.partition("/")
        first, dash, last = span.partition("-")
        try:
            every = int(step) if slash else 1
            number = lambda t: names[t] if t in names else int(t)
            a, b = (low, high) if span == "*" else (number(first), number(last) if dash else high if slash else number(first))
        except ValueError:
            raise ValueError(f"not a {kind} field: {field}") from None
        if every < 1 or not low <= a <= b <= high:
            raise ValueError(f"not a {kind} field: {field}")
        for v in range(a, b + 1, every):
            out |= 1 << (v % 7 if kind == "weekday" else v)
    return out


@dataclass(frozen=True)
class Schedule:
    minute: int
    hour: int
    day: int
    month: int
    weekday: int
    #: Whether days of the month and weekdays are both restricted, so that either will do.
    either: bool

    @classmethod
    def parse(cls, text: str) -> Schedule:
        parts = text.split()
        if len(parts) != 5:
            raise ValueError(f"not five fields: {text}")
        return cls(*[bits(p, kind) for p, kind in zip(parts, RANGES)], not parts[2].startswith("*") and not parts[4].startswith("*"))

    def on(self, day: datetime) -> bool:
        """Whether it fires at all on a day."""
        monthday, weekday = self.day >> day.day & 1, self.weekday >> (day.isoweekday() % 7) & 1
        return bool(self.month >> day.month & 1 and (monthday or weekday if self.either else monthday and weekday))

    def fires(self, at: datetime) -> bool:
        return self.on(at) and bool(self.hour >> at.hour & 1 and self.minute >> at.minute & 1)

    def _times(self) -> list[tuple[int, int]]:
        return [(h, m) for h in range(24) if self.hour >> h & 1 for m in range(60) if self.minute >> m & 1]

    def _search(self, day: datetime, step: int, ok) -> datetime | None:
        times = self._times()[::step]
        for _ in range(366 * HORIZON):
            if self.on(day):
                for h, m in times:
                    if ok(at := day.replace(hour=h, minute=m)):
                        return at
            day += timedelta(days=step)
        return None

    def after(self, at: datetime) -> datetime | None:
        """The first fire later than a time; None if there is none."""
        return self._search(at.replace(hour=0, minute=0, second=0, microsecond=0), 1, lambda t: t > at)

    def before(self, at: datetime) -> datetime | None:
        """The last fire at a time or earlier."""
        return self._search(at.replace(hour=0, minute=0, second=0, microsecond=0), -1, lambda t: t <= at)

    def due(self, last: datetime | None, now: datetime, grace: int = GRACE) -> datetime | None:
        """The fire to run now: the last one since ``last``, whatever was missed between, unless it is more than ``grace`` seconds ago."""
        fire = self.before(now)
        if fire is None or (last is not None and fire <= last) or now - fire > timedelta(seconds=grace):
            return None
        return fire

    def matches(self, at: Column) -> Column:
        """Whether a timestamp's minute is one of a fire, as an expression."""
        has = lambda mask, value: F.call_function("shiftright", F.lit(mask).cast("long"), value.cast("int")).bitwiseAND(F.lit(1)) == 1
        monthday, weekday = has(self.day, F.dayofmonth(at)), has(self.weekday, F.dayofweek(at) - 1)
        days = monthday | weekday if self.either else monthday & weekday
        return has(self.minute, F.minute(at)) & has(self.hour, F.hour(at)) & has(self.month, F.month(at)) & days


def due_runs(schedules: dict[str, str | None], log: DataFrame, now: datetime, grace: int = GRACE) -> DataFrame:
    """(connector, fire, next) of the sources that are to run now, and of all others their next fire.

    ``log`` has connector and started_at of earlier runs, whatever became of
    them; a source without a schedule is run by hand only and not listed.  One
    row is read for each source.
    """
    now = now.astimezone(UTC)
    last = {r["connector"]: r["at"].astimezone(UTC) if r["at"] else None for r in log.where(F.col("connector").isin(*schedules)).groupBy("connector").agg(F.max(F.col("started_at").cast("timestamp")).alias("at")).collect()} if schedules else {}
    rows = []
    for name, text in schedules.items():
        if text:
            s = Schedule.parse(text)
            rows.append((name, s.due(last.get(name), now, grace), s.after(now)))
    return log.sparkSession.createDataFrame(rows, "connector string, fire timestamp, next timestamp")
