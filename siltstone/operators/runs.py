"""The log of runs: a row is written before a run reads anything and completed when it ends."""

from __future__ import annotations

from datetime import UTC, date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.upsert import upsert
from siltstone.schemas import FETCH_RUNS

ERRORS = 4000


def join_errors(messages: list[str], limit: int = ERRORS) -> str | None:
    """Messages by line, cut before ``limit`` with the number of those left out."""
    lines = [" ".join(m.split()) for m in messages]
    whole = "\n".join(lines)
    if len(whole) <= limit:
        return whole or None
    for keep in range(len(lines) - 1, -1, -1):
        text = "\n".join([*lines[:keep], f"... (+{len(lines) - keep} more)"])
        if len(text) <= limit:
            return text
    return whole[:limit]


def started(spark: SparkSession, run_id: int, source: str, now: datetime) -> DataFrame:
    """The row of a run that has begun: an error until it is completed."""
    return spark.createDataFrame([(run_id, source, now, None, "error", 0, 0, None)], FETCH_RUNS)


def completed(log: DataFrame, run_id: int, now: datetime, fetched: int, upserted: int, errors: list[str], problems: list[str]) -> DataFrame:
    """``log`` with the run's end, counts and status: any error, else any problem, else ok."""
    status = "error" if errors else "partial" if problems else "ok"
    end = log.sparkSession.createDataFrame([(run_id, now, status, fetched, upserted, join_errors(errors + problems))], "id bigint, finished_at timestamp, status string, fetched int, upserted int, error_text string")
    keep = dict.fromkeys(("connector", "started_at"), lambda o, n: o)
    return upsert(log, end, ["id"], keep)


def anchor(log: DataFrame, source: str) -> DataFrame:
    """When the last run of a source that read anything began: one row."""
    return log.where((F.col("connector") == source) & F.col("status").isin("ok", "partial")).agg(F.max("started_at").alias("anchor"))


def since(text: str | None) -> datetime | None:
    """Midnight UTC of a day given as YYYY-MM-DD: a lower bound that overrides a source's window."""
    if text is None:
        return None
    try:
        day = date.fromisoformat(text)
    except ValueError:
        raise ValueError(f"expected a date as YYYY-MM-DD, got {text!r}") from None
    return datetime(day.year, day.month, day.day, tzinfo=UTC)


def _field(text: str, low: int, high: int) -> set[int]:
    out = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        a, _, b = span.partition("-")
        first, last = (low, high) if span == "*" else (int(a), int(b) if b else high if step else int(a))
        if not low <= first <= last <= high or (step and int(step) < 1):
            raise ValueError(f"not a cron field: {text}")
        out |= set(range(first, last + 1, int(step or 1)))
    return out


def period(cadence: str | None) -> timedelta | None:
    """The gap between two fires of a five-field schedule from a fixed instant; None without one."""
    if not cadence:
        return None
    parts = cadence.split()
    if len(parts) != 5:
        raise ValueError(f"not five fields: {cadence}")
    minutes, hours, days, months, weekdays = (_field(p, *r) for p, r in zip(parts, ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))))
    times = sorted(timedelta(hours=h, minutes=m) for h in hours for m in minutes)
    day, fires = datetime(2024, 1, 1), []
    for _ in range(366 * 5):
        weekday = day.isoweekday() % 7 in weekdays or (day.isoweekday() == 7 and 7 in weekdays)
        monthday = day.day in days
        # a restricted day of the month and of the week: either
        fits = weekday or monthday if parts[2] != "*" and parts[4] != "*" else weekday and monthday
        if day.month in months and fits:
            fires += [day + t for t in times]
            if len(fires) >= 2:
                return fires[1] - fires[0]
        day += timedelta(days=1)
    return None
