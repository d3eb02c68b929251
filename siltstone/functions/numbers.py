"""Money, dates and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what magnitude words stand for
MAGNITUDES = {"k": 1e3, "m": 1e6, "mm": 1e6, "b": 1e9, "bn": 1e9, "t": 1e12, "thousand": 1e3, "million": 1e6, "billion": 1e9, "trillion": 1e12}


def parse_amount(text: Column) -> Column:
    """The first dollar amount as whole dollars."""
    pattern = r"(?i)\$\s*(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s*(?:(thousand|million|billion|trillion|bn|mm|k|m|b|t)\b)?"
    value = F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", "").try_cast("double")
    times = F.coalesce(F.create_map(*[F.lit(x) for kv in MAGNITUDES.items() for x in kv])[F.lower(F.regexp_extract(text, pattern, 2))], F.lit(1.0))
    return F.floor(value * times).cast("long")


def money(value: Column) -> Column:
    """$1.5M, $900K, $2.4B; a dash for null."""
    size, sign = F.abs(value), F.when(value < 0, "-").otherwise("")

    def scaled(unit: float, suffix: str) -> Column:
        return F.concat(sign, F.lit("$"), F.regexp_replace(F.format_string("%.1f", F.round(size / unit, 1)), r"\.0$", ""), F.lit(suffix))

    return F.when(value.isNull(), "-").when(size >= 1e9, scaled(1e9, "B")).when(size >= 1e6, scaled(1e6, "M")).when(size >= 1e3, scaled(1e3, "K")).otherwise(F.concat(sign, F.lit("$"), F.format_string("%.0f", F.round(size, 0))))


def age(then: Column, now: Column) -> Column:
    """just now, 5m ago, 5h ago, 3d ago; the date after 90 days."""
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    n = lambda unit: F.floor(s / unit).cast("string")
    return F.when(then.isNull(), "-").when(s < 60, "just now").when(s < 3600, F.concat(n(60), F.lit("m ago"))).when(s < 86400, F.concat(n(3600), F.lit("h ago"))).when(s < 91 * 86400, F.concat(n(86400), F.lit("d ago"))).otherwise(day(then))


def day(then: Column) -> Column:
    return F.date_format(then, "d MMM yyyy")


def duration(seconds: Column) -> Column:
    """1h 2m, 1m 12s, 12s."""
    s = seconds.cast("long")
    part = lambda x, unit: F.concat(F.floor(x).cast("string"), F.lit(unit))
    return F.when(s >= 3600, F.concat_ws(" ", part(s / 3600, "h"), part(s % 3600 / 60, "m"))).when(s >= 60, F.concat_ws(" ", part(s / 60, "m"), part(s % 60, "s"))).otherwise(part(s, "s"))


def safe_int(text: Column) -> Column:
    """A whole number of at least 0, or null."""
    return F.when(F.trim(text).rlike(r"^[0-9]{1,18}$"), F.trim(text).try_cast("long"))


def iso_timestamp(text: Column) -> Column:
    """ISO 8601 with or without a zone (then UTC), or null."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSS]")), F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")))


def feed_timestamp(text: Column) -> Column:
    """The dates of RSS and Atom feeds, or null."""
    plain = F.regexp_replace(text, r"^[A-Za-z]{3}, ", "")
    return F.coalesce(F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(F.regexp_replace(plain, r" GMT$| UTC$", " +0000"), F.lit("d MMM yyyy HH:mm:ss Z")), iso_timestamp(text))
