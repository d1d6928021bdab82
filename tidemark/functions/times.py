"""Times as text, against an explicit `as_of`; nothing reads the wall clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("yyyy-M-d H:m:s", "yyyy-M-d H:m", "yyyy-M-d'T'H:m:s", "yyyy-M-d'T'H:m", "yyyy-M-d", "yyyyMMdd", "yyyy/M/d H:m:s", "yyyy/M/d", "yyyyMMdd H:m:s")


def parse_time(text: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    """The first format that fits, else null."""
    t = F.trim(text)
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in formats])


def in_window(published: Column, as_of: Column, days: int = 1) -> Column:
    """From the start of the day `days` before to the end of as_of's day; texts that are no time are outside."""
    day = F.to_date(parse_time(published))
    return F.coalesce(day.between(F.date_sub(F.to_date(as_of), days), F.to_date(as_of)), F.lit(False))


def freshness(published: Column, as_of: Column) -> Column:
    """1 within the hour, then .95, .9, .85, .8 up to 3, 6, 12 and 24 hours, .6 beyond; 0 for no time. The future counts as now."""
    t = parse_time(published, FORMATS[:7])
    hours = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(t)) / 3.6e9
    out = F.when(t.isNull(), F.lit(0.0))
    for limit, value in ((1, 1.0), (3, 0.95), (6, 0.9), (12, 0.85), (24, 0.8)):
        out = out.when(hours <= limit, F.lit(value))
    return out.otherwise(F.lit(0.6))


def quiet_window(at: Column) -> Column:
    """Which quiet time the moment falls in: the weekend, or the night from 21:30 to 8:00; empty for none."""
    minutes = F.hour(at) * 60 + F.minute(at)
    return F.when(F.dayofweek(at).isin(1, 7), "周末静默").when((minutes >= 21 * 60 + 30) | (minutes < 8 * 60), "夜间静默(21:30-08:00)").otherwise("")


def workdays_between(start: Column, end: Column, holidays: tuple[str, ...] = ()) -> Column:
    """Weekdays after start up to end that are no holidays; 0 where end is not after start."""
    days = F.filter(F.when(end > start, F.sequence(F.date_add(start, 1), end)), lambda d: F.weekday(d) < 5)
    if holidays:
        days = F.filter(days, lambda d: ~d.cast("string").isin(*holidays))
    return F.when(end > start, F.size(days)).otherwise(F.lit(0))
