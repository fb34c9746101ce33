"""Time expressions. Every function takes its clock (``now``) as an argument so
results are repeatable; the session zone is UTC and naive timestamps mean UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference): the accepted date-time layouts, tried in order.
# Python: "%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S"
MULTI_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSSSSS",
                 "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss")

ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss"
ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def parse_multi(text: Column) -> Column:
    """First format that parses, read as UTC; else null (lenient)."""
    tried = [F.try_to_timestamp(text, F.lit(f)) for f in MULTI_FORMATS]
    return F.coalesce(*tried).cast("timestamp_ntz")


def parse_iso_strict(text: Column) -> Column:
    """ISO 8601 with optional zone, normalised to naive UTC. Unparseable or null
    input raises, whatever ``spark.sql.ansi.enabled`` says."""
    parsed = F.try_to_timestamp(text)
    return F.when(parsed.isNull(), F.raise_error(F.concat(F.lit("invalid ISO 8601 time: "),
                                                          F.coalesce(text, F.lit("null"))))
                  ).otherwise(parsed).cast("timestamp_ntz")


def format_iso(ts: Column, subsecond: bool = False) -> Column:
    """ISO 8601 text with 'Z' (UTC), optionally with microseconds."""
    return F.concat(F.date_format(ts, ISO_MICROS if subsecond else ISO_SECONDS), F.lit("Z"))


def iso_from_epoch(seconds: Column) -> Column:
    return format_iso(F.timestamp_seconds(seconds).cast("timestamp_ntz"))


def day_start(ts: Column) -> Column:
    return F.date_trunc("day", ts).cast("timestamp_ntz")


def day_end(ts: Column) -> Column:
    """23:59:59 of the same day."""
    return F.timestamp_add("SECOND", F.lit(86399), day_start(ts))


def default_month_range(today: Column) -> tuple[Column, Column]:
    """Days 1-4: the whole previous month; otherwise the month to date (dates)."""
    d = F.to_date(today)
    first = F.trunc(d, "month")
    early = F.dayofmonth(d) < 5
    prev_end = F.date_sub(first, 1)
    start = F.when(early, F.trunc(prev_end, "month")).otherwise(first)
    end = F.when(early, prev_end).otherwise(d)
    return start, end


def range_check(start: Column, end: Column, today: Column) -> Column:
    """'valid', 'end_before_start' or 'future' for a requested period."""
    return (F.when(end < start, F.lit("end_before_start"))
            .when(start > today, F.lit("future"))
            .otherwise(F.lit("valid")))


def unix_micros_ntz(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def delta_seconds(before: Column, after: Column) -> Column:
    """Seconds between two times, microsecond precision."""
    return (unix_micros_ntz(after) - unix_micros_ntz(before)) / F.lit(1_000_000.0)


def period_from_range(date_from: Column, date_to: Column, points: int = 400) -> Column:
    """Seconds per chart point: whole days and seconds of the range divided by
    ``points`` with integer division; a range under one day counts as one day;
    a missing bound gives one day per point."""
    secs = (unix_micros_ntz(date_to) - unix_micros_ntz(date_from)) / 1_000_000
    whole_days = F.floor(secs / 86400)
    delta = F.when(whole_days <= 0, F.lit(86400)).otherwise(F.floor(secs).cast("bigint"))
    return F.when(date_from.isNull() | date_to.isNull(), F.lit(86400).cast("bigint")).otherwise(
        F.floor(delta / points).cast("bigint"))


def is_older_than(before: Column, seconds: int, now: Column) -> Column:
    return delta_seconds(before, now) > seconds


def is_newer_than(after: Column, seconds: int, now: Column) -> Column:
    return delta_seconds(now, after) > seconds


def is_soon(ts: Column, window_seconds: int, now: Column) -> Column:
    return ts <= F.timestamp_add("SECOND", F.lit(window_seconds), now)


def to_utc_naive(ts_text_with_zone: Column) -> Column:
    """Zone-aware text to naive UTC."""
    return F.to_timestamp(ts_text_with_zone).cast("timestamp_ntz")
