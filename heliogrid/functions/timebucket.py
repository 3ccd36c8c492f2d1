"""Time buckets aligned to a fixed origin, and working-period flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every bucket is a whole number of strides from this instant.
ORIGIN = "2001-01-01 00:00:00"
UNIT_SECONDS = {"minute": 60, "hour": 3600, "day": 86400}
#: Local zone, working days (Monday is 0) and hours of the working period.
LOCAL_ZONE, WORK_DAYS, WORK_FROM, WORK_TO = "Europe/Athens", 5, 8, 14


def stride_seconds(size: int, unit: str) -> int:
    if unit not in UNIT_SECONDS:
        raise ValueError("bucket unit must be minute, hour or day")
    return size * UNIT_SECONDS[unit]


def time_bucket(ts: Column, seconds: int) -> Column:
    """Start of the bucket that holds ``ts``; null for null, right before the origin too. Naive stays naive."""
    micros = F.lit(seconds * 1_000_000)
    since = F.timestamp_diff("MICROSECOND", F.lit(ORIGIN).cast("timestamp_ntz"), ts)
    return F.timestamp_add("MICROSECOND", -F.pmod(since, micros), ts)


def truncate_hour(ts: Column) -> Column:
    """Start of the hour; a naive time stays naive."""
    return F.date_trunc("HOUR", ts).cast("timestamp_ntz")


def local_time(ts_utc: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts_utc)


def working_flags(ts_utc: Column, zone: str = LOCAL_ZONE) -> tuple[Column, Column]:
    """(is_working_day, is_working_hour) as 0/1 of a naive UTC time; the hour flag needs a working day."""
    at = local_time(ts_utc, zone)
    day = F.weekday(at) < WORK_DAYS
    hour = day & (F.hour(at) >= WORK_FROM) & (F.hour(at) < WORK_TO)
    return day.cast("short"), hour.cast("short")
