"""Time predicates and buckets. Timestamps are without time zone and mean UTC."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nice bucket sizes in seconds, from one second to one day. Fixed values.
BUCKET_SECONDS = (1, 2, 5, 10, 15, 30, 60, 120, 300, 600, 900, 1800, 3600, 7200, 14400, 86400)
TARGET_POINTS = 300


def moment(value: datetime | str) -> Column:
    return F.lit(str(value)).cast("timestamp_ntz")


def half_open(col: Column | str, start: datetime | str, end: datetime | str) -> Column:
    """start <= col < end: for raw events; reaches the scan as two pushed filters."""
    c = F.col(col) if isinstance(col, str) else col
    return (c >= moment(start)) & (c < moment(end))


def hour_of(col: Column | str) -> Column:
    return F.date_trunc("hour", col).cast("timestamp_ntz")


def hour_closed(col: Column | str, start: datetime | str, end: datetime | str) -> Column:
    """Both bounds cut to the hour and included: for hourly rollups."""
    c = F.col(col) if isinstance(col, str) else col
    return c.between(hour_of(moment(start)), hour_of(moment(end)))


def with_event_date(start: datetime | str, end: datetime | str, col: str = "event_date") -> Column:
    """The partition predicate that a half-open time range implies, for tables partitioned by day."""
    return F.col(col).between(F.to_date(moment(start)), F.to_date(moment(end)))


def bucket(col: Column | str, seconds: int) -> Column:
    """The start of the epoch-aligned bucket that holds the moment."""
    return F.window(col, f"{int(seconds)} seconds")["start"].cast("timestamp_ntz")


def bucket_seconds(start: datetime, end: datetime, points: int = TARGET_POINTS) -> int:
    """The smallest nice size of at least the whole seconds that ``points`` equal buckets would have."""
    need = max(1, int((end - start).total_seconds()) // points)
    return next((s for s in BUCKET_SECONDS if s >= need), BUCKET_SECONDS[-1])


def bucket_label(seconds: int) -> str:
    for unit, size in (("h", 3600), ("m", 60)):
        if seconds >= size:
            return f"{seconds // size}{unit}"
    return f"{seconds}s"


def event_time(raw: Column, ingested: Column) -> Column:
    """A moment from ISO text, or Unix seconds or milliseconds (over 1e12); the ingest time if zero or unreadable."""
    text = raw.cast("string")
    number = text.try_cast("double")
    seconds = F.when(number > 1e12, number / 1000.0).otherwise(number)
    from_number = F.when(number > 0, F.timestamp_micros((seconds * 1e6).cast("bigint")).cast("timestamp_ntz"))
    from_text = F.when(number.isNull(), text.try_cast("timestamp").cast("timestamp_ntz"))
    return F.coalesce(from_number, from_text, ingested)


def day_key(col: Column | str) -> Column:
    return F.to_date(col)
