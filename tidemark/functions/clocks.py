"""Clock columns: UTC instants derived from local calendar days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_day(clock: Column, tz: str) -> Column:
    return F.to_date(F.from_utc_timestamp(clock, tz))


def local_midnight(day: Column, tz: str) -> Column:
    return F.to_utc_timestamp(day.cast("timestamp"), tz)


def day_clocks(day: Column, tz: str) -> dict[str, Column]:
    """An event closes at the last second of its local day and is published the next local midnight."""
    closing = day.cast("timestamp") + F.expr("INTERVAL '23:59:59' HOUR TO SECOND")
    return {
        "scheduled_at": local_midnight(day, tz),
        "event_at": F.to_utc_timestamp(closing, tz),
        "available_at": local_midnight(F.date_add(day, 1), tz),
    }


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1000000.0)
