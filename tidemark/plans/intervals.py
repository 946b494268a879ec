"""Half-open day intervals: expanding them to days and summing them without expanding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_midnight_at_or_after(clock: Column, tz: str = "UTC") -> Column:
    """Local day whose midnight is the first one not earlier than ``clock``."""
    local = F.from_utc_timestamp(clock, tz)
    day = F.to_date(local)
    return F.when(local == day.cast("timestamp"), day).otherwise(F.date_add(day, 1))


def days_of(df: DataFrame, start: str, stop: str, first_day: Column | None = None, last_day: Column | None = None,
            name: str = "day") -> DataFrame:
    """One row per day of ``[start, stop)``, clipped to ``[first_day, last_day]`` where those are given.

    ``stop`` may be NULL for an open interval, which needs a ``last_day``; without one it is an
    error.  Days are generated from the row itself, so no range join is planned.
    """
    low = F.col(start) if first_day is None else F.greatest(F.col(start), first_day)
    if last_day is None:
        open_end = F.raise_error(F.lit("an interval without an end needs a last day")).cast("date")
        high = F.coalesce(F.date_sub(F.col(stop), 1), open_end)
    else:
        high = F.least(F.coalesce(F.date_sub(F.col(stop), 1), last_day), last_day)
    return (
        df.withColumn("__low", low).withColumn("__high", high)
        .where(F.col("__low") <= F.col("__high"))
        .withColumn(name, F.explode(F.sequence("__low", "__high")))
        .drop("__low", "__high")
    )


def interval_sums(df: DataFrame, keys: Sequence[str], start: str, stop: str,
                  values: Sequence[str]) -> DataFrame:
    """State of each key as intervals ``[from_day, to_day)`` with the sums in force.

    Every input interval adds its values at ``start`` and removes them at
    ``stop``.  Changes are first summed per key and day, so the running window
    sees at most one row per calendar day of a key however hot the key is.
    """
    plus = df.select(*keys, F.col(start).alias("from_day"), *values)
    minus = df.where(F.col(stop).isNotNull()).select(
        *keys, F.col(stop).alias("from_day"), *[(-F.col(v)).alias(v) for v in values])
    changes = plus.unionByName(minus).groupBy(*keys, "from_day").agg(*[F.sum(v).alias(v) for v in values])
    order = Window.partitionBy(*keys).orderBy("from_day")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return changes.select(
        *keys, "from_day", F.lead("from_day").over(order).alias("to_day"),
        *[F.sum(v).over(upto).alias(v) for v in values])
