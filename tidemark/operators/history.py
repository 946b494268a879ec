"""Which version of a key is in force on each day, as intervals of days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.clocks import local_day
from tidemark.functions.digests import digest_slices
from tidemark.plans.intervals import days_of, first_midnight_at_or_after, interval_sums
from tidemark.plans.ordered import neighbour, numbered, running

RANK = ("valid_from", "available_at", "ingested_at")


def competition_intervals(df: DataFrame, keys: Sequence[str], row_id: str, *, tz: str = "UTC",
                          window_days: int | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Version of each key in force as ``[active_from, active_to)`` days.

    A version competes from the first local midnight not before any of its
    clocks and after its event day.  The best competing version stands for the
    key; when it expires or leaves the window the key is absent, because an
    older version never returns.  Versions are first reduced to the best one per
    key and starting day, so the running maximum sees one row per day of a key.
    """
    rank = F.struct(*RANK, F.col(row_id).alias("row"))
    event_day = local_day(F.col("event_at"), tz)
    starts = [first_midnight_at_or_after(F.col(c), tz) for c in RANK]
    expiry = F.when(F.col("valid_to").isNotNull(), first_midnight_at_or_after(F.col("valid_to"), tz))
    entries = df.select(
        *keys, rank.alias("rank"),
        F.greatest(*starts, F.date_add(event_day, 1)).alias("active_from"),
        F.struct(F.col(row_id), event_day.alias("event_day"), expiry.alias("expires"), *carry).alias("version"),
    )
    daily = entries.groupBy(*keys, "active_from").agg(
        F.max("rank").alias("rank"), F.max_by("version", "rank").alias("version"))
    order = Window.partitionBy(*keys).orderBy("active_from")
    best = F.max("rank").over(order.rowsBetween(Window.unboundedPreceding, 0))
    changes = daily.withColumn("best", best).where(F.col("best") == F.col("rank"))
    following = F.lead("active_from").over(order)
    limits = [following, F.col("version.expires")]
    if window_days is not None:
        limits.append(F.date_add("version.event_day", window_days + 1))
    stop = F.least(*limits) if len(limits) > 1 else limits[0]
    return (
        changes.withColumn("active_to", stop)
        .where(F.col("active_to").isNull() | (F.col("active_from") < F.col("active_to")))
        .select(*keys, f"version.{row_id}", "version.event_day", "active_from", "active_to",
                *[f"version.{c}" for c in carry])
    )


def active_on_days(intervals: DataFrame, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """One row per live version and day, within ``[first_day, last_day]`` where those are given."""
    first, last = (F.to_date(F.lit(d)) if d is not None else None for d in (first_day, last_day))
    return days_of(intervals, "active_from", "active_to", first, last)


def rolling_state(intervals: DataFrame, keys: Sequence[str], sums: Sequence[str],
                  first_day: Column | None = None, last_day: Column | None = None, latest: Sequence[str] = ()) -> DataFrame:
    """Per key and day: sums over the live versions and the latest value of ``latest``.

    Versions that share a key, event day and interval are merged first, which
    leaves a calendar-bounded number of rows per key.  Those are partitioned by key
    before they are expanded, so the expanded days are summed without a shuffle.
    """
    merged = intervals.groupBy(*keys, "event_day", "active_from", "active_to").agg(
        *[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in latest], F.count("*").alias("versions"))
    days = days_of(merged.repartition(*keys), "active_from", "active_to", first_day, last_day)
    return days.groupBy("day", *keys).agg(
        *[F.sum(c).alias(c) for c in sums], F.sum("versions").alias("versions"),
        F.max("event_day").alias("last_event_day"), *[F.max(c).alias(c) for c in latest])


def state_changes(intervals: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """The same sums as change intervals, without expanding days (for unbounded history)."""
    return interval_sums(intervals, keys, "active_from", "active_to", sums)


def key_changes(intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every (day, key) on which the state of the key may change."""
    starts = intervals.select(F.col("active_from").alias("day"), *keys)
    stops = intervals.where(F.col("active_to").isNotNull()).select(F.col("active_to").alias("day"), *keys)
    return starts.unionByName(stops).distinct()


def xor_fingerprints(intervals: DataFrame, digest: Column) -> DataFrame:
    """Order-free fingerprint of the active set on every day it changes.

    XOR undoes itself, so each version enters at its first and leaves at its
    last day; the running XOR goes over one row per calendar day.
    """
    names = [f"fp{i}" for i in range(4)]
    sliced = intervals.select("active_from", "active_to", digest.alias("__d")).select(
        "active_from", "active_to", *[s.alias(n) for s, n in zip(digest_slices(F.col("__d")), names)])
    enter = sliced.select(F.col("active_from").alias("day"), *names, F.lit(1).alias("step"))
    leave = sliced.where(F.col("active_to").isNotNull()).select(
        F.col("active_to").alias("day"), *names, F.lit(-1).alias("step"))
    daily = enter.unionByName(leave).groupBy("day").agg(
        *[F.bit_xor(n).alias(n) for n in names], F.sum("step").alias("step"))
    upto = Window.partitionBy(F.lit(1)).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("day", F.sum("step").over(upto).alias("active"),
                        *[F.bit_xor(n).over(upto).alias(n) for n in names])


def marker_between(rows: DataFrame, markers: DataFrame, keys: Sequence[str], order: Sequence[str],
                   bucket: Column, tie: Sequence[str] = ()) -> DataFrame:
    """Flag rows with a marker strictly between them and the previous row of their key.

    ``tie`` decides which of several rows at one position comes first.
    """
    counted = count_markers(rows, markers, keys, order, bucket)
    linked = neighbour(counted, keys, [*order, *tie], bucket, ["__through"], "__previous")
    between = F.col("__before") - F.col("__previous.__through")
    return linked.withColumn("marker_between", F.coalesce(between > 0, F.lit(False))).drop("__before", "__through", "__previous")


def count_markers(rows: DataFrame, markers: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column) -> DataFrame:
    """Attach how many markers of the key lie before (``__before``) and up to (``__through``) each row's position."""
    at = markers.groupBy(*keys, *order).agg(F.count("*").alias("__here")).withColumn("__kind", F.lit(0))
    tagged = rows.withColumn("__kind", F.lit(1)).unionByName(at, allowMissingColumns=True)
    # At one position the marker row comes first and tells the rows behind it how many lie right there.
    here = F.when(F.col("__kind") == 0, F.struct(*order, F.col("__here").alias("__n")))
    counted = running(tagged, keys, [*order, "__kind"], bucket, {"__through": F.coalesce("__here", F.lit(0))}, {"__last": here})
    same = F.lit(True)
    for name in order:
        same = same & (F.col(f"__last.{name}") == F.col(name))
    tied = F.when(F.coalesce(same, F.lit(False)), F.col("__last.__n")).otherwise(0)
    return counted.where(F.col("__kind") == 1).withColumn("__before", F.col("__through") - tied).drop("__kind", "__here", "__last")


def band_lookup(df: DataFrame, bands: DataFrame, rate: str, on: Sequence[str], value: str = "multiplier") -> DataFrame:
    """Value of the half-open band ``[low, high)`` holding ``rate``; the band ending at 1 is closed.

    Bands of one position are folded into a sorted array (a rule table, a few
    entries per position), so the lookup is an equi join and no range join.
    """
    folded = bands.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct("low", "high", value))).alias("__bands"))
    joined = df.join(folded, list(on), "left")
    inside = F.filter("__bands", lambda b: (F.col(rate) >= b["low"]) & (
        (F.col(rate) < b["high"]) | ((b["high"] == 1) & (F.col(rate) <= 1))))
    return joined.withColumn(value, F.try_element_at(inside, F.lit(1))[value]).drop("__bands")
