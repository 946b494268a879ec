"""Ordered and time-based windows per key."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.ordered import global_positions, last_rows, neighbour, running, top_k


def gaps(df: DataFrame, keys: Sequence[str], ordinal: str, bucket: Column) -> DataFrame:
    """Rows that skip at least one ordinal after the previous row of their key."""
    linked = neighbour(df.select(*keys, ordinal), keys, [ordinal], bucket, [ordinal], "__p")
    return linked.where(F.col(ordinal) > F.col(f"__p.{ordinal}") + 1).select(
        *keys, ordinal, F.col(f"__p.{ordinal}").alias("previous"))


def sample_with_total(df: DataFrame, order: Sequence[str], limit: int) -> DataFrame:
    """First rows of an order together with the size of the whole result."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).limit(limit).crossJoin(F.broadcast(total))  # one-row total


def _settled(value: Column) -> Column:
    return F.when(F.abs(value) < 1e-12, F.lit(0.0)).otherwise(value)


def rolling(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, value: str, window: int,
            min_periods: int = 1) -> DataFrame:
    """Sum and mean over the last ``window`` rows; missing rows take a place but no value."""
    if not 1 <= min_periods <= window:
        raise ValueError(f"{min_periods} rows cannot be asked of a window of {window}")
    rolled = last_rows(df, keys, order, bucket, window,
                       {"__sum": F.sum(F.col(value).cast("double")), "__seen": F.count(value)})
    enough = F.col("__seen") >= min_periods
    total = _settled(F.coalesce("__sum", F.lit(0.0)))
    return rolled.withColumns({
        "rolling_sum": F.when(enough, total), "rolling_mean": F.when(enough & (F.col("__seen") > 0), total / F.col("__seen")),
    }).drop("__sum", "__seen")


def rolling_rate(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, numerator: str,
                 denominator: str, window: int, min_periods: int = 1) -> DataFrame:
    """Rolling numerators and denominators (a row counts as present when both are known)."""
    present = F.col(numerator).isNotNull() & F.col(denominator).isNotNull()
    rolled = last_rows(df, keys, order, bucket, window, {
        "__n": F.sum(F.when(present, F.col(numerator).cast("double"))), "__d": F.sum(F.when(present, F.col(denominator).cast("double"))),
        "__seen": F.count(F.when(present, 1))})
    enough = F.col("__seen") >= min_periods
    n, d = _settled(F.col("__n")), _settled(F.col("__d"))
    return rolled.withColumns({"rolling_numerator": F.when(enough, n), "rolling_denominator": F.when(enough, d),
                               "rolling_rate": F.when(enough & (d > 0), n / d)}).drop("__n", "__d", "__seen")


def resolve_alpha(alpha: float | None = None, span: float | None = None, half_life: float | None = None) -> float:
    if sum(v is not None for v in (alpha, span, half_life)) != 1:
        raise ValueError("give exactly one of alpha, span and half_life")
    if span is not None:
        alpha = 2.0 / (span + 1.0)
    elif half_life is not None:
        alpha = 1.0 - math.exp(math.log(0.5) / half_life)
    if not 0.0 < alpha <= 1.0:
        raise ValueError(f"a smoothing factor of {alpha} is not above 0 and at most 1")
    return alpha


#: Rows that one task sorts as a block at most, whatever the smoothing factor.
LARGEST_BLOCK = 100_000


def _block_length(decay: float) -> int:
    """Terms in which the weight falls by 1e-100, so that weights inside a block stay in range."""
    return min(max(1, math.floor(100.0 / -math.log10(decay))), LARGEST_BLOCK)


def decayed_sums(rows: DataFrame, keys: Sequence[str], index: str, order: str, term: str, decay: float, name: str) -> DataFrame:
    """Attach ``sum(term[j] * decay ** (index - j))`` over the rows up to each one.

    ``index`` counts the terms of a key from zero without gaps; rows without a term share the index of the last one.
    Rows are cut into blocks of the index.  Inside a block the sum is a running window.  What earlier blocks
    carry over is the same kind of sum over one row per block, with the decay of a whole block, until a block
    decays by 1e-100; from there on the two blocks before it hold all that a double can tell.
    """
    block = _block_length(decay)
    number, step, own, end, carry = (f"__{n}_{name}" for n in ("block", "step", "own", "end", "carry"))
    placed = rows.withColumns({number: F.floor(F.col(index) / block).cast("bigint"), step: (F.col(index) % block).cast("double")})
    scaled = F.col(term) * F.pow(F.lit(decay), -F.col(step))
    inside = Window.partitionBy(*keys, number).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = F.coalesce(F.sum(scaled).over(inside), F.lit(0.0)) * F.pow(F.lit(decay), F.col(step))
    placed = placed.withColumn(own, local)
    # A block that another one follows is full, so its end is the row of its last term.
    ends = placed.where((F.col(step) == block - 1) & F.col(term).isNotNull()).select(*keys, F.col(number).alias("__b"), F.col(own).alias(end))
    whole = decay ** block
    if block == LARGEST_BLOCK:
        upto = decayed_sums(ends, keys, "__b", "__b", end, whole, f"{name}_")
        following = upto.select(*keys, (F.col("__b") + 1).alias(number), F.col(f"{name}_").alias(carry))
    else:
        one = ends.select(*keys, (F.col("__b") + 1).alias(number), F.col(end).alias("__end1"))
        two = ends.select(*keys, (F.col("__b") + 2).alias(number), F.col(end).alias("__end2"))
        following = one.join(two, [*keys, number], "left").select(
            *keys, number, (F.col("__end1") + F.lit(whole) * F.coalesce("__end2", F.lit(0.0))).alias(carry))
    joined = placed.join(following, [*keys, number], "left")
    total = F.col(own) + F.pow(F.lit(decay), F.col(step) + 1) * F.coalesce(carry, F.lit(0.0))
    return joined.withColumn(name, total).drop(number, step, own, carry)


def ewma(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, value: str, *, adjust: bool = False,
         min_periods: int = 1, **smoothing: float) -> DataFrame:
    """Exponentially weighted mean per row; a missing value repeats the state.

    The state is ``sum(w * decay ** (n - k) * x[k])`` over the present rows, by ``decayed_sums``: no key is
    ever folded in one piece.
    """
    alpha = resolve_alpha(**smoothing)
    decay = 1.0 - alpha
    placed = running(df, keys, order, bucket, {"__position": F.lit(1), "__seen": F.col(value).isNotNull().cast("int")})
    weight = F.lit(1.0) if adjust else F.when(F.col("__seen") == 1, 1.0).otherwise(alpha)
    placed = placed.withColumns({
        "__index": F.greatest(F.col("__seen") - 1, F.lit(0)),
        "__term": F.when(F.col(value).isNotNull(), F.col(value).cast("double") * weight)})
    if decay == 0.0:  # only the newest value counts, which stands under the row's own index
        inside = Window.partitionBy(*keys, "__index").orderBy("__position").rowsBetween(Window.unboundedPreceding, 0)
        placed = placed.withColumn("__state", F.coalesce(F.sum(F.when(F.col(value).isNotNull(), F.col(value).cast("double"))).over(inside), F.lit(0.0)))
    else:
        placed = decayed_sums(placed, keys, "__index", "__position", "__term", decay, "__state")
    state = F.col("__state")
    if adjust:
        state = state * alpha / (1.0 - F.pow(F.lit(decay), F.col("__seen").cast("double")))
    enough = (F.col("__seen") >= min_periods) & (F.col("__seen") > 0)
    return placed.withColumn("ewma", F.when(enough, state)).drop("__position", "__seen", "__index", "__term", "__state")


def time_decay_mean(df: DataFrame, keys: Sequence[str], clock: str, values: Mapping[str, Column], as_of: Any,
                    half_lives_days: Sequence[float]) -> DataFrame:
    """Means with weight ``2 ** (-age / half_life)`` at ``as_of``; later events are an error to be filtered before.

    Ages are cut into spans of 100 half-lives and weighted inside their span; the few
    span sums of a key are then put together relative to its newest span.  Old keys do
    not underflow, and only span sums are joined.
    """
    as_of = F.lit(str(as_of)).cast("timestamp")
    age = (F.unix_micros(as_of) - F.unix_micros(clock)) / F.lit(86_400_000_000.0)
    span = 100.0 * min(half_lives_days)
    rows = df.withColumns({"__span": F.floor(age / span), "__rest": age - F.floor(age / span) * span})
    labels = {days: f"{days:g}".replace(".", "p") for days in half_lives_days}
    parts = []
    for days, label in labels.items():
        weight = F.pow(F.lit(2.0), -F.col("__rest") / F.lit(float(days)))
        parts.append(F.sum(weight).alias(f"__w_{label}"))
        parts += [F.sum(weight * value).alias(f"__{name}_{label}") for name, value in values.items()]
    spans = rows.groupBy(*keys, "__span").agg(*parts)
    newest = spans.groupBy(*keys).agg(F.min("__span").alias("__newest"))
    joined = spans.join(newest, list(keys))
    means = []
    for days, label in labels.items():
        factor = F.pow(F.lit(2.0), -(F.col("__span") - F.col("__newest")) * F.lit(span / float(days)))
        means += [(F.sum(factor * F.col(f"__{name}_{label}")) / F.sum(factor * F.col(f"__w_{label}"))).alias(f"{name}_ewma_{label}d") for name in values]
    return joined.groupBy(*keys).agg(*means)


def events_not_before(df: DataFrame, clock: str, as_of: Any) -> DataFrame:
    """Rows that would leak into a feature evaluated at ``as_of``."""
    return df.where(F.col(clock) >= F.lit(str(as_of)).cast("timestamp"))


def last_n_counts(df: DataFrame, keys: Sequence[str], order: Sequence[Column], windows: Sequence[int],
                  counts: Mapping[str, Column]) -> DataFrame:
    """Sums over the newest 20, 50, ... rows of each key, from one ranked pass."""
    ranked = top_k(df, keys, order, max(windows), rank_name="__rank")
    return ranked.groupBy(*keys).agg(*[
        F.sum(F.when(F.col("__rank") <= n, value.cast("double")).otherwise(0.0)).alias(f"last_{n}_{name}")
        for n in windows for name, value in counts.items()])


def before_day(df: DataFrame, keys: Sequence[str], day: str, order: Sequence[str], values: Mapping[str, Column],
               recent: Sequence[int] = ()) -> DataFrame:
    """Per key and day: row count and sums over all earlier days, and over the last ``n`` earlier rows.

    Rows are reduced to one per day before the cumulative window.  A recent sum is
    the sum over the window of ``n`` rows that ends at the last earlier row, found by
    an equi join on the exact position.
    """
    names = list(values)
    rows = df.select(*keys, day, *order, *[v.cast("double").alias(n) for n, v in values.items()])
    daily = rows.groupBy(*keys, day).agg(F.count("*").alias("__n"), *[F.sum(n).alias(n) for n in names])
    earlier = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    result = daily.select(
        *keys, day, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("prior_rows"),
        *[F.coalesce(F.sum(n).over(earlier), zero).alias(f"prior_{n}") for n in names])
    for n in recent:
        # The window of the last earlier row; a day of a key is the largest piece one task numbers.
        rolled = last_rows(rows, list(keys), [day, *order], F.col(day), n, {f"__r_{v}": F.sum(v) for v in names}, keep_position="prior_rows")
        rolled = rolled.select(*keys, "prior_rows", *[f"__r_{v}" for v in names])
        result = result.join(rolled.hint("merge"), [*keys, "prior_rows"], "left").withColumns({
            f"recent_{n}_rows": F.least(F.col("prior_rows"), F.lit(n)),
            **{f"recent_{n}_{v}": F.coalesce(f"__r_{v}", zero) for v in names},
        }).drop(*[f"__r_{v}" for v in names])
    return result


def evenly_spaced(df: DataFrame, order: Sequence[str], bucket: Column, n: int) -> DataFrame:
    """``n`` rows at evenly spaced positions of an order (all rows when there are no more than ``n``)."""
    placed = global_positions(df, order, bucket, "__position")
    total = df.agg(F.count("*").alias("__total"))
    spots = df.sparkSession.range(n).withColumnRenamed("id", "__i").crossJoin(F.broadcast(total))  # n spots, one total
    step = (F.col("__total") - 1) / F.lit(float(max(n - 1, 1)))
    at = F.when(F.col("__i") == n - 1, F.col("__total") - 1).otherwise(F.floor(F.col("__i") * step))
    if n == 1:
        at = F.lit(0)
    wanted = spots.select(F.when(F.col("__total") <= n, F.col("__i")).otherwise(at).cast("bigint").alias("__at"))
    picked = wanted.select((F.col("__at") + 1).alias("__position")).distinct()
    return placed.join(picked, "__position", "left_semi").drop("__position")


def middle_days(days: DataFrame, group: str, day: str, count: int) -> DataFrame:
    """The ``count`` consecutive days in the middle of the latest season of each group."""
    distinct = days.select(group, day).distinct().withColumn("__season", F.year(day))
    latest = distinct.groupBy(group).agg(F.max("__season").alias("__season"))
    window = Window.partitionBy(group)  # one row per calendar day of a season
    ranked = distinct.join(latest, [group, "__season"]).withColumns({
        "__rank": F.row_number().over(window.orderBy(day)) - 1, "__size": F.count("*").over(window)})
    start = F.floor((F.col("__size") - count) / 2)
    return ranked.where((F.col("__size") >= count) & (F.col("__rank") >= start) & (F.col("__rank") < start + count)).select(group, day)


def interval_union(df: DataFrame, keys: Sequence[str], start: str, stop: str, bucket: Column) -> DataFrame:
    """Overlapping or touching intervals merged; empty ones dropped."""
    rows = df.where(F.col(stop) > F.col(start)).select(*keys, start, stop)
    merged = rows.groupBy(*keys, start).agg(F.max(stop).alias(stop))
    reach = running(merged, keys, [start], bucket, {}, {"__reach": F.col(stop)})
    linked = neighbour(reach, keys, [start], bucket, ["__reach"], "__p")
    opens = F.col("__p").isNull() | (F.col(start) > F.col("__p.__reach"))
    islands = running(linked.withColumn("__open", opens.cast("int")), keys, [start], bucket, {"__island": F.col("__open")})
    return islands.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(stop).alias(stop)).drop("__island")
