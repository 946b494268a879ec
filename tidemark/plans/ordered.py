"""Ordered computations that stay balanced when one key owns most of the rows.

A window partitioned only by the key puts the whole key into one task.  The
helpers here add a *bucket* (any expression that grows with the row order, such
as the day of a timestamp), do the window inside ``(key, bucket)``, and carry
one summary row per bucket across.  The carried table has one row per bucket,
never one per input row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "__bucket"
SALTS = 64


def spread(column: Column, width: float) -> Column:
    """Bucket expression: steps of ``width`` of a numeric or time column (seconds for a time).

    The caller knows how densely a key can fill its order and picks a width that holds what one task
    can sort; the plan is the same at every size.
    """
    return F.floor(column.cast("double") / F.lit(float(width))).cast("bigint")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1,
          rank_name: str | None = None) -> DataFrame:
    """First ``k`` rows per key.

    Spark plans ``row_number() <= k`` with a partial group limit before the
    shuffle, so each map task sends at most ``k`` rows of a hot key.  It does so up to
    ``spark.sql.optimizer.windowGroupLimitThreshold``; a larger ``k`` is first ranked inside
    ``SALTS`` parts of each key, so that the last window sees ``SALTS * k`` rows of a key at most.
    """
    rank = rank_name or "__rank"
    if k > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(SALTS))
        part = Window.partitionBy(*keys, "__salt").orderBy(*order)
        df = df.withColumn("__salt", salt).withColumn(rank, F.row_number().over(part)).where(F.col(rank) <= k).drop("__salt", rank)
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)
    return ranked if rank_name else ranked.drop(rank)


def _beside(rows: DataFrame, carried: DataFrame) -> DataFrame:
    """Detail rows (``__own``) and the rows carried into their buckets in one table, so no join has to bring them together."""
    return rows.withColumn("__own", F.lit(True)).unionByName(carried.withColumn("__own", F.lit(False)), allowMissingColumns=True)


def neighbour(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
              columns: Sequence[str], name: str, ahead: bool = False) -> DataFrame:
    """Attach the previous (or next) row's ``columns`` as struct ``name`` (NULL at the edge).

    The edge of the bucket before enters the bucket as a row in front of (or behind) all others.
    """
    slots = [*keys, BUCKET]
    rows = df.withColumn(BUCKET, bucket)
    value = F.struct(*columns)
    position = F.struct(*order)
    step = F.lead if ahead else F.lag
    edge = F.min_by(value, position) if ahead else F.max_by(value, position)
    edges = rows.groupBy(*slots).agg(edge.alias("__edge"))
    across = Window.partitionBy(*keys).orderBy(BUCKET)
    carried = edges.select(*slots, step("__edge").over(across).alias("__carry")).where("__carry IS NOT NULL")
    both = _beside(rows, carried)
    window = Window.partitionBy(*slots).orderBy(F.col("__own").desc() if ahead else F.col("__own"), *order)
    # Column by column, so that no second copy of the values travels.
    near = both.withColumns({"__near": step("__own").over(window), "__told": step("__carry").over(window),
                             **{f"__near_{c}": step(c).over(window) for c in columns}}).where("__own")
    found = F.when(F.col("__near"), F.struct(*[F.col(f"__near_{c}").alias(c) for c in columns])).otherwise(F.col("__told"))
    return near.withColumn(name, found).drop("__near", "__told", *[f"__near_{c}" for c in columns], "__own", "__carry", BUCKET)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
            sums: Mapping[str, Column], maxima: Mapping[str, Column] | None = None) -> DataFrame:
    """Attach running sums and maxima up to and including each row of its key."""
    maxima = dict(maxima or {})
    slots = [*keys, BUCKET]
    rows = df.withColumn(BUCKET, bucket)
    for name, column in {**sums, **maxima}.items():
        rows = rows.withColumn("__v_" + name, column)
    totals = rows.groupBy(*slots).agg(
        *[F.sum("__v_" + name).alias("__t_" + name) for name in sums],
        *[F.max("__v_" + name).alias("__t_" + name) for name in maxima],
    )
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carries = ["__c_" + name for name in [*sums, *maxima]]
    carried = totals.select(
        *slots,
        *[F.sum("__t_" + name).over(before).alias("__c_" + name) for name in sums],
        *[F.max("__t_" + name).over(before).alias("__c_" + name) for name in maxima],
    ).where(~F.forall(F.array(*[F.col(c).isNull() for c in carries]), lambda missing: missing))
    # What a bucket starts from is its first row.
    local = Window.partitionBy(*slots).orderBy("__own", *order).rowsBetween(Window.unboundedPreceding, 0)
    both = _beside(rows, carried)
    detail = both.withColumns({
        **{"__l_" + name: F.sum("__v_" + name).over(local) for name in sums},
        **{"__l_" + name: F.max("__v_" + name).over(local) for name in maxima},
        **{"__f" + c: F.first(c).over(local) for c in carries}}).where("__own")
    for name in sums:
        both_missing = F.col("__l_" + name).isNull() & F.col("__f__c_" + name).isNull()
        total = F.coalesce(F.col("__l_" + name), F.lit(0)) + F.coalesce(F.col("__f__c_" + name), F.lit(0))
        detail = detail.withColumn(name, F.when(~both_missing, total))
    for name in maxima:
        detail = detail.withColumn(name, F.greatest("__l_" + name, "__f__c_" + name))
    helpers = [prefix + name for name in [*sums, *maxima] for prefix in ("__v_", "__l_", "__c_", "__f__c_")]
    return detail.drop(BUCKET, "__own", *helpers)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
             name: str = "position") -> DataFrame:
    """One-based position of each row inside its key."""
    return running(df, keys, order, bucket, {name: F.lit(1)})


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, window: int,
              aggregates: Mapping[str, Column], block: int | None = None, keep_position: str | None = None) -> DataFrame:
    """Aggregate over the last ``window`` rows (current one included) of each key.

    ``keep_position`` names a column for the rows' one-based positions.

    Rows get their exact position, are cut into blocks of ``block`` positions,
    and the last ``window - 1`` rows of a block are also sent to the next one,
    so each block holds everything its own rows look back on.
    """
    block = block or max(4 * window, 4096)
    position = "__position"
    placed = numbered(df, keys, order, bucket, position)
    own = F.floor((F.col(position) - 1) / block)
    tail = (F.col(position) - 1) % block >= block - (window - 1)
    targets = F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))
    spread = placed.withColumn("__block", F.explode(targets))
    frame = Window.partitionBy(*keys, "__block").orderBy(position).rowsBetween(-(window - 1), 0)
    for name, aggregate in aggregates.items():
        spread = spread.withColumn(name, aggregate.over(frame))
    kept = spread.where(F.col("__block") == own).drop("__block")
    return kept.withColumnRenamed(position, keep_position) if keep_position else kept.drop(position)


def global_positions(df: DataFrame, order: Sequence[str], bucket: Column, name: str = "position") -> DataFrame:
    """Position over the whole table without one global window over the rows."""
    marked = df.withColumn("__all", F.lit(1))
    return numbered(marked, ["__all"], order, bucket, name).drop("__all")
