"""Deterministic orders, caps and top-k choices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.digests import framed
from tidemark.plans.ordered import top_k


def in_key_order(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total order on the natural key, for a sink."""
    return df.orderBy(*keys)


def cap_recent(edges: DataFrame, k: int, age: str = "event_age", edge: str = "edge_id",
               by: Sequence[str] = ("route", "day")) -> DataFrame:
    """The ``k`` youngest edges per route and day."""
    return top_k(edges, list(by), [F.col(age), F.col(edge)], k)


def seeded_cap(df: DataFrame, k: int, seed: int, row_id: str, by: Sequence[str] = ("day",)) -> DataFrame:
    """``k`` rows per day chosen by a digest of seed, day and id: independent of batching and order."""
    draw = F.sha2(framed([F.lit(seed), *[F.col(c) for c in by], F.col(row_id)]), 256)
    return top_k(df.withColumn("__draw", draw), list(by), [F.col("__draw"), F.col(row_id)], k).drop("__draw")


def argmax_per_dimension(batches: DataFrame, batch: str, dimensions: Mapping[str, Column], ties: Sequence[str]) -> DataFrame:
    """Largest batch per size dimension (ties by ``ties``, then the earliest batch), listed once with its dimensions."""
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("dimension"), value.cast("bigint").alias("size"))
                                for name, value in dimensions.items()]))
    long = batches.select(batch, *ties, pairs.alias("d")).select(batch, *ties, "d.dimension", "d.size")
    best = top_k(long, ["dimension"], [F.col("size").desc(), *[F.col(c).desc() for c in ties], F.col(batch)])
    # At most one row per dimension is left here.
    return best.groupBy(batch).agg(F.sort_array(F.collect_list("dimension")).alias("dimensions"))


def top_rows(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)
